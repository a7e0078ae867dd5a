"""Lineage cuts and size-checked broadcasts.

Cuts go to a written table under the folder named by ``spark.checkpoint.dir`` so that a lost
executor costs a re-read, not a recomputation.  Only when that setting is absent (local tests) is
a scratch folder made.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_scratch: str | None = None  # of a local session without the setting
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 250_000  # of a frame that is sorted or grouped


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialized tables, read from the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    global _scratch
    _scratch = _scratch or tempfile.mkdtemp(prefix="ledgerloom-")
    return _scratch


_current: ContextVar[Workspace | None] = ContextVar("workspace", default=None)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back: a columnar, prunable lineage cut.

    Inside ``with Workspace(...)`` the cut belongs to that workspace, which removes it at the end.
    """
    space = _current.get()
    if space is not None:
        return space.cut(df, name)
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` that takes aggregates of ``df`` while it is written, instead of by a scan of its own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = materialize(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()]), name)
    return out, dict(seen.get)


class Workspace:
    """Owner of the intermediate tables of one run.

    Every cut lands in one folder of its own under the shared checkpoint folder; ``close`` removes
    all of them but those named, so a finished run leaves only its result.  As a context it also owns
    what ``materialize`` cuts, and removes at its end all but what ``keep`` was told.
    """

    def __init__(self, spark: SparkSession, name: str = "run") -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._kept: list[DataFrame] = []

    def __enter__(self) -> Workspace:
        self._token = _current.set(self)
        return self

    def __exit__(self, *exc) -> None:
        _current.reset(self._token)
        self.close(*self._kept)

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df)
        return df

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove one cut that nothing reads any more."""
        remove_path(self.spark, self._paths.pop(id(df))[1])

    def close(self, *keep: DataFrame) -> None:
        kept = {id(df) for df in keep}
        for key, (_, path) in list(self._paths.items()):
            if key not in kept:
                del self._paths[key]
                remove_path(self.spark, path)
        if not kept:
            remove_path(self.spark, self.root)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table this library wrote, through the file system Spark uses for it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def measured_bytes(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> int:
    """In-memory size of ``df``, by aggregation over it (strings, nested values and a per-row overhead)."""
    width = F.lit(16).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            value = F.octet_length(field.name)
        elif kind in ("struct", "array", "map"):
            value = 2 * F.octet_length(F.to_json(F.struct(field.name)))
        else:
            value = F.lit(0)
        width = width + F.coalesce(value, F.lit(0)) + 16
    return df.select(F.sum(width.cast("long")).alias("b")).first()["b"] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast a *materialized* frame only when its measured size is under the limit.

    Above the limit the frame is returned unhinted, and the join is a shuffled one that adaptive
    execution may split when a key is hot.
    """
    return F.broadcast(df) if measured_bytes(df, limit) <= limit else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition for a CPU-heavy step; a given number is not merged by adaptive execution."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *columns)


def dealt(df: DataFrame, *columns: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Large frames dealt out by ``columns`` so that a task holds about ``rows`` rows, however many there are.

    A frame that the session's number of shuffle partitions splits as finely is returned as it is.  Counting reads ``df``:
    it should be a written table.
    """
    return dealt_rows(df, df.count(), *columns, rows=rows)


def dealt_rows(df: DataFrame, count: int, *columns: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """As ``dealt``, for a frame of about ``count`` rows."""
    parts = -(-count // rows)
    return df.repartition(parts, *columns) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
