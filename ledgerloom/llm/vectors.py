"""All pairs of close vectors by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import local_components
from ledgerloom.llm.components import connected_components
from ledgerloom.storage import Workspace

THRESHOLD = 0.95
TILE = 2048
VALUES = 1 << 20  # of a block
ROWS = 512
FOLD = 1 << 18
DIGEST = 32
PAIRS = 16  # rows of two blocks in an Arrow batch
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROUNDING = 1e-4


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 codes, the scale of each, and the length of what the codes leave out."""
    units = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    return units, codes, scale, np.linalg.norm(units - codes * scale[:, None], axis=1)


def close_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold, of two quantised sets.

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'| with |y| = 1 and |x'| <= 1 + |x - x'|, so a pair
    whose coded product plus that bound stays below the threshold cannot be close.  All others are
    computed in double precision.  ``ROUNDING`` covers single-precision sums of up to 1024 components;
    longer vectors are multiplied in double.  One bound serves a row: the largest loss of the other side.
    """
    units_a, codes_a, scale_a, lost_a = a
    units_b, codes_b, scale_b, lost_b = b
    kind = np.float32 if codes_a.shape[1] <= 1024 else np.float64
    product = codes_a.astype(kind) @ (codes_b * scale_b[:, None]).astype(kind).T
    need = (threshold - ROUNDING - lost_a - (1 + lost_a) * lost_b.max()) / scale_a
    i, j = np.nonzero(product >= need[:, None].astype(kind))
    out_i, out_j = [], []
    for first in range(0, len(i), 1 << 18):
        x, y = i[first:first + (1 << 18)], j[first:first + (1 << 18)]
        close = np.einsum("ij,ij->i", units_a[x], units_b[y]) >= threshold
        out_i.append(x[close])
        out_j.append(y[close])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def _tile(a: tuple, b: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the linked vectors of two blocks (node, weight, quantised set), or of one with itself."""
    alone = b is None
    own, (there, b_weight, right) = len(a[0]), a if alone else b
    node, weight = (a[0], a[1]) if alone else (np.concatenate([a[0], there]), np.concatenate([a[1], b_weight]))
    links, root, base = np.zeros(len(node), np.int64), np.arange(len(node)), 0 if alone else own
    for first in range(0, own, ROWS):
        i, j = close_pairs(tuple(x[first:first + ROWS] for x in a[2]), right, threshold)
        i, j = first + i, base + j
        if alone:
            i, j = i[i != j], j[i != j]
        np.add.at(links, i, weight[j])
        if not alone:
            np.add.at(links, j, weight[i])
        if len(i):
            root = local_components(len(node), np.append(i, np.arange(len(node))), np.append(j, root))
    linked = np.flatnonzero(links)
    return node[linked], links[linked], node[root[linked]]


class _Found:
    """Links and spanning forest of the tiles of one task, folded to one entry a node when many are held."""

    def __init__(self) -> None:
        self.parts, self.held, self.most = [], 0, FOLD

    def add(self, part: tuple) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > self.most:
            self.fold()
            self.most = max(FOLD, 2 * self.held)

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, links, root = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*self.parts) if self.parts else [[], [], []]))
        names, at = np.unique(node, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, at, links)
        one = names, total, names[local_components(len(names), at, np.searchsorted(names, root))]
        self.parts, self.held = [one], len(names)
        return one


def _tiles(threshold: float, kind: type):
    """Links between the two blocks of each row; one entry a node and task."""
    def block(batch: pa.RecordBatch, row: int, first: int) -> tuple:
        node, weight, body = (np.frombuffer(batch.column(first + k)[row].as_buffer(), t) for k, t in enumerate((np.int64, np.int64, kind)))
        return node, weight, quantised(body.reshape(len(node), -1).astype(np.float64))

    def run(batches):
        found, name, left = _Found(), None, None
        for batch in batches:
            for row, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if a != name:
                    name, left = a, block(batch, row, 2)
                found.add(_tile(left, None if a == b else block(batch, row, 5), threshold))
        entries = found.fold()
        for first in range(0, len(entries[0]), FOLD):
            yield pa.RecordBatch.from_arrays([pa.array(c[first:first + FOLD]) for c in entries], ["node", "links", "root"])

    return run


def _blocks(tile: int, kind: type):
    """Vectors of one length in rows of up to ``tile`` of them (fewer, if they are long), beside what names them."""
    def pack(table: pa.Table):
        widths = np.asarray(pc.list_value_length(table.column("embedding")))
        for width in np.unique(widths).tolist():
            some = table.filter(pa.array(widths == width)).combine_chunks()
            node, weight, low = (np.asarray(some.column(c), np.int64) for c in ("node", "weight", "low"))
            body = np.asarray(pc.list_flatten(some.column("embedding")).combine_chunks(), kind)
            content = b"".join(some.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([
                pa.array([int(node[0])], pa.int64()), pa.array([width], pa.int32()),
                *[pa.array([x], pa.binary()) for x in (node.tobytes(), weight.tobytes(), body.tobytes(), low.tobytes(), content)]],
                ["block", "width", "nodes", "weights", "vectors", "lows", "contents"])

    def run(batches):
        held, rows, values = [], 0, 0
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column("embedding")))
            first = 0
            for row, n in enumerate(lengths.tolist()):
                rows, values = rows + 1, values + n
                if rows >= tile or values >= VALUES:
                    yield from pack(pa.Table.from_batches([*held, batch.slice(first, row + 1 - first)]))
                    held, rows, values, first = [], 0, 0, row + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield from pack(pa.Table.from_batches(held))

    return run


def _names(batches):
    for batch in batches:
        for nodes, weights, lows, contents in zip(*[c.to_pylist() for c in batch.columns]):
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.frombuffer(x, np.int64)) for x in (nodes, weights, lows)],
                 pa.array([contents[k:k + DIGEST] for k in range(0, len(contents), DIGEST)], pa.binary())],
                ["node", "weight", "low", "content"])


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE,
                           space: Workspace | None = None) -> DataFrame:
    """Link all vectors whose cosine is at least ``threshold`` and group them.

    ``vectors`` (vec_id: bigint, embedding: array<float or double>, ...) -> (vec_id, n_links,
    component_id, kept), one row per row.  Statement records hold no vectors, so this operator is
    general.  ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id
    reachable (itself included) and ``kept`` says that it is the row's own.  An empty table gives an empty result.  A vector that is null, empty
    or zero or holds a null or non-finite component links with nothing; so does a row with a null id
    (component null, kept false).  Vectors of different lengths do not link.  Repeated rows are rows
    of their own that link with one another.  Other columns are not read.

    Equal vectors are folded first.  The rest is written once, as rows of up to ``tile`` vectors (blocks), and every two
    blocks of one length meet by a nested loop over the partitions of that table, which are read again for each other
    partition: no vector is copied to a shuffle or to disk for it, and a task holds one partition and two blocks, whatever the vectors
    are.  A task returns counts and a spanning forest of its links, never the pairs.  The work grows with the
    square of the different vectors.
    """
    spark = vectors.sparkSession
    own = space is None
    space = space or Workspace(spark, "vectors")
    exact = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if exact else np.float64
    own_kind = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    given = vectors.select("vec_id", own_kind.alias("embedding"), F.col("embedding").cast("array<double>").alias("doubles"))
    good = (F.col("vec_id").isNotNull() & (F.coalesce(F.size("doubles"), F.lit(0)) > 0)
            & F.forall("doubles", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("doubles", lambda x: x != 0))
    content = F.unhex(F.sha2(F.to_json(F.struct(F.col("doubles").alias("embedding"))), 256))
    given = given.select("vec_id", "embedding", F.when(F.coalesce(good, F.lit(False)), content).alias("content"))
    rows = space.cut(given.select("vec_id", "content"), "rows")
    nodes = given.where("content is not null").groupBy("content").agg(
        F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).mapInArrow(
        _blocks(tile, kind), "block bigint, width int, nodes binary, weights binary, vectors binary, lows binary, contents binary")
    blocks = space.cut(nodes, "blocks")
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in ("block", "width", "nodes", "weights", "vectors")]) for side in "ab")
    pairs = left.join(right.hint("shuffle_replicate_nl"), (F.col("width_a") == F.col("width_b")) & (F.col("block_a") <= F.col("block_b")))
    pairs = pairs.select("block_a", "block_b", *[f"{c}_{side}" for side in "ab" for c in ("nodes", "weights", "vectors")])
    batch = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(PAIRS))
    try:
        found = space.cut(pairs.mapInArrow(_tiles(threshold, kind), "node bigint, links bigint, root bigint"), "found")
    finally:
        spark.conf.set(BATCH, batch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), space)
    names = blocks.select("nodes", "weights", "lows", "contents").mapInArrow(_names, "node bigint, weight bigint, low bigint, content binary")
    named = names.join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    result = space.cut(named.join(lows, "component").select(
        "content", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "groups")
    if own:
        space.close(rows, result)
    joined = rows.join(result, "content", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
