"""Token counts of statement texts with a cache by content digest."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import small_batches
from ledgerloom.storage import Workspace

LIMIT = 4096
CACHE = "content binary, tokenizer string, n_tokens bigint"

_models: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file has counts of its own in the cache."""
    with open(path, "rb") as data:
        return hashlib.sha256(data.read()).hexdigest()


def counter(path: str):
    """Function from texts to token counts by the library of the file; one model a Python worker."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece
            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer
            _models[path] = Tokenizer.from_file(path)
    model = _models[path]
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark, path: str | None) -> DataFrame:
    """Stored counts, or none if nothing was stored there yet."""
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(statements: DataFrame, tokenizer_path: str, cache_path: str, limit: int = LIMIT,
                 space: Workspace | None = None) -> DataFrame:
    """Token counts of whole statement texts, encoding each content only once.

    ``statements`` (stmt_id, text, ...) -> (stmt_id, n_bytes, n_tokens, over_limit), one row per row.
    Content is normalised to UTF-8 bytes with null as empty; nothing else may change or counts would
    be others.  Contents (SHA-256) that the cache under ``cache_path`` holds for this tokenizer file
    are looked up; of the others one row each is encoded, and the counts are appended to the cache.
    Repeated rows and ids stay; null ids too; other columns are not read; an empty table gives an empty result.

    Only digests are shuffled to find the misses.  Their texts then meet the chosen rows by digest and
    id together, so that a content with very many copies is spread over tasks.
    """
    spark = statements.sparkSession
    small_batches(spark)
    space = space or Workspace(spark, "tokens")
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    rows = space.cut(statements.select("stmt_id", content.alias("content"),
                                       F.octet_length(text).cast("bigint").alias("n_bytes")), "contents")
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens") \
        .groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    wanted = rows.groupBy("content").agg(F.min("stmt_id").alias("stmt_id"))
    misses = wanted.join(stored, "content", "left_anti").select(
        "content", F.col("stmt_id").alias("chosen"))

    def run(batches):
        count = counter(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    texts = statements.select(content.alias("content"), "stmt_id", text.alias("text"))
    chosen = texts.join(misses.hint("shuffle_hash"), (texts.content == misses.content)
                        & texts.stmt_id.eqNullSafe(misses.chosen), "left_semi").select("content", "text")
    new = space.cut(chosen.mapInArrow(run, "content binary, n_tokens bigint")
                    .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "new")
    if not new.isEmpty():
        new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = new.union(stored)
    return rows.join(counts, "content").select(
        "stmt_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
