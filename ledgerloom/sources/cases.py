"""Labelled cases, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.scan import ordered_scan

FIELDS = "description string, account string, kind string, expected_merchant string, expected_category string"


def parse_cases(lines: DataFrame, path: str) -> DataFrame:
    """``lines(line_no, value)`` to cases; blank and ``#`` lines are skipped.

    A line that is no JSON object, or lacks one of the fields, raises with its number.
    """
    wanted = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parsed = wanted.withColumn("c", F.from_json("value", FIELDS + ", _corrupt_record string",
                                                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    message = F.concat(F.lit(path + ":"), F.col("line_no").cast("string"), F.lit(": not a JSON object"))
    checked = F.when(F.col("c._corrupt_record").isNull() & F.col("c").isNotNull(), F.col("c")).otherwise(
        F.raise_error(message).cast(parsed.schema["c"].dataType))
    cases = parsed.select("line_no", checked.alias("c")).select("line_no", "c.*").drop("_corrupt_record")

    def present(name: str):
        lacks = F.concat(F.lit(path + ":"), F.col("line_no").cast("string"), F.lit(f": no {name}"))
        return F.coalesce(F.col(name), F.raise_error(lacks).cast("string")).alias(name)

    return cases.select("line_no", *[present(c) for c in cases.columns if c != "line_no"])


def load_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a file (or of each file of a folder), numbered by line.

    Lines are read as rows; their numbers come from their order within a block of the file and the
    lengths of the blocks before, so a long file is not one value.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    numbered = ordered_scan(lines, ["file"], ["block"], ["place"], sums={"line_no": F.lit(1)})
    return parse_cases(numbered.select("line_no", "value"), path)
