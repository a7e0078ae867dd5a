"""Scoring of a classifier on labelled rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.storage import materialize


def predictions(cases: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cases beside what the classifier says: adds ``merchant`` and ``category``.

    Written as a table, so that filters on the outcome do not reach down into the classifier and
    run it again.
    """
    return materialize(classify(cases), "predictions")


def _merchant_ok():
    return F.col("merchant").eqNullSafe(F.col("expected_merchant"))


def _category_ok():
    return F.col("category").eqNullSafe(F.col("expected_category"))


def eval_score(scored: DataFrame, min_accuracy: float | None = None, min_coverage: float | None = None) -> DataFrame:
    """Accuracy and coverage in one aggregation; both are 1.0 when there is nothing to count."""
    coverable = F.col("expected_category") != V.UNCATEGORIZED
    out = scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_merchant_ok()).alias("merchant_matches"),
        F.count_if(_category_ok()).alias("category_matches"),
        F.count_if(_merchant_ok() & _category_ok()).alias("exact_matches"),
        F.count_if(coverable).alias("coverable"),
        F.count_if(coverable & (F.col("category") != V.UNCATEGORIZED)).alias("covered"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(1.0))
    out = out.withColumns({"accuracy": ratio("exact_matches", "total"), "coverage": ratio("covered", "coverable")})
    if min_accuracy is not None:
        out = out.withColumn("accuracy_ok", F.col("accuracy") >= min_accuracy)
    if min_coverage is not None:
        out = out.withColumn("coverage_ok", F.col("coverage") >= min_coverage)
    return out


def eval_misses(scored: DataFrame) -> DataFrame:
    return scored.where(~(_merchant_ok() & _category_ok()))
