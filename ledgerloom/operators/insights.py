"""Ranked findings of a period, each a re-aggregation of ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import spend as S
from ledgerloom.operators.timeseries import longest_streak, price_drift
from ledgerloom.storage import materialize

COLUMNS = ["finding", "tone", "weight", "subject", "value", "reference", "pct"]


def _row(df: DataFrame, finding: str, tone: Column, weight: Column, subject: Column, value: Column,
         reference: Column, pct: Column) -> DataFrame:
    return df.select(F.lit(finding).alias("finding"), tone.alias("tone"), weight.cast("double").alias("weight"),
                     subject.cast("string").alias("subject"), value.cast("double").alias("value"),
                     reference.cast("double").alias("reference"), pct.cast("double").alias("pct"))


def insights(df: DataFrame, recurring: DataFrame, period="all", limit: int = 6) -> DataFrame:
    """The weightiest findings: total change, category change, largest row, price drift, open spend, streak."""
    none = F.lit(None)
    folded = S.month_rollup(df)
    recurring = materialize(recurring, "recurring")
    all_months = S.spend_months(folded)
    months = S.period_months(all_months, period)
    prior = S.prior_window(all_months, months)
    rows = S.spend_rows(S.period_filter(df, months))
    change = S.period_change(folded, months, prior)
    # both totals come from the one category frame; a missing prior window leaves them without findings
    has_prior = F.col("prior_spend") > 0
    totals = change.agg(F.sum("current_spend").alias("current_spend"), F.sum("prior_spend").alias("prior_spend"))
    delta = F.col("current_spend").cast("double") - F.col("prior_spend").cast("double")
    pct = delta / F.col("prior_spend").cast("double") * 100
    tone = F.when(delta > 0, "up").otherwise("down")
    moved = _row(totals.where(has_prior & (F.abs(pct) >= 3)), "total_change", tone, F.abs(delta), none,
                 F.col("current_spend"), F.col("prior_spend"), pct)
    biggest = (change.where((F.col("prior_spend") >= 20) & (F.abs("change") >= 20))
               .orderBy(F.desc(F.abs("change")), "category").limit(1))
    category = _row(biggest, "category_change", tone, F.abs("change"), F.col("category"), F.col("current_spend"),
                    F.col("prior_spend"), F.abs(delta) / F.col("prior_spend").cast("double") * 100)
    # the first row in newest-first order among equals
    top = rows.orderBy("signed", F.desc("date"), F.desc("txn_id")).limit(1)
    largest = _row(top, "largest_row", F.lit("neutral"), -F.col("signed").cast("double") * 0.5, F.col("merchant"),
                   -F.col("signed"), none, none)
    last, first = F.col("last_amount").cast("double"), F.col("first_amount").cast("double")
    drift = _row(price_drift(recurring), "price_drift", F.lit("up"), (last - first) * 12, F.col("merchant"),
                 last, first, F.col("pct"))
    sums = S.spend_rows(S.period_filter(folded, months)).agg(F.sum(F.when(F.col("category") == V.UNCATEGORIZED, -F.col("signed"))).cast("double").alias("open_spend"),
                    F.sum(-F.col("signed")).cast("double").alias("total"))
    open_rows = _row(sums.where((F.col("open_spend") >= 20) & (F.col("open_spend") / F.col("total") >= 0.01)),
                     "uncategorized", F.lit("warn"), F.col("open_spend"), none, F.col("open_spend"), F.col("total"),
                     F.col("open_spend") / F.col("total") * 100)
    streak = longest_streak(S.period_filter(S.cashflow_monthly(folded), months))
    red = _row(streak.where(F.col("streak") >= 2), "deficit_streak", F.lit("warn"), F.col("streak") * 100.0, none,
               F.col("streak"), none, none)
    found = moved
    for part in (category, largest, drift, open_rows, red):
        found = found.unionByName(part)
    return found.orderBy(F.desc("weight"), "finding", "subject").limit(limit)
