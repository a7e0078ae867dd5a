"""Gaps, cadence, recurring charges, streaks and running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators.scan import ordered_scan, weighted_median
from ledgerloom.storage import materialize


def cents(value: Column) -> Column:
    """Rounded to cents, half up."""
    return F.floor(value.cast("double") * 100 + 0.5) / 100


def charge_days(spend: DataFrame) -> DataFrame:
    """Charges folded to one row per (merchant, day), which bounds a merchant by the calendar."""
    amount = -F.col("signed")
    return spend.groupBy("merchant", "date").agg(
        F.count(F.lit(1)).alias("charges"), F.sum(amount).alias("amount_sum"),
        F.sum((amount * amount).cast("decimal(38,4)")).alias("square_sum"),
        F.min_by(amount, "txn_id").alias("first_amount"), F.max_by(amount, "txn_id").alias("last_amount"),
        F.max_by("category", "txn_id").alias("last_category"))


def gaps(days: DataFrame) -> DataFrame:
    """Days between consecutive charges per merchant.

    Works on distinct (merchant, date), so zero gaps do not arise and a window never holds more
    rows than there are days in the data.
    """
    by_date = Window.partitionBy("merchant").orderBy("date")
    return (days.withColumn("gap", F.datediff("date", F.lag("date").over(by_date)))
            .where(F.col("gap").isNotNull()).select("merchant", "date", "gap"))


def gap_statistics(gap_rows: DataFrame) -> DataFrame:
    """Per merchant: number of gaps, exact median and median absolute deviation."""
    counted = materialize(gap_rows.groupBy("merchant", "gap").agg(F.count(F.lit(1)).alias("n")), "gaps")
    median = counted.groupBy("merchant").agg(
        F.sum("n").alias("gap_count"), F.percentile("gap", F.lit(0.5), F.col("n")).alias("gap_median"))
    spread = (counted.join(median, "merchant")
              .groupBy("merchant").agg(F.percentile(F.abs(F.col("gap") - F.col("gap_median")), F.lit(0.5), F.col("n")).alias("gap_mad")))
    return median.join(spread, "merchant")


def cadence(gap: Column) -> Column:
    branch = F
    for name, low, high, _ in V.CADENCES:
        branch = branch.when(gap.between(low, high), F.lit(name))
    return branch.otherwise(F.lit(None).cast("string"))


def charges_per_month(name: Column) -> Column:
    branch = F
    for label, _, _, rate in V.CADENCES:
        branch = branch.when(name == label, F.lit(rate))
    return branch


def find_recurring(spend: DataFrame, corpus_end: Column | str, *, min_charges: int = 4, max_mad: float = 0.20,
                   max_cv: float = 0.60, variable_cv: float = 0.15, stale_periods: float = 2.5) -> DataFrame:
    """Merchants that bill on a schedule.

    ``spend`` has ``merchant, date, signed, category, txn_id``.  Cheap gates (number of charges and
    of months, spread of amounts) come before the gap statistics, and those before the median of
    amounts; a merchant that fails one takes no part in what follows.
    """
    end = F.lit(corpus_end).cast("date") if isinstance(corpus_end, str) else corpus_end
    days = materialize(charge_days(spend), "days")
    totals = days.groupBy("merchant").agg(
        F.sum("charges").alias("row_count"), F.size(F.collect_set(F.date_format("date", "yyyy-MM"))).alias("months"),
        F.sum("amount_sum").alias("total"), F.sum("square_sum").alias("squares"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("first_amount", "date").alias("first_amount"), F.max_by("last_amount", "date").alias("last_amount"),
        F.max_by("last_category", "date").alias("category"),
    ).where((F.col("row_count") >= min_charges) & (F.col("months") >= min_charges) & (F.col("total") > 0))
    mean = F.col("total").cast("double") / F.col("row_count")
    variance = F.col("squares").cast("double") / F.col("row_count") - mean * mean
    totals = materialize(totals.withColumn("cv", F.sqrt(F.greatest(variance, F.lit(0.0))) / mean)
                         .where(F.col("cv") <= max_cv), "totals")
    likely = days.join(totals.select("merchant"), "merchant", "left_semi")
    regular = gap_statistics(gaps(likely)).where(
        (F.col("gap_count") >= 3) & (F.col("gap_mad") / F.col("gap_median") <= max_mad)
    ).withColumn("cadence", cadence(F.col("gap_median"))).where(F.col("cadence").isNotNull())
    found = totals.join(regular, "merchant")
    found = materialize(found, "found")
    amounts = (spend.join(found.select("merchant"), "merchant", "left_semi")
               .groupBy("merchant", (-F.col("signed")).alias("amount")).agg(F.count(F.lit(1)).alias("n")))
    amounts = materialize(amounts, "amounts")
    middle = weighted_median(amounts, ["merchant"], "amount", "n")
    stale = F.datediff(end, F.col("last_date"))
    active = stale <= F.col("gap_median") * stale_periods
    return found.join(middle, "merchant").select(
        "merchant", "category", "cadence", cents(F.col("median")).alias("typical"), "row_count", "total",
        cents(F.col("median") * charges_per_month(F.col("cadence"))).alias("monthly"),
        "first_date", "last_date", "first_amount", "last_amount",
        (F.col("cv") > variable_cv).alias("variable"), active.alias("active"),
        F.when(active, F.lit(0)).otherwise(F.floor(stale / F.col("gap_median"))).cast("int").alias("missed"))


def recurring_order(found: DataFrame) -> DataFrame:
    """Active first, then the most costly."""
    return found.orderBy(F.desc("active"), F.desc("monthly"), "merchant")


def price_drift(found: DataFrame, min_pct: float = 8) -> DataFrame:
    first, last = F.col("first_amount").cast("double"), F.col("last_amount").cast("double")
    return (found.where(F.col("active") & (F.col("first_amount") > 0))
            .withColumn("pct", (last - first) / first * 100).where(F.col("pct") >= min_pct)
            .select("merchant", "first_amount", "last_amount", "pct"))


def monthly_obligations(found: DataFrame) -> DataFrame:
    """Standing charges at their monthly equivalent, with the total per month and per year."""
    live = found.where("active")
    live = materialize(live, "obligations")
    total = live.agg(F.sum("monthly")).scalar()
    return live.select("merchant", "category", "cadence", "monthly").withColumns(
        {"total_monthly": total, "total_yearly": total * 12}).orderBy(F.desc("monthly"), "merchant")


def recurring_status(found: DataFrame) -> DataFrame:
    """Live and ended charges; ended ones are outside the monthly total."""
    return found.agg(F.count_if("active").alias("live"), F.count_if(~F.col("active")).alias("ended"),
                     F.coalesce(F.sum(F.when(F.col("active"), F.col("monthly"))), F.lit(0.0)).alias("monthly"))


def longest_streak(flow: DataFrame) -> DataFrame:
    """The longest run of consecutive months of the series that spent more than came in.

    The window has no partition key: the frame holds one row per calendar month.
    """
    red = F.col("money_in") < F.col("money_out")
    ordered = Window.orderBy("month")
    by_sign = Window.partitionBy("red").orderBy("month")
    runs = (flow.withColumn("red", red)
            .withColumn("island", F.row_number().over(ordered) - F.row_number().over(by_sign))
            .where("red").groupBy("island").agg(F.count(F.lit(1)).alias("len")))
    return runs.agg(F.coalesce(F.max("len"), F.lit(0)).alias("streak"))


def running_balance(rows: DataFrame, opening: DataFrame, *, keys: list[str], segments: list[str],
                    order: list[str]) -> DataFrame:
    """Cumulative amount from the opening balance, in ledger order, as ``running``."""
    walked = ordered_scan(rows, keys, segments, order, sums={"running": F.col("amount")})
    return (walked.join(opening, keys).withColumn("running", (F.col("running") + F.col("opening")).cast("decimal(18,2)"))
            .drop("opening"))


def sequence_statements(statements: DataFrame, key: list[str]) -> DataFrame:
    """Per-account position of each statement by period start."""
    by_year = statements.withColumn("period_year", F.year("period_start"))
    return ordered_scan(by_year, key, ["period_year"], ["period_start", "stmt_id"],
                        sums={"position": F.lit(1)}).drop("period_year")
