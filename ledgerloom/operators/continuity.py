"""Checks across statements: period gaps, balance chains and the net position of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators.scan import ordered_scan
from ledgerloom.operators.spend import account_label, with_balances
from ledgerloom.storage import materialize

ACCOUNT = ["account", "account_last4"]


def polarity_by_kind(layouts=None) -> dict[str, int]:
    """Account kind to +1 (asset) or -1 (liability); conflicting declarations are an error."""
    declared: dict[str, int] = {}
    for name, _, kind, polarity, *_ in layouts or V.LAYOUTS:
        if declared.setdefault(kind, polarity) != polarity:
            raise ValueError(f"layout {name} disagrees on whether {kind!r} is an asset or a liability")
    return declared


def polarity_of(account: Column, layouts=None) -> Column:
    branch = F
    for kind, polarity in polarity_by_kind(layouts).items():
        branch = branch.when(account == kind, F.lit(polarity))
    return branch.otherwise(F.lit(None).cast("int"))


def with_previous_statement(statements: DataFrame, key: list[str] = ACCOUNT) -> DataFrame:
    """Each statement beside the one before it in its account (``previous`` struct, null for the first)."""
    base = with_balances(statements).withColumn("period_year", F.year("period_start"))
    return ordered_scan(base, key, ["period_year"], ["period_start", "stmt_id"], previous={
        "previous": F.struct("stmt_id", "period_end", "closing_balance")}).drop("period_year")


def period_gaps(statements: DataFrame, key: list[str] = ACCOUNT, pairs: DataFrame | None = None,
                carry: list[str] | None = None) -> DataFrame:
    """Signed gap (or overlap) days between consecutive statements of an account.

    ``pairs``: the statements with the one before, if they are at hand already; ``carry``: more of their columns to keep.
    """
    pairs = with_previous_statement(statements, key) if pairs is None else pairs
    return (pairs.where(F.col("previous").isNotNull()).withColumn("days", F.datediff("period_start", F.col("previous.period_end")) - 1)
            .where(F.col("days") != 0)
            .select(*key, *(carry or []), "stmt_id", F.col("previous.period_end").alias("prior_end"), "period_start", "days"))


def balance_chain(statements: DataFrame, key: list[str] = ACCOUNT, tolerance: float = 0.005,
                  pairs: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """Statements whose opening balance is not the closing balance before it."""
    pairs = with_previous_statement(statements, key) if pairs is None else pairs
    close, opened = F.col("previous.closing_balance"), F.col("opening_balance")
    return (pairs.where(F.abs(close - opened) > tolerance)
            .select(*key, *(carry or []), "stmt_id", close.alias("prior_close"), opened.alias("opening_balance")))


def account_movement(statements: DataFrame, key: list[str] = ACCOUNT, layouts=None) -> DataFrame:
    """First opening, last closing and the weighted change per account."""
    at = F.struct("period_start", "stmt_id")
    ends = with_balances(statements).groupBy(*key).agg(
        F.min_by(F.struct("opening_balance"), at).alias("o"), F.max_by(F.struct("closing_balance"), at).alias("c"))
    return ends.select(*key, F.col("o.opening_balance").alias("first_open"), F.col("c.closing_balance").alias("last_close"),
                       polarity_of(F.col("account"), layouts).alias("polarity")).withColumn(
        "movement", (F.col("polarity") * (F.col("last_close") - F.col("first_open"))).cast("decimal(28,2)"))


def net_position(statements: DataFrame, transactions: DataFrame, key: list[str] = ACCOUNT,
                 tolerance: float = 0.01, layouts=None) -> DataFrame:
    """One row: net of all signed rows against the weighted movement of all balances.

    ``complete`` is false when an account lacks a balance or a polarity; the check is then void.
    """
    moved = account_movement(statements, key, layouts).agg(
        F.sum("movement").alias("expected"), F.bool_and(F.col("movement").isNotNull()).alias("complete"))
    total = transactions.agg(F.coalesce(F.sum("signed"), F.lit(0)).cast("decimal(28,2)")).scalar()
    return moved.withColumn("actual", total).withColumn(
        "ok", ~F.col("complete") | (F.abs(F.col("expected") - F.col("actual")) <= tolerance))


def continuity(statements: DataFrame, transactions: DataFrame, key: list[str] = ACCOUNT, layouts=None) -> DataFrame:
    """All problems across statements: ``(scope, account, account_last4, kind, detail, measured, expected)``."""
    money = "decimal(28,2)"
    label = account_label(F.col("account"), F.col("account_last4"))
    names = [c for c in ACCOUNT if c not in key]
    needed = statements.select(*dict.fromkeys([*key, *ACCOUNT, "stmt_id", "period_start", "period_end", "summary"]))
    pairs = materialize(with_previous_statement(needed, key).drop("summary"), "previous")
    gaps = period_gaps(statements, key, pairs, names).select(
        "stmt_id", *ACCOUNT, F.lit("period_gap").alias("kind"),
        F.concat(label, F.lit(" has "), F.format_string("%+d", "days"), F.lit(" days between the period ending "),
                 F.col("prior_end").cast("string"), F.lit(" and the one starting "), F.col("period_start").cast("string")).alias("detail"),
        F.col("days").cast(money).alias("measured"), F.lit(0).cast(money).alias("expected"))
    chain = balance_chain(statements, key, pairs=pairs, carry=names).select(
        "stmt_id", *ACCOUNT, F.lit("balance_chain").alias("kind"),
        F.concat(label, F.lit(" opens at "), F.col("opening_balance").cast("string"), F.lit(" after closing at "),
                 F.col("prior_close").cast("string")).alias("detail"),
        F.col("opening_balance").cast(money).alias("measured"), F.col("prior_close").cast(money).alias("expected"))
    net = net_position(statements, transactions, key, layouts=layouts).where(~F.col("ok")).select(
        F.lit(None).cast("string").alias("stmt_id"), *[F.lit(None).cast("string").alias(c) for c in ACCOUNT],
        F.lit("net_position").alias("kind"),
        F.concat(F.lit("all rows sum to "), F.col("actual").cast("string"), F.lit(", all balances to "),
                 F.col("expected").cast("string")).alias("detail"),
        F.col("actual").alias("measured"), F.col("expected").alias("expected"))
    return gaps.unionByName(chain).unionByName(net).select(
        F.when(F.col("stmt_id").isNull(), "corpus").otherwise("account").alias("scope"), *ACCOUNT, "stmt_id",
        "kind", "detail", "measured", "expected")


def run_totals(statements: DataFrame, transactions: DataFrame, checks: DataFrame, unparsed: DataFrame,
               problems: DataFrame) -> DataFrame:
    """One row of totals and whether the tables may be written."""
    def tagged(df: DataFrame, name: str, counted: Column | None = None) -> DataFrame:
        value = F.lit(1) if counted is None else counted.cast("int")
        return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).select(F.lit(name).alias("what"), "n")

    parts = [tagged(statements, "statements"), tagged(transactions, "transactions"),
             tagged(checks, "failed_checks", ~F.col("ok")), tagged(unparsed, "unparsed"), tagged(problems, "problems")]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    one = counts.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n)
                       for n in ("statements", "transactions", "failed_checks", "unparsed", "problems")])
    return with_verdict(one)


def with_verdict(totals: DataFrame) -> DataFrame:
    return totals.withColumn("can_generate", (F.col("failed_checks") == 0) & (F.col("unparsed") == 0) & (F.col("problems") == 0))


def statement_report(statements: DataFrame, transactions: DataFrame, checks: DataFrame, unparsed: DataFrame,
                     sample: int = 5) -> DataFrame:
    """Per statement: rows, checks, failed checks with their deltas, and the first unparsed lines."""
    rows = transactions.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("row_count"))
    verdict = checks.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("check_count"), F.count_if(~F.col("ok")).alias("failed_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.concat(
            F.col("name"), F.lit(":"), F.col("delta").cast("string"))))), ", ").alias("failed"))
    lines = first_lines(unparsed, sample)
    return (statements.select("stmt_id", "account", "account_last4", "period_start", "period_end")
            .join(rows, "stmt_id", "left").join(verdict, "stmt_id", "left").join(lines, "stmt_id", "left")
            .fillna(0, ["row_count", "check_count", "failed_count", "unparsed_count"])
            .fillna("", ["failed", "unparsed_sample"]))


def first_lines(unparsed: DataFrame, sample: int) -> DataFrame:
    """Count and first lines per statement.  Only ``sample`` lines of a statement are gathered: the
    cut to the first few per (statement, page) comes before the rows meet in one group."""
    from pyspark.sql import Window
    page = (F.col("line_no") / 1000).cast("int")
    count = unparsed.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("unparsed_count"))
    ranked = unparsed.withColumn("page", page).withColumn(
        "n", F.row_number().over(Window.partitionBy("stmt_id", "page").orderBy("line_no"))).where(F.col("n") <= sample)
    ranked = ranked.withColumn(
        "n", F.row_number().over(Window.partitionBy("stmt_id").orderBy("line_no"))).where(F.col("n") <= sample)
    text = ranked.groupBy("stmt_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " | ").alias("unparsed_sample"))
    return count.join(text, "stmt_id")
