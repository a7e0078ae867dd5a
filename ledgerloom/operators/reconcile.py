"""Statement checks: what was parsed against what the statement prints.

Every check is a row ``(stmt_id, name, expected, actual, tolerance, delta, ok)`` and exists only if
its printed inputs do.  Rows are summed once per statement (with map-side combine) and all checks
are then read off that one frame, so a check costs no shuffle of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators.layouts import SHIPPED, Layout, RowSum, Total
from ledgerloom.operators.scan import ordered_scan
from ledgerloom.storage import materialize

TOLERANCE = 0.005
MONEY = "decimal(18,2)"


def _name(total: RowSum) -> str:
    parts = [*total.kinds, {True: "above", False: "below", None: ""}[total.above],
             f"like {total.starts}" if total.starts else "", f"not like {total.starts_not}" if total.starts_not else ""]
    return "sum " + " ".join(p for p in parts if p)


def with_totals(statements: DataFrame, transactions: DataFrame, sums: list[RowSum]) -> DataFrame:
    """Statements with the row sums their checks need, all from one aggregation; one without rows keeps zeros."""
    columns, summed = {}, F.lit(False)
    for total in sums:
        condition = F.lit(True)
        if total.kinds:
            condition &= F.col("kind").isin(*total.kinds)
        if total.above is not None:
            condition &= F.col("amount") > 0 if total.above else F.col("amount") < 0
        if total.starts:
            condition &= F.col("description").startswith(total.starts)
        if total.starts_not:
            condition &= ~F.col("description").startswith(total.starts_not)
        summed |= condition
        columns[_name(total)] = F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0)).cast(MONEY)
    if not columns:
        return statements
    joined = statements.join(transactions.where(summed).groupBy("stmt_id").agg(*[c.alias(n) for n, c in columns.items()]), "stmt_id", "left")
    return joined.fillna(0, list(columns))


def printed(key: str) -> Column:
    return F.try_element_at("summary", F.lit(key))


def total_of(total: Total) -> Column:
    """The value a check compares; null when a printed part it needs is missing."""
    values = [printed(k) for k in total.printed]
    if total.some:
        whole = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in values])
        values = [F.when(F.coalesce(*values).isNotNull(), whole)]
    rows = [F.col(f"`{_name(r)}`") * total.sign for r in total.rows]
    return reduce(lambda a, b: a + b, [*values, *rows])


def _emit(checks: list[tuple[str, Column, Column]], condition: Column, tolerance: float) -> Column:
    return F.array_compact(F.array(*[
        F.when(condition & expected.isNotNull() & actual.isNotNull(), F.struct(
            F.lit(name).alias("name"), expected.cast(MONEY).alias("expected"), actual.cast(MONEY).alias("actual"),
            F.lit(tolerance).alias("tolerance")))
        for name, expected, actual in checks]))


def with_outcome(checks: DataFrame) -> DataFrame:
    delta = (F.col("actual") - F.col("expected")).cast(MONEY)
    return checks.withColumns({"delta": delta, "ok": F.abs(delta) <= F.col("tolerance")})


def total_checks(statements: DataFrame, transactions: DataFrame, names: list[str] | None = None,
                 layouts: list[str] | None = None, tolerance: float = TOLERANCE, specs: tuple[Layout, ...] = SHIPPED) -> DataFrame:
    """All sum checks that the layouts declare, or the named ones: one aggregation, one join, one explode."""
    wanted = {spec.name: [c for c in spec.checks if names is None or c.name in names]
              for spec in specs if layouts is None or spec.name in layouts}
    sums = list(dict.fromkeys(r for checks in wanted.values() for c in checks for t in (c.expected, c.actual) for r in t.rows))
    checked = statements.where(F.col("layout_name").isin([name for name, checks in wanted.items() if checks]))
    totals = with_totals(checked, transactions, sums)
    arrays = [_emit([(c.name, total_of(c.expected), total_of(c.actual)) for c in checks], F.col("layout_name") == name, tolerance)
              for name, checks in wanted.items() if checks]
    kind = f"array<struct<name:string,expected:{MONEY},actual:{MONEY},tolerance:double>>"
    every = F.concat(*arrays) if arrays else F.array().cast(kind)
    return with_outcome(totals.select("stmt_id", F.explode(every).alias("c")).select("stmt_id", "c.*"))


def ending_balance(statements, transactions, tolerance=TOLERANCE):
    return total_checks(statements, transactions, ["ending_balance"], tolerance=tolerance)


def deposits_total(statements, transactions, tolerance=TOLERANCE):
    return total_checks(statements, transactions, ["deposits_total"], tolerance=tolerance)


def withdrawals_total(statements, transactions, tolerance=TOLERANCE):
    return total_checks(statements, transactions, ["withdrawals_total", "subtractions_total"],
                        ["chase_checking", "boa_checking"], tolerance)


def bucket_totals(statements, transactions, tolerance=TOLERANCE):
    return total_checks(statements, transactions,
                        ["purchases_total", "payments_total", "cash_advances_total", "fees_total", "interest_total"],
                        tolerance=tolerance)


def new_balance(statements, transactions, tolerance=TOLERANCE):
    return total_checks(statements, transactions, ["new_balance"], tolerance=tolerance)


def page_agreement(statements, transactions, tolerance=TOLERANCE):
    """Printed summary against a subtotal printed elsewhere: rows are not needed."""
    none = transactions.where(F.lit(False))
    names = ["fees_page_agrees", "interest_page_agrees",
             *[f"summary_agrees_{s}" for s in V.SEC_SECTIONS.values()]]
    return total_checks(statements, none, names, tolerance=tolerance)


def paper_check_totals(statements, transactions, tolerance=TOLERANCE):
    return total_checks(statements, transactions,
                        ["checks_total", "other_withdrawals_total", "withdrawals_total"],
                        ["wellsfargo_checking"], tolerance)


def running_balance_breaks(statements: DataFrame, transactions: DataFrame, *, segments: list[str],
                           order: list[str], step: float = TOLERANCE, specs: tuple[Layout, ...] = SHIPPED) -> DataFrame:
    """Rows whose walked balance differs from the printed one, counted per statement.

    Walking resyncs to the printed balance after a break, so whether a row breaks depends only on
    the last printed balance before it and the amounts since: one wrong amount is one break, one
    wrong printed balance is two.
    """
    opening = statements.where(printed("beginning_balance").isNotNull() & F.col("layout_name").isin([x.name for x in specs if x.walks_balance])).select(
        "stmt_id", printed("beginning_balance").alias("opening"))
    rows = transactions.select("stmt_id", *segments, *order, "amount", "balance")
    walked = materialize(ordered_scan(rows, ["stmt_id"], segments, order, sums={"walked": F.col("amount")}), "walk")
    anchored = ordered_scan(walked.withColumn("gap", F.col("balance") - F.col("walked")),
                            ["stmt_id"], segments, order, seen_before={"offset": F.col("gap")})
    broken = F.abs(F.coalesce(F.col("offset"), F.col("opening")) - F.col("gap")) > step
    counted = anchored.join(opening, "stmt_id").groupBy("stmt_id").agg(F.count_if(broken).alias("breaks"))
    rows = opening.join(counted, "stmt_id", "left").select(
        "stmt_id", F.lit("running_balance_breaks").alias("name"), F.lit(0).cast(MONEY).alias("expected"),
        F.coalesce("breaks", F.lit(0)).cast(MONEY).alias("actual"), F.lit(0.0).alias("tolerance"))
    return with_outcome(rows)


def statement_ok(statements: DataFrame, checks: DataFrame) -> DataFrame:
    """All checks pass; true when there is none, with the number of checks beside it."""
    verdict = checks.groupBy("stmt_id").agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("check_count"))
    return statements.select("stmt_id").join(verdict, "stmt_id", "left").select(
        "stmt_id", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("check_count", F.lit(0)).alias("check_count"))
