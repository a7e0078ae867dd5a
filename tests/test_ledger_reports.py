"""Reconciliation, continuity, recurrence and reports on small hand-made rows."""

import datetime as dt
import statistics
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import continuity as N
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import spend as S
from ledgerloom.operators import timeseries as W

DAY = dt.date


def statement(stmt_id, start, end, summary, layout="chase_checking", account="checking", last4="0001"):
    return (stmt_id, layout, account, last4, start, end, {k: M(v) for k, v in summary.items()})


def statements(spark, *rows):
    return spark.createDataFrame(list(rows), "stmt_id string, layout_name string, account string, account_last4 string, "
                                 "period_start date, period_end date, summary map<string,decimal(18,2)>")


def ledger(spark, *rows):
    """(stmt_id, line, amount, balance)"""
    return spark.createDataFrame([(s, i, M(a), None if b is None else M(b), "deposit" if float(a) > 0 else "withdrawal", "d", M(a)) for s, i, a, b in rows],
                                 "stmt_id string, line int, amount decimal(18,2), balance decimal(18,2), kind string, description string, signed decimal(18,2)"
                                 ).withColumn("page", F.floor(F.col("line") / 2))


def breaks(spark, balances, amounts=("10", "-4", "1", "2", "-9")):
    st = statements(spark, statement("s", DAY(2025, 1, 1), DAY(2025, 1, 31), {"beginning_balance": "100"}))
    rows = ledger(spark, *[("s", i, a, b) for i, (a, b) in enumerate(zip(amounts, balances))])
    return R.running_balance_breaks(st, rows, segments=["page"], order=["line"]).first()["actual"]


def test_running_balance_resyncs(spark):
    good = ["110", "106", "107", "109", "100"]
    assert breaks(spark, good) == 0
    assert breaks(spark, good, ("10", "-5", "1", "2", "-9")) == 1          # one wrong amount
    assert breaks(spark, ["110", "106", "117", "109", "100"]) == 2          # one wrong printed balance
    assert breaks(spark, ["110", None, "107", None, "100"]) == 0            # unprinted balances are walked over
    assert breaks(spark, [None, None, None, None, "101"]) == 1
    st = statements(spark, statement("e", DAY(2025, 1, 1), DAY(2025, 1, 31), {"beginning_balance": "100"}))
    empty = R.running_balance_breaks(st, ledger(spark, ("x", 1, "1", None)), segments=["page"], order=["line"]).first()
    assert (empty["stmt_id"], empty["actual"], empty["ok"]) == ("e", 0, True)


def test_checks_exist_only_with_their_printed_inputs(spark):
    st = statements(spark,
                    statement("zero", DAY(2025, 1, 1), DAY(2025, 1, 31), {"beginning_balance": "160", "ending_balance": "160"}, "boa_checking"),
                    statement("bare", DAY(2025, 1, 1), DAY(2025, 1, 31), {}, "boa_checking"),
                    statement("bad", DAY(2025, 1, 1), DAY(2025, 1, 31), {"deposits": "999", "total_deposits": "10", "total_checks": "-4"}, "boa_checking"))
    got = R.total_checks(st, ledger(spark, ("bad", 1, "10", None), ("bad", 2, "-4", None)))
    assert {(r["stmt_id"], r["name"]): r["ok"] for r in got.collect()} == {
        ("zero", "ending_balance"): True, ("bad", "deposits_total"): True, ("bad", "subtractions_total"): True, ("bad", "summary_agrees_deposits"): False}
    ok = {r["stmt_id"]: (r["ok"], r["check_count"]) for r in R.statement_ok(st, got).collect()}
    assert ok == {"zero": (True, 1), "bare": (True, 0), "bad": (False, 3)}


def test_continuity(spark):
    months = [(DAY(2025, 1, 1), DAY(2025, 1, 31)), (DAY(2025, 2, 1), DAY(2025, 2, 28)), (DAY(2025, 2, 28), DAY(2025, 3, 31)), (DAY(2025, 4, 6), DAY(2025, 4, 30))]
    balances = [("100", "110"), ("110", "90"), ("95", "80"), ("80", "85")]
    st = statements(spark, *[statement(f"s{i}", *m, {"beginning_balance": b, "ending_balance": e}) for i, (m, (b, e)) in enumerate(zip(months, balances))])
    assert {r["stmt_id"]: r["days"] for r in N.period_gaps(st).collect()} == {"s2": -1, "s3": 5}
    assert {r["stmt_id"]: (r["prior_close"], r["opening_balance"]) for r in N.balance_chain(st).collect()} == {"s2": (M("90.00"), M("95.00"))}
    found = N.continuity(st, ledger(spark, ("s0", 1, "-15", None))).collect()
    assert sorted(r["kind"] for r in found) == ["balance_chain", "period_gap", "period_gap"]
    assert any("+5 days between" in r["detail"] for r in found)
    assert [r["kind"] for r in N.continuity(st, ledger(spark, ("s0", 1, "-16", None))).collect()].count("net_position") == 1


def test_card_payment_nets_to_zero_and_missing_balance_voids_the_check(spark):
    chk = statement("c", DAY(2025, 1, 1), DAY(2025, 1, 31), {"beginning_balance": "100", "ending_balance": "60"})
    card = statement("k", DAY(2025, 1, 1), DAY(2025, 1, 31), {"previous_balance": "40", "new_balance": "0"}, "chase_credit", "credit")
    rows = ledger(spark, ("c", 1, "-40", None), ("k", 2, "40", None))
    net = N.net_position(statements(spark, chk, card), rows).first()
    assert (net["expected"], net["actual"], net["ok"], net["complete"]) == (M("0.00"), M("0.00"), True, True)
    void = statement("v", DAY(2025, 1, 1), DAY(2025, 1, 31), {"beginning_balance": "1"}, last4="0002")
    net = N.net_position(statements(spark, chk, card, void), ledger(spark, ("c", 1, "-41", None))).first()
    assert (net["complete"], net["ok"]) == (False, True)
    with pytest.raises(ValueError):
        N.polarity_by_kind([("a", "", "checking", 1), ("b", "", "checking", -1)])


def charges(spark, **series):
    rows = [(m, d, -float(a), "Utilities", i) for m, items in series.items() for i, (d, a) in enumerate(items)]
    return spark.createDataFrame(rows, "merchant string, date date, signed double, category string, txn_id int").withColumn(
        "signed", F.col("signed").cast("decimal(18,2)"))


def monthly(amounts, start=1, year=2025):
    return [(DAY(year + (start + i - 1) // 12, (start + i - 1) % 12 + 1, 15), a) for i, a in enumerate(amounts)]


def test_recurring(spark):
    rise = monthly([120.83, 120.83, 120.83, 276.91, 276.91])
    missed = monthly([10] * 4) + monthly([10] * 4, start=6)
    twice = monthly([10] * 5) + [(DAY(2025, 3, 15), 12)]
    ended = monthly([20] * 5, year=2024)
    irregular = [(DAY(2025, 1, 3), 22), (DAY(2025, 1, 19), 31), (DAY(2025, 3, 2), 18), (DAY(2025, 6, 14), 44)]
    swing = monthly([1, 100, 1, 100, 1])
    df = charges(spark, rise=rise, missed=missed, twice=twice, ended=ended, irregular=irregular, swing=swing, few=monthly([5] * 3),
                 shuffled=list(reversed(monthly([50, 60, 90, 95]))))
    found = {r["merchant"]: r for r in W.find_recurring(df, "2025-06-01").collect()}
    assert set(found) == {"rise", "missed", "twice", "ended", "shuffled"}
    r = found["rise"]
    assert (r["first_amount"], r["last_amount"], r["typical"], r["cadence"], r["active"]) == (M("120.83"), M("276.91"), 120.83, "monthly", True)
    assert (found["shuffled"]["first_amount"], found["shuffled"]["last_amount"]) == (M("50.00"), M("95.00"))
    assert (found["twice"]["row_count"], found["twice"]["total"]) == (6, M("62.00"))
    gap = statistics.median([31, 29, 31, 30])
    stale = (DAY(2025, 6, 1) - DAY(2024, 5, 15)).days
    assert (found["ended"]["active"], found["ended"]["missed"]) == (False, int(stale // gap))
    assert [r["merchant"] for r in W.price_drift(W.find_recurring(df, "2025-06-01")).orderBy("merchant").collect()] == ["rise", "shuffled"]
    status = W.recurring_status(W.find_recurring(df, "2025-06-01")).first()
    assert (status["live"], status["ended"]) == (4, 1)


@pytest.fixture(scope="module")
def book(spark):
    rows = [  # date, merchant, category, account, kind, signed
        ("2024-12-05", "Pay", "Income", "checking", "deposit", 100), ("2025-01-05", "Shop", "Shopping", "credit", "purchase", -30),
        ("2025-01-06", "Shop", "Refunds", "credit", "credit", 5), ("2025-02-05", "Fee", "Fees & Interest", "credit", "fee", -7),
        ("2025-02-06", "Card", "Transfers", "checking", "withdrawal", -20), ("2025-02-06", "Card", "Transfers", "credit", "payment", 20),
        ("2025-03-01", "X", "uncategorized", "checking", "withdrawal", -50), ("2025-03-02", "Pay", "Income", "checking", "deposit", 10),
        ("2025-04-02", "X", "uncategorized", "checking", "withdrawal", -60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "txn_id int, date string, merchant string, category string, account string, kind string, signed int")
    return df.withColumns({"date": F.to_date("date"), "month": F.substring("date", 1, 7), "signed": F.col("signed").cast("decimal(18,2)"),
                           "amount": F.when(F.col("account") == "credit", -F.col("signed")).otherwise(F.col("signed")).cast("decimal(18,2)"),
                           "description": F.lit("raw"), "descriptor": F.lit("")})


def test_reports(book):
    assert {r["category"]: float(r["spend"]) for r in S.spend_by_category(book).collect()} == {
        "TOTAL": 147.0, "uncategorized": 110.0, "Shopping": 30.0, "Fees & Interest": 7.0}
    flow = {r["month"]: (float(r["money_in"]), float(r["money_out"])) for r in S.cashflow_monthly(book).collect()}
    assert flow == {"2024-12": (100, 0), "2025-01": (5, 30), "2025-02": (0, 7), "2025-03": (10, 50), "2025-04": (0, 60)}
    assert W.longest_streak(S.cashflow_monthly(book)).first()["streak"] == 4
    assert float(S.transfers_net(book).first()["transfers_net"]) == 0
    closed = S.books_close(book).first()
    assert closed["ok"] and float(closed["actual"]) == -32


def test_periods(book):
    months = S.spend_months(book)
    names = lambda df: sorted(r["month"] for r in df.collect())
    assert names(S.period_months(months, 2)) == ["2025-03", "2025-04"]
    assert names(S.period_months(months, "2025")) == ["2025-01", "2025-02", "2025-03", "2025-04"]
    assert names(S.period_months(months, ("2025-02-20", "2025-03-01"))) == ["2025-02", "2025-03"]
    assert len(names(S.period_months(months, ("2025-03-01", "2025-02-20")))) == 4
    assert names(S.prior_window(months, S.period_months(months, 2))) == ["2025-01", "2025-02"]
    assert names(S.prior_window(months, S.period_months(months, 3))) == []
    assert sorted(r["month"] for r in S.with_partial_flag(months).where("partial").collect()) == ["2025-01", "2025-04"]


def test_no_spend_is_no_division_by_zero(book):
    none = book.where("category = 'Income'")
    assert S.category_coverage(none).first()["share"] is None
    assert S.spend_by_category(none).collect() == []


def test_search_and_grid(book):
    got = S.search(book, "SHOP", 1).collect()
    assert [(r["txn_id"], r["matched"]) for r in got] == [(2, 2)]
    grid = {(r["month"], r["bucket"]): float(r["spend"]) for r in S.monthly_category_grid(book, 1).collect()}
    assert grid == {("2025-01", "uncategorized"): 0, ("2025-01", "Other"): 30, ("2025-02", "uncategorized"): 0, ("2025-02", "Other"): 7,
                    ("2025-03", "uncategorized"): 50, ("2025-03", "Other"): 0, ("2025-04", "uncategorized"): 60, ("2025-04", "Other"): 0}
