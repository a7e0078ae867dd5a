"""What large tables need: tables dealt out by rows, texts searched only where they can match, rows published once."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators import extract as P
from ledgerloom.operators import scan
from ledgerloom.operators.classify import classify_texts
from ledgerloom.operators.scan import key_sizes, ordered_scan
from ledgerloom.plans import render as RD
from ledgerloom.plans import testview as T
from ledgerloom.storage import dealt


def test_large_frames_are_dealt_out_by_rows(spark):
    rows = spark.range(1000)
    assert dealt(rows, "id", rows=100).rdd.getNumPartitions() == 10
    assert dealt(rows, "id", rows=1000) is rows


def test_period_over_the_end_of_a_block_and_a_page_without_one(spark):
    lines = [("a", 1, 511, "March 01, 2025"), ("a", 1, 512, "through March 31, 2025"), ("a", 1, 513, "Account Number: 1234"),
             ("b", 1, 1, "May 01, 2025 through May 31, 2025"), ("c", 1, 1, "nothing"), ("c", 2, 2, None)]
    lines = spark.createDataFrame(lines, "stmt_id string, page_no int, line_no int, text string")
    got = {r.stmt_id: (r.period_start, r.period_end, r.account_last4) for r in P.header_fields(lines, P.SPECS["chase_checking"]).collect()}
    assert got == {"a": (dt.date(2025, 3, 1), dt.date(2025, 3, 31), "1234"), "b": (dt.date(2025, 5, 1), dt.date(2025, 5, 31), "????"),
                   "c": (None, None, "????")}


def test_only_texts_that_end_in_a_state_are_searched_for_a_city(spark):
    texts = ["PLUM SHOP HOUSTON TX", "PLUM SHOP HOUSTON TX \n", "PLUM SHOP HOUSTON TX\u2028", "PLUM SHOP HOUSTON TX 5", "PLUM TX HOUSTON ZZ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = [r.n for r in X.with_city_state_stripped(df.coalesce(1), "t", "n").collect()]
    assert names == ["PLUM SHOP", "PLUM SHOP", "PLUM\u2028 SHOP", texts[3], texts[4], "", None]


def test_settled_texts_skip_the_costly_steps(spark):
    df = spark.createDataFrame([("NETFLIX", "credit", k) for k in ("fee", "payment", "purchase", "credit", None)] + [("NETFLIX", "checking", "deposit")],
                               "text string, account string, kind string")
    planned = classify_texts(df)
    got = {r.kind: (r.merchant, r.category) for r in planned.collect()}
    assert got == {"fee": ("Chase card fee", "Fees & Interest"), "payment": ("Chase card payment", "Transfers"), "purchase": ("Netflix", "Subscriptions"),
                   "credit": ("Netflix", "Refunds"), None: ("Netflix", "Subscriptions"), "deposit": ("Netflix", "Reimbursements")}
    assert "open_subject" in planned._jdf.queryExecution().toString()


def test_rows_are_published_once(spark):
    folder = "/root/testdata/sf0.001"
    assert T.transactions(spark, folder) is T.transactions(spark, folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_keys_are_scanned_by_plain_windows(spark, monkeypatch):
    """Every scan shuffled its rows twice and its summary thrice, however short the documents were."""
    rng = random.Random(4)
    rows = [(k, i // 4, i, rng.randint(-9, 9), rng.choice([None, i])) for k in "abc" for i in range(23)]
    df = spark.createDataFrame(rows, "k string, seg int, i int, v int, mark int")

    def scanned(sizes):
        return ordered_scan(df, ["k"], ["seg"], ["i"], sums={"total": F.col("v")}, previous={"prior": F.col("v")}, last_seen={"seen": F.col("mark")},
                            seen_before={"before": F.col("mark")}, preceding={"above": (F.col("mark"), 5)}, following={"below": (F.col("v"), 3)}, sizes=sizes)

    assert key_sizes(df, ["k"]) == (23, 69) and key_sizes(df.limit(0), ["k"]) == (0, 0)
    short, long = scanned((23, 69)), scanned(None)
    assert sorted(map(tuple, short.select(long.columns).collect()), key=repr) == sorted(map(tuple, long.collect()), key=repr)
    assert plan_of(short).count("Exchange ") == 1 and "Join" not in plan_of(short)
    again = ordered_scan(short.where("v > 0"), ["k"], ["seg"], ["i"], sums={"n": F.lit(1)}, sizes=(23, 69))
    assert plan_of(again).count("Exchange ") == 1
    monkeypatch.setattr(scan, "LONG_KEY", 22)
    assert "Join" in plan_of(scanned((23, 69)))
    odd = spark.createDataFrame([(None, 1, 1)], "k string, seg int, i int")
    with pytest.raises(Exception, match="null in"):
        ordered_scan(odd, ["k"], ["seg"], ["i"], sums={"n": F.lit(1)}, sizes=(1, 1)).collect()


@pytest.mark.parametrize("most", [3, 50_000])
def test_long_and_short_documents_are_read_alike(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "LONG_KEY", most)
    monkeypatch.setattr(P, "BLOCK_LINES", 4)
    run = ["March 01, 2025", "through March 31, 2025", "Account Number: 1234", "TRANSACTION DETAIL", V.RUN_TABLE_HEADER.strip("^$"), "03/02 One", "two", "-1.00 9.00",
           "03/03 Three -2.00 7.00", "03/04 No amount here", "03/05 Five", "-1.00 6.00", "See reverse side"]
    lines = spark.createDataFrame([("a", 1, k + 1, t) for k, t in enumerate(run)], "stmt_id string, page_no int, line_no int, text string")
    spec = P.SPECS["chase_checking"]
    periods = P.extract_period(lines, spec)
    assert [(r.period_start, r.period_end) for r in periods.collect()] == [(dt.date(2025, 3, 1), dt.date(2025, 3, 31))]
    got = sorted((r.source_line, r.outcome, r.description, r.text) for r in P.parse_layout(lines, spec, periods).collect())
    assert [(r[0], r[1]) for r in got] == [(6, "row"), (9, "row"), (10, "unparsed"), (11, "row"), (13, "unparsed")] and got[0][2] == "One two"


def test_text_is_rendered_without_the_classification(spark, monkeypatch):
    """Rendering read the classified ledger, of which it prints nothing, and read its rows once for each layout."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(T, "ledger", None)
    monkeypatch.setattr(RD, "_rendered", {})
    rows = RD._rows(spark, folder)
    assert "merchant" not in rows.columns
    printed = rows.where("checks is not null").selectExpr("stmt_id", "checks").collect()
    single = rows.where("own_check is not null").count()
    assert sum(len(re.findall(r"\d\d/\d\d", r.checks)) for r in printed) == single > len(printed) or single == len(printed)
    assert RD.lines(spark, folder).where("layout_name = 'wellsfargo_checking'").count() > 0
    assert RD.layout_lines(spark, folder).count() > 0
