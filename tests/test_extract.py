"""Detection and extraction on invented lines of all four layouts, and the whole way to checks."""

import datetime as dt
import os
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import detect as D
from ledgerloom.operators import extract as P
from ledgerloom.operators import layouts as L
from ledgerloom.plans.proving import prove
from ledgerloom.sources.lines import explode_lines
from ledgerloom.storage import checkpoint_root

LONG = "An advertisement that runs on and on and on and is far too long to be the rest of any description above it."
RUNNING = ["JPMorgan Chase Bank, N.A.", "March 01, 2025 through March 31, 2025", "Account Number: 000000001234",
           "CHECKING SUMMARY Chase Total Checking", "Beginning Balance $1,000.00", "Deposits and Additions 50.00",
           "ATM & Debit Card Withdrawals -12.40", "Electronic Withdrawals -500.00", "Ending Balance $9.99", "TRANSACTION DETAIL", "",
           "DATE DESCRIPTION AMOUNT BALANCE", "Beginning Balance $1,000.00",
           "03/14 Card Purchase 03/13 Plum Cafe TX Card 0000 -12.40 987.60", "03/15 Wire Via Bank", "Ref: Something", "-500.00 487.60",
           "Page 2", "03/16 No amount here", "03/17 Deposit 50.00 537.60", "Ending Balance $537.60", "03/18 Not a row any more -1.00 1.00"]
CARD = ["ACCOUNT SUMMARY", "Account Number: XXXX XXXX XXXX 9876", "Previous Balance $100.00", "Payment, Credits -$60.00",
        "Purchases +$30.00", "Cash Advances $0.00", "Fees Charged +$5.00", "Interest Charged +$0.18", "New Balance $75.18",
        "Opening/Closing Date 12/03/24 - 01/02/25", "12/30 AUTOMATIC PAYMENT -50.00", "12/31 PLUM SHOP ANYTOWN TX -10.00", "01/01 PEAR SHOP 30.00",
        "01/01 LATE FEE 5.00", "01/02 PURCHASE INTEREST CHARGE .18", "06/15 TOO FAR AWAY 1.00", "TOTAL FEES FOR THIS PERIOD $5.00",
        "TOTAL INTEREST FOR THIS PERIOD $0.18"]
SECTIONED = ["bankofamerica.com", "for June 16, 2026 to July 17, 2026 Account number: 0000 0000 4321", "Account summary",
             "Beginning balance on June 16, 2026 $1,000.00", "Deposits and other additions 100.00", "Other subtractions -47.00",
             "Ending balance on July 17, 2026 $1,053.00", "not in a section", "Deposits and other additions", "Date Description Amount",
             "06/18/26 PLUM CO DES:PAYROLL ID:410 CO ID:1 100.00", "PPD", "Total deposits and other additions $100.00",
             "Withdrawals and other subtractions", "in the banner only", "Other subtractions", "06/20/26 CHECKCARD 0618 PLUM SHOP HOUSTON TX 755555555555555555 -7.00", "WEB", LONG,
             "continued on the next page", "between sections", "Other subtractions - continued", "an orphan", "06/21/26 PEAR SHOP -40.00",
             "Total other subtractions -$47.00"]
ANCHORED = ["Statement Date: January 3, 2026", "WELLS FARGO BANK, N.A.", "Account Number: 111-2222222", "Activity summary", "Balance on 12/05 $500.00",
            "Deposits and interest 31.20", "Activity detail", "Deposits and interest", "Date Description Amount", "." * 60, "12/29 Deposit $31.20",
            "Total deposits and interest $31.20", "Checks", "1001 12/08 10.00 1002* 01/02 20.00", "Total checks $30.00", "Other withdrawals",
            "12/30 Plum Insurance Co.", "Monthly 40.76", "12/31 Orphan without amount", "01/02 Plum Shop 5.00", "Total other withdrawals $45.76",
            "Total withdrawals $75.76", "Daily balance summary", "Balance on 01/03 $455.44"]
DOCS = {"run": RUNNING, "card": CARD, "sec": SECTIONED, "anc": ANCHORED, "other": ["Some other bank", "Balance $1.00"], "blank": [" ", ""]}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, 1, "\n".join(v)) for k, v in DOCS.items()], "stmt_id string, page_no int, text string")


@pytest.fixture(scope="module")
def proved(pages):
    return prove(pages)


def test_detection(proved):
    got = {r["stmt_id"]: r for r in proved.detections.collect()}
    assert {k: r["layout_name"] for k, r in got.items()} == {
        "run": "chase_checking", "card": "chase_credit", "sec": "boa_checking", "anc": "wellsfargo_checking", "other": None, "blank": None}
    assert got["run"]["score"] == 4 and got["anc"]["score"] == 4
    assert "none of the known layouts" in got["other"]["error"] and all(l[1] in got["other"]["error"] for l in V.LAYOUTS)
    assert "hold no text" in got["blank"]["error"]


def test_layouts_reject_each_other(spark, pages):
    own = {"run": "chase_checking", "card": "chase_credit", "sec": "boa_checking", "anc": "wellsfargo_checking"}
    for r in D.score_formats(pages, "stmt_id", "text").collect():
        assert (r["score"] > 0) == (own.get(r["stmt_id"]) == r["name"]), r


def test_only_opening_pages_count(spark):
    pages = spark.createDataFrame([("a", n, "CHECKING SUMMARY" if n == at else "x") for at, d in ((3, "a"), (4, "b")) for n in range(1, 6) if d == "a"]
                                  + [("b", n, "CHECKING SUMMARY" if n == 4 else "x") for n in range(1, 6)], "stmt_id string, page_no int, text string")
    got = {r["stmt_id"]: r["layout_name"] for r in D.detect(pages.where("not (stmt_id = 'a' and page_no > 3 and text <> 'x')")).collect()}
    assert got["a"] == "chase_checking" and got["b"] is None


def test_ties_keep_registry_order_and_name_runners_up(spark):
    registry = [("one", "One", "k", 1, ["X"], ["m"]), ("two", "Two", "k", 1, ["Y"], ["n"]), ("three", "Three", "k", 1, ["Z"], [])]
    docs = spark.createDataFrame([("a", "X Y", 1), ("b", "Y n X", 1)], "stmt_id string, text string, page_no int")
    got = {r["stmt_id"]: (r["layout_name"], r["runners_up"]) for r in D.detect(docs, layouts=registry).collect()}
    assert got == {"a": ("one", ["Two"]), "b": ("two", ["One"])}


def test_marks_of_many_layouts_and_pages_without_a_number(spark):
    registry = [(f"l{i}", f"Layout {i}", "k", 1, [f"<need {i}>"], [f"<mark {i}.{j}>" for j in range(5)]) for i in range(40)]
    pages = spark.createDataFrame([("a", 1, "<need 7> <mark 7.1>"), ("a", 2, "<mark 7.4>"), ("a", 4, "<mark 7.2>"), ("b", None, "<need 3>"),
                                   ("c", 1, "<need 39>"), ("c", 2, None), ("d", 1, " \n")], "stmt_id string, page_no int, text string")
    got = {r["stmt_id"]: (r["layout_name"], r["score"], (r["error"] or "")[:20]) for r in D.detect(pages, layouts=registry).collect()}
    assert got == {"a": ("l7", 3, ""), "b": (None, 0, "the document is empt"), "c": ("l39", 1, ""), "d": (None, 0, "the first 3 pages ho")}
    plan = D.detect(pages, layouts=registry)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


#: A bank this library does not ship, declared as a value only.
GLOBE = L.Layout(
    name="globe_savings", label="Globe savings", account="checking", polarity=1, required=("GLOBE SAVINGS",), markers=("Ledger", "Iban"),
    period=L.Period(r"Period:\s+(\d{2}/\d{2}/\d{2})\s+to\s+(\d{2}/\d{2}/\d{2})", "short"), account_number=r"Iban ([\d ]+)",
    summary={"ending_balance": r"^Closing ([-\d,.]+)$", "total_in": r"^Money in ([-\d,.]+)$"},
    table_summary={"beginning_balance": r"^Brought forward ([-\d,.]+)$"},
    rows=(L.Rows(r"^(\d{2})/(\d{2}) (.+?) ([-\d,]+\.\d{2}) ([-\d,]+\.\d{2})$", ("mm", "dd", "description", "amount", "balance"), "wrapped",
                 table=(r"^Ledger$", r"^Carried forward"), skip=r"^Brought forward", noise=r"^Sheet \d+$"),
          L.Rows(r"^Levy (\d{2})/(\d{2}) (.+) ([-\d,]+\.\d{2})$", ("mm", "dd", "description", "amount"), kind="fee", sign=-1)),
    checks=(L.CLOSES, L.Check("money_in", L.printed("total_in"), L.summed(L.POSITIVE)),
            L.Check("levies", L.printed("ending_balance"), L.summed(L.RowSum(kinds=("fee",)), plus=("ending_balance",)))))
GLOBE_TEXT = ["GLOBE SAVINGS", "Iban 00 11 22 7788", "Period: 02/01/25", "to 02/28/25", "Money in 30.00", "Closing 112.50", "Ledger",
              "Brought forward 100.00", "02/03 Plum", "Shop", "-15.00 85.00", "Sheet 2", "02/04 Pear pay 30.00 115.00", "02/05 lost", "Carried forward 115.00",
              "02/06 not in the ledger 1.00 1.00", "Levy 02/28 yearly 2.50"]


def test_a_fifth_layout_is_a_value(spark):
    pages = spark.createDataFrame([("g", 1, "\n".join(GLOBE_TEXT)), ("run", 1, "\n".join(RUNNING))], "stmt_id string, page_no int, text string")
    got = prove(pages, layouts=(*L.SHIPPED, GLOBE))
    assert {r["stmt_id"]: r["layout_name"] for r in got.detections.collect()} == {"g": "globe_savings", "run": "chase_checking"}
    rows = sorted((r["description"], str(r["date"]), r["amount"], r["kind"], r["balance"]) for r in got.transactions.where("stmt_id = 'g'").collect())
    assert rows == [("Pear pay", "2025-02-04", M("30.00"), "deposit", M("115.00")), ("Plum Shop", "2025-02-03", M("-15.00"), "withdrawal", M("85.00")),
                    ("yearly", "2025-02-28", M("-2.50"), "fee", None)]
    head = got.statements.where("stmt_id = 'g'").first()
    assert (head["account_last4"], str(head["period_start"]), str(head["period_end"])) == ("7788", "2025-02-01", "2025-02-28")
    checks = {r["name"]: (r["ok"], r["delta"]) for r in got.checks.where("stmt_id = 'g'").collect()}
    assert checks == {"ending_balance": (True, M("0.00")), "money_in": (True, M("0.00")), "levies": (False, M("-2.50"))}
    assert [r["text"] for r in got.unparsed.where("stmt_id = 'g'").collect()] == ["02/05 lost"]
    assert got.transactions.where("stmt_id = 'run'").count() == 3
    got.close()


def test_a_layout_with_an_unknown_shape_is_refused(spark):
    import dataclasses
    bad = dataclasses.replace(GLOBE, rows=(dataclasses.replace(GLOBE.rows[1], shape="sideways"),))
    pages = spark.createDataFrame([("g", 1, "\n".join(GLOBE_TEXT))], "stmt_id string, page_no int, text string")
    with pytest.raises(ValueError, match="sideways"):
        prove(pages, layouts=(bad,))


def test_phrases_over_line_and_block_ends(spark):
    """A period printed over two lines that lie in different blocks of lines, below 2,000 lines of other text."""
    above = [f"line {i}" for i in range(P.BLOCK_LINES * 4 - 1)]
    texts = {"a": [*above, "for June 16, 2026 to", "July 17, 2026"], "b": [*above, "March 01, 2025", "", "", "through", "March 31, 2025"]}
    lines = explode_lines(spark.createDataFrame([(k, 1, "\n".join(v)) for k, v in texts.items()], "stmt_id string, page_no int, text string"))
    sec = P.extract_period(lines.where("stmt_id = 'a'"), P.SPECS["boa_checking"]).first()
    assert sec["period_start"] is None  # this layout's pattern has single blanks between the words
    run = P.extract_period(lines.where("stmt_id = 'b'"), P.SPECS["chase_checking"]).first()
    assert (str(run["period_start"]), str(run["period_end"])) == ("2025-03-01", "2025-03-31")


def test_one_very_long_document_without_page_marks(spark):
    """200,000 lines on one page: rows, state and joined texts come from blocks of lines, and no value holds a page."""
    n = 40_000
    body = []
    for i in range(n):
        body += [f"03/14 Wire {i}", "over two", f"lines {i} -1.00 {n - i}.00", "Page 2", f"03/15 whole {i} 1.00 {n - i + 1}.00"]
    text = "\n".join(RUNNING[:12] + body + ["Ending Balance $1,000.00"])
    lines = explode_lines(spark.createDataFrame([("big", 1, text)], "stmt_id string, page_no int, text string"))
    spec = P.SPECS["chase_checking"]
    periods = P.extract_period(lines, spec)
    got = P.parse_layout(lines, spec, periods).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("amount").alias("s"),
                                                                      F.max(F.length("text")).alias("longest"))
    assert {r["outcome"]: (r["n"], r["s"]) for r in got.collect()} == {"row": (2 * n, M("0.00"))}
    plan = P.assemble_wrapped_rows(lines, V.RUN_ROW, V.RUN_NOISE, F.lit(False))._jdf.queryExecution().optimizedPlan().toString()
    assert "line_block" in plan


def test_sections_and_texts_of_one_very_long_page(spark):
    """100,000 short lines below one row, and a section that is open over 200 blocks."""
    head = ["Other subtractions", "06/20/26 PLUM SHOP -7.00"]
    lines = explode_lines(spark.createDataFrame([("s", 1, "\n".join(head + ["x"] * 100_000 + ["Total other subtractions -$7.00", "y"]))],
                                                "stmt_id string, page_no int, text string"))
    spec = P.SPECS["boa_checking"]
    row = P.parse_layout(lines, spec, P.extract_period(lines, spec)).collect()
    assert len(row) == 1 and row[0]["description"] == "PLUM SHOP " + " ".join(["x"] * 100_000)
    cards = spark.createDataFrame([("c", 1, 1, "PURCHASE"), *[("c", 1, n, f"01/{n % 28 + 1:02d} SHOP {n}.00") for n in range(2, 3000)],
                                   ("c", 2, 3000, "01/05 NEXT PAGE 5000.00")], "stmt_id string, page_no int, line_no int, text string")
    labels = P.section_labels(cards)
    assert labels.count() == 2998 and labels.where("section <> 'purchase'").count() == 0


def test_headers(proved):
    got = {r["stmt_id"]: r for r in proved.statements.collect()}
    assert {k: (r["account_last4"], r["period_start"], r["period_end"]) for k, r in got.items()} == {
        "run": ("1234", dt.date(2025, 3, 1), dt.date(2025, 3, 31)), "card": ("9876", dt.date(2024, 12, 3), dt.date(2025, 1, 2)),
        "sec": ("4321", dt.date(2026, 6, 16), dt.date(2026, 7, 17)), "anc": ("2222", dt.date(2025, 12, 5), dt.date(2026, 1, 3))}
    # the balance line outside the table does not count, the one that closes it does
    assert got["run"]["summary"]["ending_balance"] == M("537.60") and got["run"]["summary"]["beginning_balance"] == M("1000.00")
    assert got["card"]["summary"]["payments_credits"] == M("-60.00") and got["card"]["summary"]["interest_charged"] == M("0.18")
    assert got["sec"]["summary"]["total_other_subtractions"] == M("-47.00")
    assert got["anc"]["summary"]["ending_balance"] == M("455.44") and got["anc"]["summary"]["deposits"] == M("31.20")


def test_rows(proved):
    got = {(r["stmt_id"], r["description"]): (r["date"], r["amount"], r["kind"], r["source_line"]) for r in proved.transactions.collect()}
    assert got == {
        ("run", "Card Purchase 03/13 Plum Cafe TX Card 0000"): (dt.date(2025, 3, 14), M("-12.40"), "withdrawal", 14),
        ("run", "Wire Via Bank Ref: Something"): (dt.date(2025, 3, 15), M("-500.00"), "withdrawal", 15),
        ("run", "Deposit"): (dt.date(2025, 3, 17), M("50.00"), "deposit", 20),
        ("card", "AUTOMATIC PAYMENT"): (dt.date(2024, 12, 30), M("-50.00"), "payment", 11),
        ("card", "PLUM SHOP ANYTOWN TX"): (dt.date(2024, 12, 31), M("-10.00"), "credit", 12),
        ("card", "PEAR SHOP"): (dt.date(2025, 1, 1), M("30.00"), "purchase", 13),
        ("card", "LATE FEE"): (dt.date(2025, 1, 1), M("5.00"), "fee", 14),
        ("card", "PURCHASE INTEREST CHARGE"): (dt.date(2025, 1, 2), M("0.18"), "interest", 15),
        ("sec", "PLUM CO DES:PAYROLL ID:410 CO ID:1 PPD"): (dt.date(2026, 6, 18), M("100.00"), "deposit", 11),
        ("sec", "CHECKCARD 0618 PLUM SHOP HOUSTON TX 755555555555555555 WEB"): (dt.date(2026, 6, 20), M("-7.00"), "withdrawal", 17),
        ("sec", "PEAR SHOP"): (dt.date(2026, 6, 21), M("-40.00"), "withdrawal", 24),
        ("anc", "Deposit"): (dt.date(2025, 12, 29), M("31.20"), "deposit", 11),
        ("anc", "Check 1001"): (dt.date(2025, 12, 8), M("-10.00"), "withdrawal", 14),
        ("anc", "Check 1002"): (dt.date(2026, 1, 2), M("-20.00"), "withdrawal", 14),
        ("anc", "Plum Insurance Co. Monthly"): (dt.date(2025, 12, 30), M("-40.76"), "withdrawal", 17),
        ("anc", "Plum Shop"): (dt.date(2026, 1, 2), M("-5.00"), "withdrawal", 20),
    }


def test_unparsed(proved):
    assert sorted((r["stmt_id"], r["line_no"], r["text"]) for r in proved.unparsed.collect()) == [
        ("anc", 19, "12/31 Orphan without amount"), ("card", 16, "06/15 TOO FAR AWAY 1.00"), ("run", 19, "03/16 No amount here"),
        ("sec", 19, LONG), ("sec", 23, "an orphan")]


def test_checks_hold(proved):
    got = {(r["stmt_id"], r["name"]): r["ok"] for r in proved.checks.collect()}
    assert len(got) == 22 and all(got.values()), [k for k, ok in got.items() if not ok]
    totals = proved.totals().first()
    assert (totals["statements"], totals["transactions"], totals["failed_checks"], totals["unparsed"], totals["can_generate"]) == (4, 16, 0, 5, False)


MUTATIONS = [  # document, text, replacement, checks that must fail
    ("run", "-12.40 987.60", "-13.40 987.60", {"running_balance_breaks", "ending_balance", "withdrawals_total"}),
    ("card", "12/31 PLUM SHOP ANYTOWN TX -10.00\n", "", {"payments_total", "new_balance"}),
    ("card", "FOR THIS PERIOD $5.00", "FOR THIS PERIOD $6.00", {"fees_page_agrees"}),
    ("sec", "06/21/26 PEAR SHOP -40.00\n", "06/21/26 PEAR SHOP -40.00\n06/21/26 PEAR SHOP -40.00\n", {"subtractions_total", "ending_balance"}),
    ("sec", "06/18/26 PLUM CO", "06/18/26 PEAR CO", set()),
    ("anc", "1001 12/08 10.00 ", "", {"checks_total", "withdrawals_total", "ending_balance"}),
]


def test_mutations_are_caught(spark):
    texts = {f"m{i}": "\n".join(DOCS[d]).replace(old, new) for i, (d, old, new, _) in enumerate(MUTATIONS)}
    assert all(texts[f"m{i}"] != "\n".join(DOCS[d]) for i, (d, *_) in enumerate(MUTATIONS))
    got = prove(spark.createDataFrame([(k, 1, t) for k, t in texts.items()], "stmt_id string, page_no int, text string"))
    failed = [(r["stmt_id"], r["name"]) for r in got.checks.where("not ok").collect()]
    for i, (*_, expected) in enumerate(MUTATIONS):
        assert {n for k, n in failed if k == f"m{i}"} == expected, i


def walk(lines, row, noise, flush):
    """The buffering rules as a plain walk, for comparison."""
    import re
    rows, unparsed, pending = [], [], []
    for number, text in lines:
        starts = text[:6].count("/") == 1 and text[:2].isdigit()
        if re.search(flush, text):
            unparsed += pending
            pending = []
        elif re.search(row, text):
            unparsed += pending
            pending = []
            rows.append((number, text))
        elif pending or starts:
            if starts and pending:
                unparsed += pending
                pending = []
            pending.append((number, text))
            joined = " ".join(t for _, t in pending)
            if re.search(row, joined):
                rows.append((pending[0][0], joined))
                pending = []
            elif len(pending) > V.MAX_WRAPPED_LINES:
                unparsed += pending
                pending = []
        elif not re.search(noise, text):
            unparsed.append((number, text))
    return sorted(rows), sorted(unparsed + pending)


def test_assembly_equals_a_walk_on_random_lines(spark):
    import random
    rng = random.Random(2)
    kinds = ["03/1{} whole -1.00 2.00", "03/1{} open", "more text", "-5.00 6.00", "Page 2", "FLUSH", "tail 1.00 2.00"]
    docs = {f"d{i}": [rng.choices(kinds, [2, 4, 6, 2, 1, 1, 1])[0].format(rng.randint(0, 9)) for _ in range(60)] for i in range(12)}
    lines = spark.createDataFrame([(d, n // 7, n, t) for d, ts in docs.items() for n, t in enumerate(ts)],
                                  "stmt_id string, page_no int, line_no int, text string")
    got = P.assemble_wrapped_rows(lines, V.RUN_ROW, V.RUN_NOISE, F.col("text") == "FLUSH").collect()
    for d, texts in docs.items():
        mine = {o: sorted((r["line_no"], r["text"]) for r in got if r["stmt_id"] == d and r["outcome"] == o) for o in ("row", "unparsed")}
        assert (mine["row"], mine["unparsed"]) == walk(list(enumerate(texts)), V.RUN_ROW, V.RUN_NOISE, "^FLUSH$"), d


def test_ambiguous_card_sections_are_dropped(spark):
    lines = spark.createDataFrame([("c", p, n, t) for p, n, t in [
        (1, 1, "PURCHASE"), (1, 2, "01/02 SHOP 5.00"), (1, 3, "01/03 SHOP 6.00"), (1, 4, "CASH ADVANCES"), (1, 5, "01/02 ATM 5.00"),
        (2, 1, "01/04 NO SECTION ON THIS PAGE 7.00"), (2, 2, "INTEREST CHARGES"), (2, 3, "CASH ADVANCES"), (2, 4, "Balance Type"), (2, 5, "01/05 X 8.00")]],
        "stmt_id string, page_no int, line_no int, text string")
    assert [(r["mmdd"], r["amount"], r["section"]) for r in P.section_labels(lines).collect()] == [("01/03", M("6.00"), "purchase")]


def test_write_refused_and_forced(spark, proved, folder):
    root = os.path.join(folder, "out")
    assert proved.write(root) is False and not os.path.exists(root)
    assert proved.write(root, force=True) is True
    long = os.path.join(folder, "long")
    assert proved.write(long, force=True, fmt="parquet", wide=False) is True
    from ledgerloom.sources.tables import current_version
    at = current_version(spark, long)
    assert spark.read.parquet(f"{at}/statements").columns == ["account", "account_last4", "file", "period_start", "key", "value"]
    assert spark.read.parquet(f"{at}/by_category").columns == ["month", "category", "spend"]


def test_arriving_files(spark, folder):
    from ledgerloom.streaming.arrivals import append_batch, ingest
    inbox, out = os.path.join(folder, "in"), os.path.join(folder, "out")
    os.makedirs(inbox)
    open(os.path.join(inbox, "one.txt"), "w").write("\n".join(SECTIONED))
    ingest(spark, inbox, os.path.join(folder, "state"), append_batch(out)).awaitTermination()
    open(os.path.join(inbox, "two.txt"), "w").write("\n".join(CARD))
    ingest(spark, inbox, os.path.join(folder, "state"), append_batch(out)).awaitTermination()
    rows = spark.read.parquet(f"{out}/held/transactions")
    assert {r["account"]: r["count"] for r in rows.groupBy("account").count().collect()} == {"checking": 3, "credit": 5}


def test_no_document_vanishes(spark, folder):
    gone = {"run": "March 01, 2025 through", "card": "Opening/Closing Date", "sec": "for June 16", "anc": "Balance on"}
    texts = {f"no-{k}": ["Opening/Closing Date" if k == "card" and mark in x else x for x in DOCS[k] if k == "card" or mark not in x]
             for k, mark in gone.items()} | {k: DOCS[k] for k in gone}
    got = prove(spark.createDataFrame([(k, 1, "\n".join(v)) for k, v in texts.items()], "stmt_id string, page_no int, text string"))
    lost = {r["stmt_id"]: r["kind"] for r in got.problems.where("scope = 'document'").collect()}
    assert lost == {"no-run": "no_period", "no-card": "no_period", "no-sec": "no_period", "no-anc": "no_balances"}
    assert {r["stmt_id"] for r in got.statements.collect()} == set(gone)
    rows = got.transactions.groupBy("stmt_id").count().collect()
    unread = {r["stmt_id"]: r["count"] for r in got.unparsed.groupBy("stmt_id").count().collect()}
    for r in rows:
        assert r["stmt_id"] in gone and unread[f"no-{r['stmt_id']}"] >= r["count"]
    assert not got.write(folder)
    assert not got.totals().first()["can_generate"]


def test_a_run_leaves_only_its_result(spark, folder):
    root = checkpoint_root(spark).removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    got = prove(spark.createDataFrame([("sec", 1, "\n".join(SECTIONED))], "stmt_id string, page_no int, text string"))
    assert got.write(os.path.join(folder, "ledger"), force=True)
    new = set(os.listdir(root)) - before
    left = {name.rsplit("-", 1)[0] for run in new for name in os.listdir(os.path.join(root, run))}
    assert left == {"detections", "statements", "transactions", "parsed", "checks", "problems"}
    got.close()
    assert set(os.listdir(root)) == before


def month_statement(month, opening, rows, closing):
    """A sectioned statement of June or July 2026 and so on, whole months."""
    names = {6: ("June", 30), 7: ("July", 31), 8: ("August", 31), 9: ("September", 30)}
    name, days = names[month]
    return ["bankofamerica.com", f"for {name} 01, 2026 to {name} {days}, 2026 Account number: 0000 0000 4321",
            f"Beginning balance on {name} 01, 2026 ${opening:,.2f}", f"Ending balance on {name} {days}, 2026 ${closing:,.2f}", "Deposits and other additions",
            *[f"{month:02d}/{d:02d}/26 PLUM PAY {a:.2f}" for d, a in rows], f"Total deposits and other additions ${sum(a for _, a in rows):.2f}"]


def test_accounts_continue_over_batches(spark, folder):
    from ledgerloom.streaming.accounts import AccountState
    from ledgerloom.streaming.arrivals import append_batch
    out = os.path.join(folder, "out")
    state = AccountState(spark, os.path.join(folder, "state"))
    sink = append_batch(out, state)

    def run(batch, docs):
        got = prove(spark.createDataFrame([(k, 1, "\n".join(v)) for k, v in docs.items()], "stmt_id string, page_no int, text string"))
        sink(got, batch)
        got.close()

    def problems(place):
        path = f"{place}/problems"
        return sorted((r["batch"], r["kind"], r["measured"]) for r in spark.read.parquet(path).collect()) if os.path.exists(path) else []

    june, july = month_statement(6, 100, [(3, 5.0)], 105), month_statement(7, 105, [(3, 5.0)], 110)
    august, wrong = month_statement(8, 110, [(4, 1.0)], 111), month_statement(7, 107, [(3, 5.0)], 112)
    run(0, {"june": june})
    assert state.before(1).select("stmt_id", "closing_balance").first() == ("june", M("105.00"))
    run(1, {"august": august})                    # July is missing
    assert problems(f"{out}/held") == [(1, "balance_chain", M("110.00")), (1, "period_gap", M("31.00"))]
    assert state.before(2).first()["stmt_id"] == "june"
    for _ in range(2):                            # a repeated batch changes nothing
        run(2, {"july": july, "august": august})
        assert problems(out) == [] and state.before(3).first()["stmt_id"] == "august"
        assert spark.read.parquet(f"{out}/transactions").count() == 3
    run(2, {"july": wrong, "august": august})     # the verdict on a repeated batch turns: it moves, no copy stays
    assert {r["batch"] for r in spark.read.parquet(f"{out}/transactions").select("batch").distinct().collect()} == {0}
    assert (2, "balance_chain", M("107.00")) in problems(f"{out}/held") and state.before(3).first()["stmt_id"] == "june"
    run(2, {"july": july, "august": august})
    assert spark.read.parquet(f"{out}/transactions").count() == 3 and [p for p in problems(f"{out}/held") if p[0] == 2] == []
    run(3, {"may": month_statement(6, 90, [(3, 5.0)], 95)})
    assert (3, "late_statement", None) in problems(f"{out}/held")


def test_counts_are_those_of_the_tables(proved):
    from ledgerloom.operators.continuity import run_totals
    again = run_totals(proved.statements, proved.transactions, proved.checks, proved.unparsed, proved.problems).first().asDict()
    assert proved.totals().first().asDict() == again
    assert "parquet" not in proved.totals()._jdf.queryExecution().optimizedPlan().toString()


def test_month_folders_hold_their_rows_in_order(spark, folder):
    import glob

    import pyarrow.parquet as pq
    from ledgerloom.operators import spend as S
    from ledgerloom.sources import tables as TB
    rows = spark.range(3000).selectExpr(
        "'checking' account", "'1' account_last4", "date_add(date'2025-01-01', cast(pmod(hash(id), 200) as int)) date", "'m' merchant", "'c' category",
        "'d' description", "cast(id as decimal(18,2)) amount", "cast(id as decimal(18,2)) signed", "'withdrawal' kind", "date'2025-01-31' statement_close",
        "date'2025-01-01' period_start", "date'2025-01-31' period_end", "'f' source_file", "id source_line")
    export = TB.export_by_month(rows)
    sorts = [x for x in export._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x]
    assert sorts and not any(x.endswith("true") for x in sorts)  # no total order
    clean = spark.createDataFrame([(0, 0, 0)], "failed_checks int, unparsed int, problems int")
    TB.gated_write({"transactions": export}, clean, folder, fmt="parquet", partition_by={"transactions": ["month"]})
    path = TB.current_version(spark, folder)
    files = glob.glob(f"{path}/transactions/month=*/*.parquet")
    assert sum(pq.read_metadata(f).num_rows for f in files) == 3000 and len(files) <= 7 + 4
    for f in files:
        table = pq.ParquetFile(f).read(columns=["date", "source_line"]).to_pylist()
        assert table == sorted(table, key=lambda r: (r["date"], r["source_line"]))
    ledger = TB.read_ledger(spark, path, "parquet")
    picked = S.period_filter(ledger, S.period_months(ledger.select("month").distinct(), 2))
    assert "dynamicpruning" in picked._jdf.queryExecution().executedPlan().toString()
    assert {r["month"] for r in picked.select("month").distinct().collect()} == {"2025-06", "2025-07"}
