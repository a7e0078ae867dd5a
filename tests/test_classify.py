"""Stage order of classification, user rules, and the scorer."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classify as K
from ledgerloom.operators import scoring as E
from ledgerloom.sources.rules import Rules

RULES = Rules(payees=[("NOAM", "Rent", "Housing")], ach=[("9876543210", "Plum Homes rent", "Housing")],
              merchants=[("plum dealership", "Plum Dealership", "Auto"), ("PLUM CORP PAYROLL", "Plum Corp", "Income")])

CASES = [  # text, account, kind, merchant, category
    ("PURCHASE INTEREST CHARGE", "credit", "interest", "Chase card interest", "Fees & Interest"),
    ("LATE FEE", "credit", "fee", "Chase card fee", "Fees & Interest"),
    ("DRAFTKINGS 0000", "credit", "cash_advance", "Cash advance", "Cash & ATM"),
    ("Thank you", "credit", "payment", "Chase card payment", "Transfers"),
    ("SHELL OIL 00000000000 ANYTOWN TX", "credit", "purchase", "Shell", "Gas & Fuel"),
    ("SHELL 00000000002 OTHERTOWN LA", "credit", "purchase", "Shell", "Gas & Fuel"),
    ("LYFT *RIDE WED 11PM LYFT.COM CA", "credit", "purchase", "Lyft", "Transport"),
    ("PlayStation Network 000-0000000 CA", "credit", "purchase", "PlayStation", "Entertainment"),
    ("AMAZON MKTPL*AA0 Amzn.com/bill WA", "credit", "credit", "Amazon", "Refunds"),
    ("PLUM WIDGET REFUND LLC ANYTOWN TX", "credit", "credit", "Plum Widget Refund LLC", "Refunds"),
    ("PLUM WIDGET SUPPLY ANYTOWN TX", "credit", "purchase", "Plum Widget Supply", "uncategorized"),
    ("PLUM FLORIST HOUSTON TX", "credit", "purchase", "Plum Florist", "uncategorized"),
    ("TST* THE CORNER DINER ANYTOWN TX", "credit", "purchase", "THE Corner Diner", "Dining & Delivery"),
    ("TST*PLUM THE RECORD ANYTOWN TX", "credit", "purchase", "Plum THE Record", "Dining & Delivery"),
    ("SP * PLUM SHOP ANYTOWN TX", "credit", "purchase", "Plum Shop", "Shopping"),
    ("GAZEBO CAFE ANYTOWN LA", "credit", "purchase", "Gazebo Cafe", "Dining & Delivery"),
    ("WAL-MART #0915 STAFFORD TX", "checking", "withdrawal", "Walmart", "Shopping"),
    ("WALMART SUPERCENTER HOUSTON TX", "checking", "withdrawal", "Walmart", "Shopping"),
    ("07/16 Payment To Chase Card Ending IN 0000", "checking", "withdrawal", "Chase card payment", "Transfers"),
    ("Card Purchase With Pin 03/06 Plum Cafe TX Card 0000", "checking", "withdrawal", "Plum Cafe", "Dining & Delivery"),
    ("Zelle Payment To Noam Jpm99Xx0000A", "checking", "withdrawal", "Rent (Noam)", "Housing"),
    ("Zelle Payment To Casey Jpm99Xx0000C", "checking", "withdrawal", "To Casey", "People & Services"),
    ("Payment Sent 01/19 Apple Cash Sent Money Some Person CA Card 0000", "checking", "withdrawal", "To Some Person", "People & Services"),
    ("Payment Sent 01/19 Apple Cash Sent Mone Some Person CA Card 0000", "checking", "withdrawal", "To Some Person", "People & Services"),
    ("VENMO PAYMENT SOME PERSON", "checking", "withdrawal", "To Some Person", "People & Services"),
    ("VENMO", "checking", "withdrawal", "Person-to-person payment", "People & Services"),
    ("Zelle Payment From Jordan 20000000000", "checking", "deposit", "Zelle received", "Reimbursements"),
    ("Zelle Payment From Jordan 20000000000", "checking", "withdrawal", "Zelle received", "Income"),
    ("Plum Corp Payroll PPD ID: 0000000000", "checking", "deposit", "Plum Corp", "Income"),
    ("Pear Corp Payroll PPD ID: 0000000000", "checking", "deposit", "Payroll", "Income"),
    ("Irs Treas 310 Tax Ref PPD ID: 0000000000", "checking", "deposit", "IRS tax refund", "Income"),
    ("Deposit 0000000000", "checking", "deposit", "Deposit (unattributed)", "One-off deposits"),
    ("COSTCO WHSE #1018 HOUSTON TX", "checking", "deposit", "Costco", "Reimbursements"),
    ("PLUM THING ANYTOWN TX", "checking", "deposit", "Plum Thing", "One-off deposits"),
    ("Plum Homes DES:WEB PMTS ID:AB12 INDN:A Person CO ID:9876543210", "checking", "withdrawal", "Plum Homes rent", "Housing"),
    ("Plum Homes DES:WEB PMTS ID:EF34 INDN:A Person CO ID:9876543210", "checking", "deposit", "Plum Homes rent", "Income"),
    ("Plum Homes DES:WEB PMTS ID:EF34 INDN:A Person CO ID:1", "checking", "withdrawal", "Plum Homes", "uncategorized"),
    ("06/12 Online Domestic Wire Transfer Via: Some Bank A/C: Plum Dealership City ST", "checking", "withdrawal", "Plum Dealership", "Auto"),
    ("06/12 Online Domestic Wire Fee", "checking", "withdrawal", "Wire fee", "Fees & Interest"),
]


@pytest.fixture(scope="module")
def scored(spark):
    cases = spark.createDataFrame(CASES, "text string, account string, kind string, expected_merchant string, expected_category string")
    return E.predictions(cases, lambda df: K.classify_texts(df, RULES))


def test_labelled_cases(scored):
    assert [r.asDict() for r in E.eval_misses(scored).collect()] == []
    score = E.eval_score(scored, 1.0, 1.0).first()
    assert (score["accuracy"], score["coverage"], score["accuracy_ok"], score["coverage_ok"]) == (1.0, 1.0, True, True)


def test_every_shipped_rule_fires_on_its_own_text(spark):
    from ledgerloom import fixed_values as V
    assert len(V.DESCRIPTOR_RULES) == 154
    texts = spark.createDataFrame([("NOTHING HERE AT ALL",), ("GOLF CLUB",), ("UBER EATS",), ("UBER TRIP",)], "t string")
    got = [r["m"] for r in K.with_rule_match(texts, "t", V.DESCRIPTOR_RULES, "h").select(F.col("h.merchant").alias("m")).collect()]
    assert got == [None, "Golf", "Food delivery", "Uber"]


def test_long_rule_lists_keep_order(spark):
    rules = [(f"WORD{i:04d}", f"m{i}", "c") for i in range(900)] + [("WORD", "last", "c")]
    texts = spark.createDataFrame([("x WORD0899 y",), ("WORD0003 WORD0002",), ("WORDLESS",), ("none",)], "t string")
    got = [r["m"] for r in K.with_rule_match(texts, "t", rules, "h").select(F.col("h.merchant").alias("m")).collect()]
    assert got == ["m899", "m2", "last", None]


def test_join_back_and_recategorize(spark):
    rows = spark.createDataFrame([(1, "", "PLUM WIDGET SUPPLY TX", "credit", "purchase"), (2, "PLUM WIDGET SUPPLY TX", "raw", "credit", "purchase"),
                                  (3, "", "PEAR X TX", "credit", "purchase")], "txn_id int, descriptor string, description string, account string, kind string")
    first = K.with_classification(rows)
    assert {r["txn_id"]: r["category"] for r in first.collect()} == {1: "uncategorized", 2: "uncategorized", 3: "uncategorized"}
    again = K.recategorize(first, Rules(merchants=[("plum widget", "Plum", "Household")]))
    assert {r["txn_id"]: (r["former_category"], r["category"]) for r in again.collect()} == {
        1: ("uncategorized", "Household"), 2: ("uncategorized", "Household"), 3: ("uncategorized", "uncategorized")}


@pytest.mark.parametrize("cases, expected", [
    ([("A", "S", "A", "S")], (1, 1, 1, 1, 1.0, 1.0)),
    ([("A", "D", "A", "G")], (1, 1, 0, 0, 0.0, 1.0)),
    ([("A", "uncategorized", "A", "uncategorized")], (1, 1, 1, 1, 1.0, 1.0)),
    ([("A", "S", "A", "S"), ("B", "D", "B", "G"), ("X", "S", "C", "S"), ("U", "uncategorized", "U", "uncategorized")], (4, 3, 3, 2, 0.5, 1.0)),
    ([("A", "uncategorized", "A", "G")], (1, 1, 0, 0, 0.0, 0.0)),
    ([], (0, 0, 0, 0, 1.0, 1.0)),
])
def test_scorer_arithmetic(spark, cases, expected):
    df = spark.createDataFrame(cases, "merchant string, category string, expected_merchant string, expected_category string")
    got = E.eval_score(df).first()
    assert tuple(got[c] for c in ("total", "merchant_matches", "category_matches", "exact_matches", "accuracy", "coverage")) == expected


def test_the_last_rule_of_an_id_wins(spark):
    texts = spark.createDataFrame([("X DES:PAY ID:1 INDN:Y CO ID:9000000001 PPD", "checking", "withdrawal")], "text string, account string, kind string")
    for extra in (0, 600):
        rules = Rules(ach=[("9000000001", "First", "Housing"), *[(f"8{i:09d}", "Other", "Housing") for i in range(extra)],
                           (" 9000000001 ", "Last", "Travel")])
        assert [(r["merchant"], r["category"]) for r in K.classify_texts(texts, rules).collect()] == [("Last", "Travel")]
