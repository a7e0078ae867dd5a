"""Column functions: money, dates, names and descriptors."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


def each(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def staged(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["out"] for r in function(rows, "t", "out").orderBy("i").collect()]


def test_money(spark):
    printed = ["1,234.50", "-$9.10", "$-9.10", ".18", "+2.00", "-0.00", "$12,059.93", "-.23", "no"]
    assert each(spark, X.parse_money, printed) == [
        Decimal(v) for v in ("1234.50", "-9.10", "-9.10", "0.18", "2.00", "0.00", "12059.93", "-0.23")] + [None]


def test_resolve_year(spark):
    start, end = dt.date(2025, 12, 3), dt.date(2026, 1, 2)
    cases = {(12, 30): dt.date(2025, 12, 30), (1, 1): dt.date(2026, 1, 1), (11, 25): dt.date(2025, 11, 25),
             (6, 15): None, (13, 1): None}
    for (mm, dd), expected in cases.items():
        got = one(spark, X.resolve_year(F.col("m"), F.col("d"), F.col("s"), F.col("e")), m=mm, d=dd, s=start, e=end)
        assert got == expected, (mm, dd)
    assert one(spark, X.resolve_year(F.col("m"), F.col("d"), F.col("s"), F.col("e")), m=2, d=29,
               s=dt.date(2025, 2, 1), e=dt.date(2025, 3, 1)) is None


def test_year_for(spark):
    assert one(spark, X.year_for(F.lit(4), F.lit(3), F.col("c")), c=dt.date(2002, 5, 3)) == dt.date(2002, 4, 3)
    assert one(spark, X.year_for(F.lit(12), F.lit(5), F.col("c")), c=dt.date(2026, 1, 3)) == dt.date(2025, 12, 5)


def test_two_digit_years(spark):
    assert each(spark, X.short_date, ["01/02/95", "01/02/25", "02/29/96"]) == [
        dt.date(1995, 1, 2), dt.date(2025, 1, 2), dt.date(1996, 2, 29)]


def test_titlecase(spark):
    assert each(spark, X.titlecase, ["BLUE HERON LLC", "the corner", "OFF THE RECORD", "McDuck 12 x9Y", "", "#1 AB1CD"]) == [
        "Blue Heron LLC", "The Corner", "OFF THE Record", "McDuck 12 x9Y", "", "#1 Ab1cd"]


def test_clean(spark):
    raw_to_name = {
        "SQ *PLUM NOODLE GRILL Anytown TX": "PLUM NOODLE GRILL",
        "TST* PLUM ICE HOUSE - EA ANYTOWN TX": "PLUM ICE HOUSE",
        "PLUM DONUTS #000123 ANYTOWN TX": "PLUM DONUTS",
        "PLUM INS 000-000-0000 OH": "PLUM INS",
        "Card Purchase 03/05 Plum Cafe TX Card 0000": "Plum Cafe",
        "Card Purchase With Pin 03/06 Plum Cafe TX Card 0000": "Plum Cafe",
        "Recurring Card Purchase 03/05 Plum Club TX Card 0000": "Plum Club",
        "PLUM.COM PLUM.COM CA": "PLUM",
        "PLUM PLUM.COM/ TX": "PLUM",
        "PLUM DATA SERVICES LAS VEGAS NV": "PLUM DATA SERVICES",
        "PLUM DATA SALT LAKE CITY UT": "PLUM DATA",
        "PLUM DATA ST. LOUIS MO": "PLUM DATA",
        "CORNER BAKERY NY": "CORNER BAKERY",
        "PLUM SUPPLY LLC TX": "PLUM SUPPLY LLC",
        "TX": "",
    }
    assert staged(spark, X.with_clean, list(raw_to_name)) == list(raw_to_name.values())


def test_hints_are_separate_from_advice(spark):
    texts = ["PLUM FLORIST ANYTOWN TX", "PLUM PATISSERIE", "PLUM CAR WASH", "PLUM LIFE 832-848-0870 TX"]
    assert staged(spark, X.with_suggested_category, texts) == ["Shopping", "Dining & Delivery", "Auto", None]
    assert staged(spark, X.with_category_hint, texts) == [None, None, None, None]
    assert staged(spark, X.with_category_hint, ["TST*PLUM X TX", "SP PLUMSHOP NY", "SP O*X NY", "SPO*PLUM TX"]) == [
        "Dining & Delivery", "Shopping", None, None]


def test_ach(spark):
    a = "Plum Homes DES:WEB PMTS ID:AB12CD INDN:A Person CO ID:9876543210"
    b = "Plum Homes DES:WEB PMTS ID:EF34GH INDN:A Person CO ID:9876543210"
    c = "Plum Employer Payroll PPD ID: 1122334455"
    d = "PLUM SHOP ANYTOWN TX"
    assert each(spark, X.ach_originator, [a, b, c, d]) == ["9876543210", "9876543210", "1122334455", None]
    assert each(spark, X.strip_ach_tail, [a, b, c, d]) == ["Plum Homes", "Plum Homes", "Plum Employer Payroll", d]


def test_envelope(spark):
    cases = {
        "CHECKCARD 0614 PLUM SHOP HOUSTON TX 75369436166913405028561": "PLUM SHOP HOUSTON TX",
        "MOBILE PURCHASE 0625 PLUM SHOP TROY MI": "PLUM SHOP TROY MI",
        "PLUM SHO 06/22 #000035420 MOBILE PURCHASE PLUM SHOPPE HOUSTON TX": "PLUM SHOPPE HOUSTON TX",
        "PLUM SHOP 05/17 #000002369 MOBILE PURCHASE 7810 PLUM FREEWAY HOUSTON": "PLUM SHOP",
        "Zelle payment to A Person Conf# abc123": "Zelle payment to A Person Conf# abc123",
    }
    assert each(spark, X.strip_envelope, list(cases)) == list(cases.values())


def test_literal_alternatives():
    assert X.split_alternatives(r"A|B(C|D)|[|]E|F\|G") == ["A", "B(C|D)", "[|]E", r"F\|G"]
    assert [X.literal_of(a) for a in ("DD \\*", "UBER ?EATS", r"\bHEB\b", "APPLE\\.COM/BILL")] == [
        "DD *", None, None, "APPLE.COM/BILL"]


def test_classify_kind(spark):
    rows = spark.createDataFrame([
        ("credit", -5.0, "AUTO PAYMENT", None), ("credit", -5.0, "SHOP REFUND", None), ("credit", 5.0, "X", "cash_advance"),
        ("credit", 5.0, "PURCHASE INTEREST CHARGE", None), ("credit", -0.23, "PURCHASE INTEREST CHARGE", None),
        ("credit", 5.0, "LATE FEE", None), ("credit", 5.0, "SHOP", None), ("checking", 5.0, "x", None), ("checking", -5.0, "x", None),
    ], "account string, amount double, text string, section string")
    got = [r["k"] for r in rows.select(X.classify_kind(F.col("account"), F.col("amount"), F.col("text"), F.col("section")).alias("k")).collect()]
    assert got == ["payment", "credit", "cash_advance", "interest", "credit", "fee", "purchase", "deposit", "withdrawal"]


def test_one_search_stands_for_many_patterns(spark):
    from ledgerloom.functions.text import any_match_sql, may_match_sql, split_alternatives
    patterns = [p for p, _, _ in V.DESCRIPTOR_RULES]
    hints = [p for p, _ in V.NAME_HINTS]
    pieces = sorted({a.replace("\\b", "").replace("\\s", " ").replace("\\d", "7").replace("\\", "").replace("?", "").replace("+", "")
                     for p in patterns + hints for a in split_alternatives(p)})
    rows = [(t,) for p in pieces for t in (p, f"A{p}Z", f"X {p} 7", p[1:], p[:-1])] + [("",), (None,), ("PLAIN GOODS",)]
    df = spark.createDataFrame(rows, "t string")
    every = "t rlike '" + "|".join(patterns).replace("\\", "\\\\").replace("'", "\\'") + "'"
    hinted = "t rlike '" + "|".join(hints).replace("\\", "\\\\") + "'"
    got = df.selectExpr(f"{every} as holds", f"{may_match_sql('t', patterns)} as may", f"{hinted} as hinted",
                        f"{any_match_sql('t', '|'.join(hints))} as one").collect()
    assert all(r["may"] for r in got if r["holds"]) and all(r["hinted"] == r["one"] for r in got)
    assert any(r["may"] is False for r in got) and any(r["holds"] for r in got) and any(r["one"] for r in got)
    for unusual in (r"(?i)abc|x", r"\Qa|b\E", r"(a)\1"):
        assert may_match_sql("t", ["SHELL", unusual]) == "true"


def test_codes_are_stripped_in_stages_as_in_one_expression(spark):
    from ledgerloom.functions.text import strip_codes, with_codes_stripped
    rows = [(t,) for t in ("SQ *JOE'S 281-555-0000 #12A TX", "WWW.SHOP.COM/x9 STORE", "PLAIN  NAME", "A*BC 123456789X", "TST* B.NET*77 #9Q ", "", None)]
    df = spark.createDataFrame(rows, "t string").withColumn("whole", strip_codes(F.col("t")))
    assert all(r["t"] == r["whole"] for r in with_codes_stripped(df, "t").collect())
