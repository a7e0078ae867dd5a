"""A ledger view over the driver tables: accounts, transactions and statements with known defects.

Column expressions are plain SQL that Spark and DuckDB read alike, so the same text defines the
view here and in the SQL checks; operators are written separately for each.

* account     <- customer: card when ``c_custkey % 3 = 0``, else checking
* transaction <- order (one each): status P arrives, F and O leave
* descriptor  <- the order's first part, wrapped in twelve descriptor shapes
* statement   <- account x quarter (or one empty statement for an account without orders), with
  printed totals that are wrong on known statements
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators.classify import with_classification
from ledgerloom.sources.rules import Rules
from ledgerloom.storage import dealt, materialize

LAYOUT = ("case when c_custkey % 3 = 0 then 'chase_credit' when c_custkey % 3 = 1 then 'chase_checking' "
          "when c_custkey % 2 = 0 then 'boa_checking' else 'wellsfargo_checking' end")
NAME = "upper(p_name)"
CITY = ("case n_nationkey % 6 when 0 then 'LAS VEGAS' when 1 then 'SOMETOWN' when 2 then 'ST LOUIS' "
        "else r_name end")
PERSON = "case c_custkey % 4 when 0 then 'Alex ' when 1 then 'Robin ' when 2 then 'Casey Jones ' else '' end"
BRAND = ("case c_mktsegment when 'AUTOMOBILE' then 'JIFFY LUBE #12 SOMETOWN TX' "
         "when 'BUILDING' then 'HOME DEPOT 0042 SOMETOWN TX' when 'FURNITURE' then 'IKEA HOUSTON TX' "
         "when 'HOUSEHOLD' then 'WAL-MART #0915 STAFFORD TX' else 'NETFLIX.COM NETFLIX.COM CA' end")
IN = "o_orderstatus = 'P'"
OKEY = "cast(o_orderkey as string)"
MMDD = ("lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || "
        "lpad(cast(day(o_orderdate) as string), 2, '0')")
DESCRIPTION = f"""case
 when p_name is null then 'OPAQUE ORDER ' || {OKEY}
 when c_custkey % 6 = 5 and o_orderkey % 12 = 11 and not ({IN}) then 'Check ' || cast(1000 + o_orderkey % 900 as string)
 when o_orderkey % 12 < 2 then {NAME} || ' #' || cast(p_partkey as string) || ' ' || {CITY} || ' TX'
 when o_orderkey % 12 = 2 then 'Card Purchase ' || {MMDD} || ' ' || p_name || ' Cafe TX Card 0000'
 when o_orderkey % 12 = 3 then p_name || ' Properties DES:WEB PMTS ID:' || {OKEY} || ' INDN:A Person CO ID:9' || lpad(cast(p_partkey % 50 as string), 9, '0')
 when o_orderkey % 12 = 4 and {IN} then 'Zelle Payment From ' || {PERSON} || '2000000' || lpad({OKEY}, 9, '0')
 when o_orderkey % 12 = 4 then 'Zelle Payment To ' || {PERSON} || 'Jpm99' || {OKEY}
 when o_orderkey % 12 = 5 then 'SQ *' || {NAME} || ' GRILL Sometown TX'
 when o_orderkey % 12 = 6 then {NAME} || ' 06/22 #000035420 MOBILE PURCHASE ' || case when p_partkey % 3 = 0 then '7810 SOME FREEWAY' else {NAME} || ' STORE HOUSTON TX' end
 when o_orderkey % 12 = 7 then 'CHECKCARD 0614 ' || {NAME} || ' MARKET HOUSTON TX 75369436166913405028561'
 when o_orderkey % 12 = 8 then {BRAND}
 when o_orderkey % 12 = 9 and {IN} then 'Acme Corp Payroll PPD ID: 1122334455'
 when o_orderkey % 12 = 9 then {MMDD} || ' Online Domestic Wire Transfer Via: Some Bank Na/000000000'
 when o_orderkey % 12 = 10 then 'TST* ' || {NAME} || ' SOMETOWN TX'
 when {IN} then 'Deposit ' || lpad({OKEY}, 10, '0')
 else {NAME} || ' SUPPLY LLC SOMETOWN TX' end"""
KIND = """case when c_custkey % 3 <> 0 then case when o_orderstatus = 'P' then 'deposit' else 'withdrawal' end
 when o_orderstatus = 'P' then case when o_orderkey % 2 = 0 then 'payment' else 'credit' end
 when o_orderkey % 29 = 0 then 'fee' when o_orderkey % 31 = 0 then 'interest'
 when o_orderkey % 37 = 0 then 'cash_advance' else 'purchase' end"""
MAGNITUDE = "cast(o_totalprice as decimal(18,2))"
AMOUNT = f"case when (c_custkey % 3 <> 0) = ({IN}) then {MAGNITUDE} else cast(-{MAGNITUDE} as decimal(18,2)) end"
QUARTER = "(year(o_orderdate) * 4 + quarter(o_orderdate))"
STMT = f"cast(c_custkey as string) || '-' || cast({QUARTER} as string)"
PERIOD_START = "cast(date_trunc('quarter', o_orderdate) as date)"
PERIOD_END = f"cast({PERIOD_START} + interval 3 month - interval 1 day as date)"

TRANSACTION_COLUMNS = {
    "txn_id": "o_orderkey",
    "owner": "c_custkey",
    "account": "case when c_custkey % 3 = 0 then 'credit' else 'checking' end",
    "account_last4": "lpad(cast(c_custkey % 10000 as string), 4, '0')",
    "layout_name": LAYOUT,
    "quarter_no": QUARTER,
    "stmt_id": STMT,
    "date": "cast(o_orderdate as date)",
    "month": "substr(cast(cast(o_orderdate as date) as string), 1, 7)",
    "amount": AMOUNT,
    "signed": f"case when {IN} then {MAGNITUDE} else cast(-{MAGNITUDE} as decimal(18,2)) end",
    "kind": KIND,
    "description": DESCRIPTION,
    "period_start": PERIOD_START,
    "period_end": PERIOD_END,
    "statement_close": PERIOD_END,
    "source_file": f"'stmt-' || {STMT} || '.txt'",
    "source_line": "o_orderkey",
}

# Printed totals: a column per label, null where the layout does not print it.
DEFECT_BUCKET = "(owner * 7 + quarter_no) % 17 = 0"
DEFECT_CLOSING = "(owner * 5 + quarter_no) % 41 = 0"
DEFECT_PAGE = "(owner + quarter_no) % 43 = 0"
BUCKET = f"case when {DEFECT_BUCKET} then 1.00 else 0.00 end"
CLOSING = f"opening + net + case when {DEFECT_CLOSING} then 0.50 else 0.00 end"
PAGE = f"case when {DEFECT_PAGE} then 1.00 else 0.00 end"


def printed(condition: str, value: str) -> str:
    return f"case when {condition} then cast({value} as decimal(18,2)) end"


CARD, RUN = "layout_name = 'chase_credit'", "layout_name = 'chase_checking'"
SEC, ANC = "layout_name = 'boa_checking'", "layout_name = 'wellsfargo_checking'"
ASSET = "layout_name <> 'chase_credit'"
SUMMARY_COLUMNS = {
    "beginning_balance": printed(ASSET, "opening"),
    "ending_balance": printed(ASSET, CLOSING),
    "previous_balance": printed(CARD, "opening"),
    "new_balance": printed(CARD, CLOSING),
    "deposits": printed(ASSET, f"positive + {BUCKET}"),
    "electronic_withdrawals": printed(RUN, "negative"),
    "total_deposits": printed(SEC, "positive"),
    "other_subtractions": printed(SEC, f"negative + {PAGE}"),
    "total_other_subtractions": printed(SEC, "negative"),
    "checks": printed(ANC, "-paper_checks"),
    "other_withdrawals": printed(ANC, "-(negative - paper_checks)"),
    "withdrawals": printed(ANC, f"-negative + {PAGE}"),
    "payments_credits": printed(CARD, "payments + credits"),
    "purchases": printed(CARD, f"purchases_sum + {BUCKET}"),
    "cash_advances": printed(CARD, "advances"),
    "fees_charged": printed(CARD, "fees_sum"),
    "interest_charged": printed(CARD, "interest_sum"),
    "total_fees_line": printed(CARD, f"fees_sum + {PAGE}"),
    "total_interest_line": printed(CARD, "interest_sum"),
}
KEY = ["account", "owner"]
USER_RULES = Rules(
    payees=[("ALEX", "Rent", "Housing"), ("ROBIN", "Cleaning", "Household")],
    ach=[("9000000007", "Example Properties", "Housing"), ("9000000011", "Example Power", "Utilities")],
    merchants=[("small anvil supply", "Anvil Supply", "Household")],
)

_published: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unclassified row per order, published once per session and folder: the ledger, its texts and the statements read it."""
    key = (spark.sparkContext.applicationId, sf_dir, "transactions")
    if key not in _published:
        _published[key] = materialize(_transactions(spark, sf_dir), "transactions")
    return _published[key]


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_part = (read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
                  .agg(F.min("l_partkey").alias("p_partkey")))
    nation = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = (read(spark, sf_dir, "orders")
            .join(first_part, "o_orderkey", "left")
            .join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "left")
            .join(read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
            .withColumnRenamed("o_custkey", "c_custkey")
            .join(nation.select("n_nationkey", "r_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    rows = rows.selectExpr(*[f"{e} as {n}" for n, e in TRANSACTION_COLUMNS.items()])
    return rows.withColumn("descriptor", F.when(
        F.col("txn_id") % 12 > 5, X.strip_envelope(F.col("description"))).otherwise(F.lit("")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified transactions, published once per session and folder as a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published:
        _published[key] = materialize(with_classification(transactions(spark, sf_dir), USER_RULES), "ledger")
    return _published[key]


def statement_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per statement with true sums and the opening balance."""
    rows = dealt(transactions(spark, sf_dir), "owner")
    head = ["stmt_id", "owner", "account", "account_last4", "layout_name", "quarter_no",
            "period_start", "period_end", "source_file"]

    def total(condition: str) -> "F.Column":
        return F.expr(f"cast(coalesce(sum(case when {condition} then amount end), 0) as decimal(18,2))")

    active = rows.groupBy(*head).agg(
        total("true").alias("net"), total("amount > 0").alias("positive"),
        total("amount < 0").alias("negative"),
        total("amount < 0 and description like 'Check %'").alias("paper_checks"),
        total("kind = 'payment'").alias("payments"), total("kind = 'credit'").alias("credits"),
        total("kind = 'purchase'").alias("purchases_sum"), total("kind = 'cash_advance'").alias("advances"),
        total("kind = 'fee'").alias("fees_sum"), total("kind = 'interest'").alias("interest_sum"),
        F.count(F.lit(1)).alias("txn_count"))
    customers = read(spark, sf_dir, "customer")
    idle = customers.join(read(spark, sf_dir, "orders").select("o_custkey"),
                          F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    zero = ["net", "positive", "negative", "paper_checks", "payments", "credits", "purchases_sum",
            "advances", "fees_sum", "interest_sum"]
    idle = idle.selectExpr(
        "cast(c_custkey as string) || '-7981' as stmt_id", "c_custkey as owner",
        f"{TRANSACTION_COLUMNS['account']} as account", f"{TRANSACTION_COLUMNS['account_last4']} as account_last4",
        f"{LAYOUT} as layout_name", "7981 as quarter_no", "date '1995-01-01' as period_start",
        "date '1995-03-31' as period_end",
        "'stmt-' || cast(c_custkey as string) || '-7981.txt' as source_file",
        *[f"cast(0 as decimal(18,2)) as {z}" for z in zero], "cast(0 as bigint) as txn_count")
    before = Window.partitionBy("owner").orderBy("quarter_no").rowsBetween(Window.unboundedPreceding, -1)
    base = customers.selectExpr("c_custkey as owner", "cast(c_acctbal as decimal(18,2)) as base")
    return (active.unionByName(idle).join(base, "owner")
            .withColumn("opening", (F.col("base") + F.coalesce(F.sum("net").over(before), F.lit(0)))
                        .cast("decimal(18,2)")))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their printed summary as a map, published once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "statements")
    if key not in _published:
        figures = statement_figures(spark, sf_dir)
        pairs = ", ".join(f"'{k}', {e}" for k, e in SUMMARY_COLUMNS.items())
        _published[key] = materialize(figures.withColumn(
            "summary", F.map_filter(F.expr(f"map({pairs})"), lambda k, v: v.isNotNull())
        ).select("stmt_id", "owner", "account", "account_last4", "layout_name", "quarter_no", "source_file",
                 F.col("period_end").alias("close_date"), "period_start", "period_end", "summary",
                 "txn_count", "opening"), "statements")
    return _published[key]


def running_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the running-balance layout with a printed balance, wrong on known rows."""
    from ledgerloom.operators.timeseries import running_balance
    rows = transactions(spark, sf_dir).where("layout_name = 'chase_checking'")
    opening = statements(spark, sf_dir).select("stmt_id", "opening")
    walked = running_balance(rows, opening, keys=["stmt_id"], segments=["date"], order=["txn_id"])
    return walked.withColumn("balance", F.expr(
        "cast(running + case when txn_id % 101 = 0 then 0.25 else 0.00 end as decimal(18,2))"))


def recurring_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges for recurrence detection: suppliers bill monthly, customers irregularly; published once."""
    key = (spark.sparkContext.applicationId, sf_dir, "recurring")
    if key not in _published:
        _published[key] = materialize(_charges(spark, sf_dir), "charges")
    return _published[key]


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = (read(spark, sf_dir, "lineitem")
                .groupBy("l_suppkey", F.expr("substr(cast(cast(l_shipdate as date) as string), 1, 7)").alias("month"))
                .agg(F.min(F.expr("cast(l_shipdate as date)")).alias("date"),
                     F.sum(F.expr("cast(l_extendedprice as decimal(18,2))")).alias("total"))
                .selectExpr("'SUP ' || cast(l_suppkey as string) as merchant", "date", "month",
                            "cast(-total as decimal(18,2)) as signed", "'Utilities' as category",
                            "cast(0 as bigint) as txn_id"))
    customer = read(spark, sf_dir, "orders").selectExpr(
        "'CUS ' || cast(o_custkey as string) as merchant", "cast(o_orderdate as date) as date",
        "substr(cast(cast(o_orderdate as date) as string), 1, 7) as month",
        "cast(-cast(o_totalprice as decimal(18,2)) as decimal(18,2)) as signed",
        "'Shopping' as category", "o_orderkey as txn_id")
    # every tenth supplier stops two years before the end of the data, so ended charges exist too
    supplier = supplier.where("not (cast(substr(merchant, 5) as bigint) % 10 = 3 and date > date '1999-06-30')")
    return supplier.unionByName(customer)
