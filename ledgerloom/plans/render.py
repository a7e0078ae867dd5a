"""Statement text rendered from the ledger view, to be parsed back by extraction.

Every layout prints its statements the way its patterns expect, with wrapped rows, continuation
lines, page turns, noise, and some lines no rule can place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans import testview as T
from ledgerloom.storage import materialize

MONEY = "format_number({0}, 2)"
TAIL = 10_000_000
LONG_LINE = "MARKETING " * 12


def _m(column: str, prefix: str = "$") -> str:
    return f"'{prefix}' || format_number({column}, 2)"


def _lines(df: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """(slot expression, text expression) pairs to rows; null texts are left out."""
    structs = ", ".join(f"struct(cast({slot} as bigint) as slot, {text} as text)" for slot, text in items)
    return df.select("stmt_id", "layout_name", F.expr(f"inline(array({structs}))")).where("text is not null")


def _long(day: str) -> str:
    return f"date_format({day}, 'MMMM d, yyyy')"


HEAD = {
    "chase_checking": [
        ("1", "'JPMorgan Chase Bank, N.A.'"), ("2", f"{_long('period_start')} || ' through ' || {_long('period_end')}"),
        ("3", "case when owner % 2 = 0 then 'Service Center: 1-800-000-0000' end"), ("4", "'Account Number: 00000' || account_last4"),
        ("5", "'CHECKING SUMMARY Chase Total Checking'"), ("6", f"'Beginning Balance ' || {_m('beginning_balance')}"),
        ("7", f"'Deposits and Additions ' || {_m('deposits', '')}"), ("8", f"'Electronic Withdrawals ' || {_m('electronic_withdrawals', '')}"),
        ("9", f"'Ending Balance ' || {_m('ending_balance')}"), ("10", "'TRANSACTION DETAIL'"), ("11", "'DATE DESCRIPTION AMOUNT BALANCE'"),
        ("12", f"'Beginning Balance ' || {_m('beginning_balance')}"),
        (str(TAIL), f"'Ending Balance ' || {_m('ending_balance')}"), (str(TAIL + 1), "'03/05 outside the table 1.00 2.00'"),
    ],
    "chase_credit": [
        ("1", "'ACCOUNT SUMMARY'"), ("2", "'Account Number: XXXX XXXX XXXX ' || account_last4"),
        ("3", f"'Previous Balance ' || {_m('previous_balance')}"), ("4", f"'Payment, Credits ' || {_m('payments_credits')}"),
        ("5", f"'Purchases +' || {_m('purchases')}"), ("6", f"'Cash Advances +' || {_m('cash_advances')}"),
        ("7", f"'Fees Charged +' || {_m('fees_charged')}"), ("8", f"'Interest Charged +' || {_m('interest_charged')}"),
        ("9", f"'New Balance ' || {_m('new_balance')}"),
        ("10", "'Opening/Closing Date ' || date_format(period_start, 'MM/dd/yy') || ' - ' || date_format(period_end, 'MM/dd/yy')"),
        ("11", "case when owner % 2 = 0 then 'Minimum Payment Due: $40.00' end"),
        (str(TAIL), f"'TOTAL FEES FOR THIS PERIOD ' || {_m('total_fees_line')}"),
        (str(TAIL + 1), f"'TOTAL INTEREST FOR THIS PERIOD ' || {_m('total_interest_line')}"),
    ],
    "boa_checking": [
        ("1", "'bankofamerica.com'"),
        ("2", f"'for ' || {_long('period_start')} || ' to ' || {_long('period_end')} || ' Account number: 0000 0000 ' || account_last4"),
        ("3", "'Account summary'"), ("4", f"'Beginning balance on ' || {_long('period_start')} || ' ' || {_m('beginning_balance')}"),
        ("5", f"'Deposits and other additions ' || {_m('deposits', '')}"), ("6", f"'Other subtractions ' || {_m('other_subtractions', '')}"),
        ("7", f"'Ending balance on ' || {_long('period_end')} || ' ' || {_m('ending_balance')}"),
        ("8", "'a line outside every section'"), ("9", "'Deposits and other additions'"), ("10", "'Date Description Amount'"),
        (str(TAIL), f"'Total deposits and other additions ' || {_m('total_deposits')}"),
        (str(TAIL + 1), "'Withdrawals and other subtractions'"), (str(TAIL + 2), "'Other subtractions'"),
        (str(2 * TAIL), f"'Total other subtractions ' || {_m('total_other_subtractions')}"),
    ],
    "wellsfargo_checking": [
        ("1", f"'Statement Date: ' || {_long('period_end')}"), ("2", "'WELLS FARGO BANK, N.A.'"),
        ("3", "'Account Number: 111-222' || account_last4"), ("4", "'Activity summary'"),
        ("5", f"'Balance on ' || date_format(period_start, 'MM/dd') || ' ' || {_m('beginning_balance')}"),
        ("6", f"'Deposits and interest ' || {_m('deposits', '')}"), ("7", "'Activity detail'"), ("8", "'Deposits and interest'"),
        ("9", "'Date Description Amount'"), ("10", "repeat('.', 80)"),
        (str(TAIL), f"'Total deposits and interest ' || {_m('deposits')}"), (str(TAIL + 1), "'Checks'"),
        (str(2 * TAIL), f"'Total checks ' || {_m('checks')}"), (str(2 * TAIL + 1), "'Other withdrawals'"),
        (str(3 * TAIL), f"'Total other withdrawals ' || {_m('other_withdrawals')}"), (str(3 * TAIL + 1), f"'Total withdrawals ' || {_m('withdrawals')}"),
        (str(3 * TAIL + 2), f"'Balance on ' || date_format(period_end, 'MM/dd') || ' ' || {_m('ending_balance')}"),
    ],
}
MMDD = "date_format(date, 'MM/dd')"
AMT = "format_number(amount, 2)"
ABS = "format_number(abs(amount), 2)"
BAL = "format_number(balance, 2)"
ROWS = {
    "chase_checking": [
        ("base", f"case when txn_id % 35 = 4 then {MMDD} || ' No amount here' end"),
        ("base + 1", f"{MMDD} || ' ' || case txn_id % 5 when 1 then description when 2 then substring_index(description, ' ', 1) "
                     f"else description || ' ' || {AMT} || ' ' || {BAL} end"),
        ("base + 2", "case when txn_id % 5 = 2 then substr(description, length(substring_index(description, ' ', 1)) + 2) end"),
        ("base + 3", f"case when txn_id % 5 in (1, 2) then {AMT} || ' ' || {BAL} end"),
        ("base + 4", "case when txn_id % 97 = 0 then 'See reverse side' when txn_id % 9 = 0 then 'Page 2' end"),
    ],
    "chase_credit": [("base", f"{MMDD} || ' ' || description || case when kind = 'payment' then ' PAYMENT' else '' end || ' ' || {AMT}")],
    "boa_checking": [
        ("base", f"date_format(date, 'MM/dd/yy') || ' ' || description || ' ' || {AMT}"),
        ("base + 1", "case when txn_id % 4 = 1 then 'WEB' end"),
        ("base + 2", f"case when txn_id % 36 = 2 then '{LONG_LINE.strip()}' end"),
        ("base + 3", "case when txn_id % 10 = 3 then 'continued on the next page' end"),
        ("base + 4", "case when txn_id % 10 = 3 then case when amount > 0 then 'Deposits and other additions' else 'Other subtractions' end || ' - continued' end"),
    ],
    "wellsfargo_checking": [
        ("base", "checks"),
        ("base", f"case when amount > 0 or description not like 'Check %' then {MMDD} || ' ' || description || case when txn_id % 3 = 1 then '' else ' ' || {ABS} end end"),
        ("base + 1", f"case when (amount > 0 or description not like 'Check %') and txn_id % 3 = 1 then {ABS} end"),
    ],
}

_rendered: dict = {}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with their place in the statement, and the text of paper checks, which are printed two to a line."""
    balances = T.running_rows(spark, sf_dir).select("txn_id", "balance")
    rows = T.transactions(spark, sf_dir).join(balances, "txn_id", "left")
    part = F.when(F.col("amount") > 0, 0).when(F.col("description").startswith("Check "), 1).otherwise(2)
    part = F.when(F.col("layout_name").isin("boa_checking", "wellsfargo_checking"), part).otherwise(0)
    inside = Window.partitionBy("stmt_id", "part").orderBy("date", "txn_id")
    floor = (F.when(F.col("layout_name") == "boa_checking", F.when(F.col("part") > 0, TAIL).otherwise(0))
             .when(F.col("layout_name") == "wellsfargo_checking", F.col("part") * TAIL).otherwise(0))
    check = F.expr(f"""case when layout_name = 'wellsfargo_checking' and amount < 0 and description like 'Check %'
 then struct(substr(description, 7) || case when txn_id % 7 = 0 then '*' else '' end || ' ' || {MMDD} || ' ' || {ABS} as text) end""")
    first = F.col("rank") % 2 == 1
    rows = rows.withColumns({"part": part, "own_check": check}).withColumns({
        "rank": F.row_number().over(inside), "next_check": F.lead("own_check").over(inside), "last_check": F.lag("own_check").over(inside)})
    return rows.withColumn("base", (floor + 100 + F.col("rank") * 5).cast("bigint")).withColumn(
        "checks", F.when(F.col("own_check").isNotNull() & (first | F.col("last_check").isNull()), F.concat_ws(
            " ", "own_check.text", F.when(first, F.col("next_check.text")))))


def _statement_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.statements(spark, sf_dir).select(
        "stmt_id", "owner", "layout_name", "account_last4", "period_start", "period_end",
        *[F.try_element_at("summary", F.lit(k)).alias(k) for k in T.SUMMARY_COLUMNS])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stmt_id, layout_name, page_no, line_no, text)``, published once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rendered:
        statements, rows = _statement_columns(spark, sf_dir), _rows(spark, sf_dir)
        parts = [_lines(statements.where(F.col("layout_name") == n), items) for n, items in HEAD.items()]
        items = [(slot, f"case when layout_name = '{n}' then {text} end") for n, pairs in ROWS.items() for slot, text in pairs]
        parts.append(_lines(rows, items))  # one pass over the rows for all layouts
        everything = parts[0]
        for part in parts[1:]:
            everything = everything.unionByName(part)
        _rendered[key] = materialize(everything.select(
            "stmt_id", "layout_name", (F.floor(F.col("slot") / 100) + 1).cast("int").alias("page_no"),
            F.col("slot").cast("int").alias("line_no"), "text"), "lines")
    return _rendered[key]


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card layout in reading order: section headers above their rows, a page per section."""
    rows = T.transactions(spark, sf_dir).where("layout_name = 'chase_credit'")
    page = F.expr("case kind when 'payment' then 1 when 'credit' then 1 when 'purchase' then 2 when 'cash_advance' then 3 when 'fee' then 4 else 5 end")
    rows = rows.withColumn("page_no", page)
    header = F.expr("case page_no when 1 then 'PAYMENTS AND OTHER CREDITS' when 2 then 'PURCHASE' when 3 then 'CASH ADVANCES' "
                    "when 4 then 'FEES CHARGED' else 'INTEREST CHARGED' end")
    heads = rows.select("stmt_id", "page_no").distinct().select("stmt_id", "page_no", F.lit(0).cast("bigint").alias("line_no"), header.alias("text"))
    body = rows.select("stmt_id", "page_no", (F.col("txn_id") + 1).alias("line_no"), F.expr(
        f"{MMDD} || ' ' || description || case when kind = 'payment' then ' PAYMENT' else '' end || ' ' || {AMT}").alias("text"))
    return heads.unionByName(body)
