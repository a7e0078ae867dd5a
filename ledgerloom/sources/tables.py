"""Reading and writing the published ledger tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import spend as S
from ledgerloom.operators.reconcile import statement_ok

TRANSACTION_SCHEMA = (
    "account string, account_last4 string, date date, merchant string, category string, description string, "
    "amount decimal(18,2), signed decimal(18,2), kind string, balance decimal(18,2), statement_close date, "
    "period_start date, period_end date, source_file string, source_line bigint")


def summary_keys(statements: DataFrame) -> DataFrame:
    """The union of all printed labels.  Labels come from layouts, so there are few."""
    return statements.select(F.explode(F.map_keys("summary")).alias("key")).distinct()


def column_names(values: DataFrame, what: str, most: int = 1000) -> list[str]:
    """Values that become columns, sorted; too many for a table is an error, never a cut."""
    names = [r[0] for r in values.orderBy(values.columns[0]).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} {what}; use the long form")
    return names


def export_by_month(transactions: DataFrame) -> DataFrame:
    """The export with its month, for tables in folders by month: every file holds its month in export order.

    Rows are dealt out by ranges of (month, export order) and sorted where they then lie, so a month is in few files and no
    total order is made.
    """
    order = ["month", *S.LEDGER_ORDER]
    rows = _with_balance(transactions).select(*V.TRANSACTION_FIELDS).withColumn("month", F.date_format("date", "yyyy-MM"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _with_balance(transactions: DataFrame) -> DataFrame:
    if "balance" in transactions.columns:
        return transactions
    return transactions.withColumn("balance", F.lit(None).cast("decimal(18,2)"))


def export_transactions(transactions: DataFrame) -> DataFrame:
    """Export columns in export order, sorted."""
    return S.ledger_order(_with_balance(transactions)).select(*V.TRANSACTION_FIELDS)


def export_statements(statements: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per statement, every printed label of the corpus a column."""
    keys = column_names(summary_keys(statements), "printed labels")
    ok = statement_ok(statements, checks).select("stmt_id", F.col("ok").alias("checks_passed"))
    return S.report_order(statements.join(ok, "stmt_id")).select(
        "account", "account_last4", F.col("source_file").alias("file"), "period_start", "period_end", "txn_count",
        "checks_passed", *[F.try_element_at("summary", F.lit(k)).alias(k) for k in keys])


def export_statement_values(statements: DataFrame) -> DataFrame:
    """The long form of the printed values, for any number of labels: one row per statement and label."""
    return statements.select("account", "account_last4", F.col("source_file").alias("file"), "period_start",
                             F.explode("summary")).where("value is not null")


def export_by_category_long(transactions: DataFrame) -> DataFrame:
    """Month x category spend, zero-filled, with the sum of the cells as ``total``."""
    cells = S.category_month_matrix(transactions).withColumn("spend", F.round("spend", 2).cast("decimal(28,2)"))
    totals = cells.groupBy("month").agg(F.sum("spend").alias("spend")).select("month", F.lit("total").alias("category"), "spend")
    return cells.select("month", "category", "spend").unionByName(totals)


def export_by_category(transactions: DataFrame) -> DataFrame:
    """The same as a matrix, a column per category.  Categories come from rules, so there are few."""
    names = column_names(S.spend_rows(transactions).select("category").distinct(), "categories")
    wide = export_by_category_long(transactions).groupBy("month").pivot("category", [*names, "total"]).agg(F.first("spend"))
    return wide.orderBy("month")


def gate(totals: DataFrame, force: bool = False) -> DataFrame:
    """Whether tables may be written: no failed check, no unparsed line, no problem -- or forced."""
    clean = (F.col("failed_checks") == 0) & (F.col("unparsed") == 0) & (F.col("problems") == 0)
    return totals.select("failed_checks", "unparsed", "problems", (clean | F.lit(force)).alias("may_write"))


def gated_write(tables: dict[str, DataFrame], totals: DataFrame, root: str, *, force: bool = False,
                strict: bool = False, fmt: str = "csv", partition_by: dict[str, list[str]] | None = None) -> bool:
    """Write all tables or none, those named in ``partition_by`` in folders by their columns.

    Tables go to a staging folder first, which then becomes ``<root>/<version>``; readers follow
    ``<root>/CURRENT``, so they see the old version or the new one.  Returns whether anything was
    written; with ``strict`` an unclean report raises after that.
    """
    verdict = gate(totals).first()
    if verdict["may_write"] or force:
        spark = totals.sparkSession
        version = uuid.uuid4().hex
        staged = f"{root}/.staging-{version}"
        for name, df in tables.items():
            writer = df.write.option("header", True) if fmt == "csv" else df.write
            writer.format(fmt).partitionBy(*(partition_by or {}).get(name, [])).save(f"{staged}/{name}")
        hadoop = spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.rename(hadoop.Path(staged), hadoop.Path(f"{root}/{version}")):
            raise IOError(f"could not publish {root}/{version}")
        out = fs.create(hadoop.Path(f"{root}/CURRENT"), True)
        out.write(bytearray(version.encode()))
        out.close()
    if strict and not verdict["may_write"]:
        raise RuntimeError(f"unclean report: {verdict.asDict()}")
    return bool(verdict["may_write"] or force)


def current_version(spark: SparkSession, root: str) -> str:
    return f"{root}/" + spark.read.text(f"{root}/CURRENT", wholetext=True).first()["value"].strip()


def read_ledger(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """An exported transactions table with its month; in Parquet the months are folders, so a period reads its own."""
    if fmt == "parquet":
        return spark.read.schema(f"{TRANSACTION_SCHEMA}, month string").parquet(f"{path}/transactions")
    return (spark.read.schema(TRANSACTION_SCHEMA).option("header", True).csv(f"{path}/transactions")
            .withColumn("month", F.date_format("date", "yyyy-MM")))
