"""Registered queries over sources: files, exported tables, case files and rule files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.plans import check_sql as C
from ledgerloom.operators import spend as SP
from ledgerloom.plans import testview as T
from ledgerloom.plans.check_sql import d, on_ledger, s
from ledgerloom.plans.registry import add
from ledgerloom.sources import cases as CS
from ledgerloom.sources import lines as LN
from ledgerloom.sources import rules as RU
from ledgerloom.sources import tables as TB
from ledgerloom.storage import checkpoint_root



def _customer_files(k, f):
    """A file of customers for each nation, in folders, beside hidden ones and files of another kind; found again."""
    root = f"{checkpoint_root(k)}/files-{uuid.uuid4().hex}"
    rows = T.read(k, f, "customer").select("c_nationkey", F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    dealt = rows.repartition("c_nationkey")
    dealt.write.partitionBy("c_nationkey").text(f"{root}/nations")
    dealt.write.partitionBy("c_nationkey").text(f"{root}/.hidden")
    dealt.write.partitionBy("c_nationkey").csv(f"{root}/others")
    return LN.discover(k, root, "TXT").select(
        F.regexp_extract("path", "c_nationkey=([0-9]+)/", 1).alias("nation"), F.col("size").cast("bigint").alias("size"))


add("s1_discover", _customer_files,
    """select cast(c_nationkey as varchar) as nation,
 cast(sum(strlen(concat_ws('|', c_custkey, c_name, c_mktsegment)) + 1) as bigint) as size from customer group by 1""")


def _exported(k, f):
    path = f"{checkpoint_root(k)}/export-{uuid.uuid4().hex}"
    TB.export_transactions(T.ledger(k, f)).write.option("header", True).csv(f"{path}/transactions")
    return TB.read_ledger(k, path)


add("s3_read_ledger", lambda k, f: _exported(k, f).select("account", "date", "month", "merchant", "category", "description", "amount", "signed", "kind", "source_line"),
    on_ledger(f"select account, {s('date')}, month, merchant, category, description, {d('amount')}, {d('signed')}, kind, source_line from ledger"))


def _picked_months(k, f):
    """The last months of a ledger that was published in folders by month."""
    root = f"{checkpoint_root(k)}/by-month-{uuid.uuid4().hex}"
    clean = T.ledger(k, f).agg(*[F.lit(0).alias(c) for c in ("failed_checks", "unparsed", "problems")])
    TB.gated_write({"transactions": TB.export_by_month(T.ledger(k, f))}, clean, root, fmt="parquet", partition_by={"transactions": ["month"]})
    ledger = TB.read_ledger(k, TB.current_version(k, root), "parquet")
    return SP.period_filter(ledger, SP.period_months(ledger.select("month").distinct(), 6))


add("k1_ledger_by_month", lambda k, f: _picked_months(k, f).select("date", "month", "merchant", "category", "signed", "source_line"),
    on_ledger(f"""select {s('date')}, month, merchant, category, {d('signed')}, source_line from ledger
 where month in (select month from ledger group by 1 order by 1 desc limit 6)"""))


def _case_lines(k, f):
    row = F.to_json(F.struct("description", "account", "kind", F.col("merchant").alias("expected_merchant"), F.col("category").alias("expected_category")))
    return T.ledger(k, f).select(F.col("txn_id").alias("line_no"), F.when(F.col("txn_id") % 10 == 0, "# a comment")
                                 .when(F.col("txn_id") % 10 == 1, "   ").otherwise(row).alias("value"))


def _case_files(k, f):
    """The case lines written as files and loaded again."""
    path = f"{checkpoint_root(k)}/cases-{uuid.uuid4().hex}"
    _case_lines(k, f).select("value").write.text(path)
    return CS.load_eval_cases(k, path)


add("s4_load_eval_cases_from_files", lambda k, f: _case_files(k, f).drop("line_no"),
    on_ledger("select description, account, kind, merchant as expected_merchant, category as expected_category from ledger where txn_id % 10 > 1"))
add("s4_load_eval_cases", lambda k, f: CS.parse_cases(_case_lines(k, f), "cases"),
    on_ledger("select txn_id as line_no, description, account, kind, merchant as expected_merchant, category as expected_category from ledger where txn_id % 10 > 1"))


def _rules_document(k, f):
    """A rules file written from the nation and region tables."""
    nation, region = T.read(k, f, "nation"), T.read(k, f, "region")
    merchants = nation.orderBy("n_nationkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("pattern"), F.col("n_name").alias("merchant"),
        F.when(F.col("n_nationkey") % 5 > 0, "Travel").alias("category"))))).alias("m"))
    payees = region.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(
        F.lit('"'), F.col("r_name"), F.lit('": {"category": "Housing"}')))), ", "), F.lit("}")).alias("p"))
    ach = nation.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(
        F.lit('" id'), F.col("n_nationkey").cast("string"), F.lit(' ": {"merchant": "'), F.col("n_name"), F.lit('", "category": "Utilities"}')))), ", "), F.lit("}")).alias("a"))
    doc = merchants.withColumns({"p": payees.scalar(), "a": ach.scalar()}).select(
        F.concat(F.lit('{"_comment": "kept", "payees": '), F.col("p"), F.lit(', "ach": '), F.col("a"), F.lit(', "merchants": '), F.col("m"), F.lit("}")).alias("value"))
    path = f"{checkpoint_root(k)}/rules-{uuid.uuid4().hex}"
    doc.coalesce(1).write.text(path)
    return RU.rules_frame(k, path)


add("s5_load_rules", lambda k, f: _rules_document(k, f).select("stage", "pattern", "merchant", "category"),
    """select 'merchant' as stage, n_name as pattern, n_name as merchant, 'Travel' as category from nation where n_nationkey % 5 > 0
 union all select 'payee', r_name, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' '), 'Housing' from region
 union all select 'ach', 'ID' || n_nationkey, n_name, 'Utilities' from nation""")
