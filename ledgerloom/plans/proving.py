"""From statement pages to a proved ledger: detect, extract, reconcile, check, classify, gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import continuity as N
from ledgerloom.operators import detect as D
from ledgerloom.operators import extract as P
from ledgerloom.operators import reconcile as R
from ledgerloom.operators.classify import with_classification
from ledgerloom.operators.layouts import SHIPPED, Layout
from ledgerloom.operators.scan import key_sizes
from ledgerloom.operators.spend import with_signed
from ledgerloom.sources.lines import explode_lines
from ledgerloom.sources.rules import Rules
from ledgerloom.sources.tables import (export_by_category, export_by_category_long, export_by_month, export_statement_values,
                                      export_statements, export_transactions, gated_write)
from ledgerloom.storage import Workspace, materialize, materialize_counted

SUMMARY = "map<string,decimal(18,2)>"


@dataclass
class Proved:
    """A read corpus: tables, and everything that speaks against them."""
    detections: DataFrame
    statements: DataFrame
    transactions: DataFrame
    checks: DataFrame
    unparsed: DataFrame
    problems: DataFrame
    spaces: tuple[Workspace, ...] = ()
    counts: dict[str, int] = field(default_factory=dict)  # taken while the tables were written

    def close(self) -> None:
        """Remove the tables of this corpus from the checkpoint folder; its frames cannot be read after that."""
        for space in self.spaces:
            space.close()

    def totals(self) -> DataFrame:
        """Totals and the verdict: from counts of the tables as they were written, without reading them again."""
        names = ["statements", "transactions", "failed_checks", "unparsed", "problems"]
        if any(n not in self.counts for n in names):
            return N.run_totals(self.statements, self.transactions, self.checks, self.unparsed, self.problems)
        row = self.transactions.sparkSession.createDataFrame([[self.counts[n] for n in names]], ", ".join(f"{n} bigint" for n in names))
        return N.with_verdict(row)

    def write(self, root: str, force: bool = False, strict: bool = False, fmt: str = "csv", wide: bool = True) -> bool:
        """Publish the three tables, only if nothing failed (or forced).

        ``wide``: printed labels and categories as columns, which needs fewer than a thousand of each; else in long form.
        """
        with Workspace(self.transactions.sparkSession, "write"):
            export = export_by_month if fmt == "parquet" else export_transactions
            tables = {"transactions": export(self.transactions),
                      "statements": export_statements(self.statements, self.checks) if wide else export_statement_values(self.statements),
                      "by_category": (export_by_category if wide else export_by_category_long)(self.transactions)}
            months = {"transactions": ["month"]} if fmt == "parquet" else None
            return gated_write(tables, self.totals(), root, force=force, strict=strict, fmt=fmt, partition_by=months)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def prove_lines(lines: DataFrame, detections: DataFrame, layout_lines: DataFrame, rules: Rules | None = None,
                key: list[str] | None = None, identity: DataFrame | None = None, layouts: tuple[Layout, ...] = SHIPPED) -> Proved:
    """``lines`` carry ``layout_name``; ``layout_lines`` are statements in reading order, for layouts with sections.

    ``identity`` may add columns per statement (such as an owner) that ``key`` then uses to tell
    accounts apart.  All intermediate tables are removed; those of the result go with ``close``.
    """
    with Workspace(lines.sparkSession, "prove") as space:
        return _prove_lines(space, lines, detections, layout_lines, rules, key or list(N.ACCOUNT), identity, layouts)


def _prove_lines(space: Workspace, lines: DataFrame, detections: DataFrame, layout_lines: DataFrame, rules: Rules | None,
                 key: list[str], identity: DataFrame | None, layouts: tuple[Layout, ...]) -> Proved:
    of = {layout.name: P.of_layout(lines, layout.name) for layout in layouts}
    sizes = {name: key_sizes(part, P.DOC) for name, part in of.items()}
    fields = {x.name: materialize(P.header_fields(of[x.name], x, sizes[x.name]), "headers") for x in layouts}
    heads = []
    for layout in layouts:
        head = fields[layout.name].drop("running")
        printed = P.layout_summary(of[layout.name], layout, fields[layout.name], sizes[layout.name])
        head = head.join(P.summary_map(printed), "stmt_id", "left") if printed is not None else \
            head.withColumn("summary", F.lit(None).cast(SUMMARY))
        heads.append(head.withColumns({"account": F.lit(layout.account), "layout_name": F.lit(layout.name)}))
    heads = _union(heads).withColumns({
        "summary": F.coalesce("summary", F.create_map().cast(SUMMARY)),
        "close_date": F.col("period_end"), "source_file": F.col("stmt_id")})
    if identity is not None:
        heads = heads.join(identity, "stmt_id", "left")
    readable = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    heads, counts = materialize_counted(heads, "statements", statements=F.count_if(readable))
    heads = space.keep(heads)
    statements = heads.where(readable)

    periods = {name: f.select("stmt_id", "period_start", "period_end") for name, f in fields.items()}
    parsed = _union([P.parse_layout(of[x.name], x, periods[x.name], layout_lines, sizes[x.name]) for x in layouts])
    # a row of a document that cannot be placed in time is reported, not dropped
    lost = F.col("unreadable") & (F.col("outcome") == "row")
    parsed, found = materialize_counted(parsed.join(heads.select("stmt_id", (~readable).alias("unreadable")), "stmt_id").withColumns({
        "text": F.when(lost & (F.col("text") == ""), F.col("description")).otherwise(F.col("text")),
        "outcome": F.when(lost, F.lit("unparsed")).otherwise(F.col("outcome"))}).drop("unreadable"), "parsed", unparsed=F.count_if(F.col("outcome") == "unparsed"))
    parsed, counts = space.keep(parsed), counts | found
    carried = [c for c in dict.fromkeys(["account", "account_last4", "layout_name", *key])]
    rows = parsed.where("outcome = 'row'").drop("outcome", "text").join(
        statements.select("stmt_id", *carried, "period_start", "period_end", "source_file",
                          F.col("close_date").alias("statement_close")), "stmt_id")
    rows = with_signed(rows).withColumns({
        "month": X.month_key(F.col("date")), "txn_id": F.struct("stmt_id", "source_line"),
        "descriptor": F.when(F.col("layout_name").isin([x.name for x in layouts if x.strips_envelope]), X.strip_envelope(F.col("description"))).otherwise("")})
    transactions, found = materialize_counted(with_classification(rows, rules), "transactions", transactions=F.count(F.lit(1)))
    transactions, counts = space.keep(transactions), counts | found
    per_statement = transactions.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("txn_count"))
    statements = statements.join(per_statement, "stmt_id", "left").fillna(0, ["txn_count"])

    printed = transactions.withColumn("block", F.floor(F.col("source_line") / 1000))
    walked = F.col("layout_name").isin([x.name for x in layouts if x.walks_balance])
    checks = R.total_checks(statements, transactions, specs=layouts).unionByName(R.running_balance_breaks(
        statements, printed.where(walked), segments=["block"], order=["source_line"], specs=layouts))
    problems = unreadable_documents(heads.where(~readable)).unionByName(N.continuity(
        statements, transactions, key, [x.registered() for x in layouts]))
    checks, failed = materialize_counted(checks, "checks", failed_checks=F.count_if(~F.col("ok")))
    problems, found = materialize_counted(problems, "problems", problems=F.count(F.lit(1)))
    return Proved(detections, statements, transactions, space.keep(checks), P.unparsed_report(parsed), space.keep(problems),
                  (space,), counts | failed | found)


def unreadable_documents(heads: DataFrame) -> DataFrame:
    """Detected documents without a period, or without the dated balance that opens it, as problems."""
    dated = F.col("period_end").isNotNull()
    kind = F.when(dated, "no_balances").otherwise("no_period")
    detail = F.when(dated, "the balances that open and close the statement were not found").otherwise(
        "the statement period was not found")
    return heads.select(F.lit("document").alias("scope"), *N.ACCOUNT, "stmt_id", kind.alias("kind"), detail.alias("detail"),
                        *[F.lit(None).cast("decimal(28,2)").alias(c) for c in ("measured", "expected")])


def prove(pages: DataFrame, layout_pages: DataFrame | None = None, rules: Rules | None = None,
          key: list[str] | None = None, layouts: tuple[Layout, ...] = SHIPPED) -> Proved:
    """``pages(stmt_id, page_no, text)`` to a proved ledger.  A bank of one's own is one more value in ``layouts``.

    ``layout_pages`` is the same text in reading order, used to label card rows by section; without
    it rows are labelled by sign and words.
    """
    with Workspace(pages.sparkSession, "read") as space:
        detections = space.keep(materialize(D.detect(pages, layouts=[x.registered() for x in layouts]), "detections"))
        matched = detections.where(F.col("layout_name").isNotNull()).select("stmt_id", "layout_name")
        lines = materialize(explode_lines(pages).join(matched, "stmt_id"), "lines")
        reading = explode_lines(layout_pages if layout_pages is not None else pages.where(F.lit(False)))
        proved = prove_lines(lines, detections, reading, rules, key, layouts=tuple(layouts))
    proved.spaces += (space,)
    return proved
