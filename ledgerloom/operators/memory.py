"""Remembered classification: a text is classified when it is new, or when a changed rule could touch it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators.classify import classify_texts, with_rule_table
from ledgerloom.sources.rules import RULE_SCHEMA, Rules
from ledgerloom.storage import Workspace, broadcast_if_small, materialize, remove_path, spread

KEY = ["text", "account", "kind"]
OUTCOMES = "text string, account string, kind string, merchant string, category string, version bigint"


def rules_frame_of(spark: SparkSession, rules: Rules) -> DataFrame:
    """Rules as a table (ord, stage, pattern, merchant, category); ``ord`` is the order within a stage."""
    rows = [(i, stage, *r) for stage, listed in (("payee", rules.payees), ("ach", rules.ach), ("merchant", rules.merchants))
            for i, r in enumerate(listed)]
    frame = spark.createDataFrame(rows, RULE_SCHEMA)
    if rules.table is not None:
        frame = frame.unionByName(rules.table.select("ord", F.lit("merchant").alias("stage"), "pattern", "merchant", "category"))
    return frame


def changed_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stage, pattern) of rules that were added, removed or altered, or that changed places with another.

    A rule that merely moves along because one before it came or went is not changed.
    """
    same = ["stage", "pattern", "merchant", "category"]
    counted = lambda df: df.groupBy(*same).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    old, new = materialize(counted(before), "old_rules"), materialize(counted(after), "new_rules")
    both = old.withColumnsRenamed({"ord": "old_ord", "n": "old_n"}).join(
        new.withColumnsRenamed({"ord": "new_ord", "n": "new_n"}), same, "full")
    kept = both.where("old_ord is not null and new_ord is not null and old_n = new_n")
    rank = lambda c: F.row_number().over(Window.partitionBy("stage").orderBy(c, *same))
    moved = kept.withColumns({"old_rank": rank("old_ord"), "new_rank": rank("new_ord")}).where("old_rank <> new_rank")
    lost = both.where("old_ord is null or new_ord is null or old_n <> new_n")
    return moved.select("stage", "pattern").union(lost.select("stage", "pattern")).distinct()


def touched_by(texts: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of ``texts`` (text, account, kind) that a rule of ``changed`` (stage, pattern) could have a say in."""
    deposit = F.col("kind") == "deposit"
    subject = F.upper(F.when(deposit, F.trim(F.regexp_replace("text", V.DATE_PREFIX, ""))).otherwise(F.col("text")))
    rail = X.rail_counterparty(F.trim(F.regexp_replace(X.strip_wrappers(F.col("text")), V.TRAILING_STATE, "")))
    named = texts.withColumns({"subject": subject, "id": F.upper(F.trim(X.ach_originator(F.col("text")))), "who": F.upper(rail)})
    numbered = changed.where("stage = 'merchant'").select(
        F.monotonically_increasing_id().alias("ord"), "pattern", F.lit("x").alias("merchant"), F.lit("x").alias("category"))
    by_rule = with_rule_table(named, "subject", materialize(numbered, "changed"), "hit").where("hit is not null")
    ids = changed.where("stage = 'ach'").select(F.upper(F.trim("pattern")).alias("id")).distinct()
    by_id = named.join(ids, "id", "left_semi")
    prefixes = changed.where("stage = 'payee'").select(F.upper("pattern").alias("prefix"), F.length("pattern").alias("size")).distinct()
    sizes = [r["size"] for r in prefixes.select("size").distinct().collect()]
    starts = named.where("who is not null").withColumn("prefix", F.explode(F.array(*[F.left("who", F.lit(n)) for n in sizes]))) if sizes else None
    found = by_rule.select(*KEY).union(by_id.select(*KEY))
    if starts is not None:
        found = found.union(starts.join(prefixes, "prefix", "left_semi").select(*KEY))
    return found.distinct()


class ClassificationMemory:
    """A table of outcomes keyed by (text, account, kind) and version of the rules, in a folder of the caller.

    ``outcomes/version=n`` holds what was classified under version n, the latest of a key counts;
    ``rules/version=n`` the rules of a version, written last, so a version without rules was not finished and is
    done again.  ``counts`` tells how many texts the last run classified, as new and as touched by changed rules.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.counts: dict[str, int] = {}

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rules")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=")
                      and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rules/{n}/_SUCCESS")))

    def outcomes(self, version: int | None = None) -> DataFrame:
        """(text, account, kind, merchant, category): the latest outcome of each key up to a version."""
        versions = self._versions()
        version = version or (versions[-1] if versions else 0)
        if not version:
            return self.spark.createDataFrame([], OUTCOMES).drop("version")
        rows = self.spark.read.schema(OUTCOMES).option("basePath", f"{self.root}/outcomes").parquet(f"{self.root}/outcomes")
        last = rows.where(F.col("version") <= version).groupBy(*KEY).agg(
            F.max_by(F.struct("merchant", "category"), "version").alias("o"))
        return last.select(*KEY, "o.merchant", "o.category")

    def _write(self, texts: DataFrame, rules: Rules, version: int, why: str, mode: str) -> None:
        seen = Observation(f"{why}-{uuid.uuid4().hex}")
        classified = classify_texts(spread(texts.select(*KEY), "text"), rules).select(*KEY, "merchant", "category")
        classified.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(f"{self.root}/outcomes/version={version}")
        self.counts[why] = seen.get["n"]

    def update(self, transactions: DataFrame, rules: Rules | None = None) -> DataFrame:
        """Bring the memory up to these rows and rules, and return its outcomes."""
        rules = rules or Rules()
        self.counts = {"new": 0, "touched": 0}
        wanted = transactions.select(X.match_text(F.col("descriptor"), F.col("description")).alias("text"), "account", "kind").dropna().distinct()
        with Workspace(self.spark, "memory"):
            now = materialize(rules_frame_of(self.spark, rules), "rules")
            versions = self._versions()
            version = versions[-1] if versions else 0
            touched = None
            if version:
                changed = materialize(changed_rules(self.spark.read.schema(RULE_SCHEMA).parquet(f"{self.root}/rules/version={version}"), now), "changed")
                if not changed.isEmpty():
                    touched = materialize(touched_by(self.outcomes().select(*KEY), changed), "touched")
            if version and touched is None:
                missing = materialize(wanted.join(self.outcomes(), KEY, "left_anti"), "missing")
                if not missing.isEmpty():
                    self._write(missing, rules, version, "new", "append")
                return self.outcomes()
            after = version + 1
            missing = materialize(wanted.join(self.outcomes(), KEY, "left_anti") if version else wanted, "missing")
            remove_path(self.spark, f"{self.root}/outcomes/version={after}")  # of a run that did not finish
            self._write(missing, rules, after, "new", "overwrite")
            if touched is not None:
                self._write(touched, rules, after, "touched", "append")
            now.write.mode("overwrite").parquet(f"{self.root}/rules/version={after}")
        return self.outcomes()

    def classify(self, transactions: DataFrame, rules: Rules | None = None) -> DataFrame:
        """``transactions`` with ``merchant`` and ``category``, as ``with_classification`` gives them.

        A row without text, account or kind has no key and gets nulls.
        """
        known = self.update(transactions, rules)
        keyed = transactions.withColumn("text", X.match_text(F.col("descriptor"), F.col("description")))
        return keyed.join(broadcast_if_small(known), KEY, "left").drop("text")
