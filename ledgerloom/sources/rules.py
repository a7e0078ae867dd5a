"""User rules: loading, validation and the update of one entry.

A rules file is one JSON object with optional sections ``payees``, ``ach`` and ``merchants``.
A few thousand rules are read on the driver once to build expressions; a larger set of merchant rules stays a
DataFrame and is matched through an index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import fixed_values as V

RULE_SCHEMA = "ord int, stage string, pattern string, merchant string, category string"
LISTED_RULES = 2_000
RULES_JSON = T.StructType([
    T.StructField("payees", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ach", T.MapType(T.StringType(), T.StringType())),
    T.StructField("merchants", T.ArrayType(T.StringType())),
])


class RulesError(ValueError):
    """The rules file cannot be used; the message names it."""


@dataclass(frozen=True)
class Rules:
    """User rules in the order they are tried."""
    payees: list = field(default_factory=list)      # (prefix, label, category)
    ach: list = field(default_factory=list)         # (originator id, merchant, category)
    merchants: list = field(default_factory=list)   # (pattern, merchant, category)
    table: DataFrame | None = None                  # merchant rules (ord, pattern, merchant, category) in place of the list


def check_patterns(spark: SparkSession, patterns: list[str], where: str) -> None:
    """Reject a pattern that the regex engine which will run it does not accept."""
    for pattern in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as exc:
            raise RulesError(f"invalid regex in {where}: {pattern!r} -- {exc}") from exc


def rules_frame(spark: SparkSession, path: str) -> DataFrame:
    """The usable rules of a file as ``(ord, stage, pattern, merchant, category)``.

    A missing file gives no rules; broken JSON raises.  Unknown sections are ignored, and so are
    entries without the fields their section needs.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], RULE_SCHEMA)
    raw = spark.read.text(path, wholetext=True)  # a file, or a folder with one part
    valid = raw.select(F.try_parse_json("value").isNotNull().alias("ok")).first()
    if valid is None or not valid["ok"]:
        raise RulesError(f"could not read rules file {path}: not valid JSON")
    doc = raw.select(F.from_json("value", RULES_JSON).alias("r")).select("r.*")
    spec = "struct<label:string,merchant:string,category:string,pattern:string>"

    def entries(section: str, key: str) -> DataFrame:
        return (doc.select(F.posexplode(F.map_entries(section)).alias("pos", "e"))
                .select("pos", F.col("e.key").alias(key),
                        F.from_json("e.value", spec, {"mode": "PERMISSIVE"}).alias("s")))

    payees = entries("payees", "name").where("s.category <> ''").select(
        F.col("pos").alias("ord"), F.lit("payee").alias("stage"), F.col("name").alias("pattern"),
        F.coalesce(F.nullif(F.col("s.label"), F.lit("")), F.initcap("name")).alias("merchant"),
        F.col("s.category").alias("category"))
    ach = (entries("ach", "id").where("s.merchant <> '' and s.category <> ''")
           .groupBy(F.upper(F.trim("id")).alias("pattern"))
           .agg(F.max("pos").alias("ord"), F.max_by("s.merchant", "pos").alias("merchant"),
                F.max_by("s.category", "pos").alias("category"))
           .select("ord", F.lit("ach").alias("stage"), "pattern", "merchant", "category"))
    merchants = (doc.select(F.posexplode("merchants").alias("ord", "m"))
                 .select("ord", F.from_json("m", spec).alias("s"))
                 .where("s.pattern <> '' and s.merchant <> '' and s.category <> ''")
                 .select("ord", F.lit("merchant").alias("stage"), "s.pattern", "s.merchant", "s.category"))
    return payees.unionByName(ach).unionByName(merchants)


def rules_from_frame(frame: DataFrame, most: int = LISTED_RULES) -> Rules:
    """Rules as values for building expressions; merchant rules beyond ``most`` stay a table that is matched by its index.

    Payee and originator rules are prefixes and ids that people enter one by one; both are read whole.
    """
    merchants = frame.where("stage = 'merchant'")
    listed = merchants.orderBy("ord", "pattern").limit(most + 1).collect()
    many = len(listed) > most
    rows = frame.where("stage <> 'merchant'").orderBy("stage", "ord", "pattern").collect()
    by = {s: [(r["pattern"], r["merchant"], r["category"]) for r in rows if r["stage"] == s] for s in ("payee", "ach")}
    return Rules(by["payee"], by["ach"], [] if many else [(r["pattern"], r["merchant"], r["category"]) for r in listed],
                 merchants.select("ord", "pattern", "merchant", "category") if many else None)


def load_rules(spark: SparkSession, path: str, most: int = LISTED_RULES) -> Rules:
    """The rules of a file.  Listed patterns are compiled here; those of a table when they first run."""
    rules = rules_from_frame(rules_frame(spark, path), most)
    check_patterns(spark, ["(?i)" + p for p, _, _ in rules.merchants], path)
    return rules


def shipped_rules(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, "merchant", p, m, c) for i, (p, m, c) in enumerate(V.DESCRIPTOR_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def prepend_rules(user: DataFrame, shipped: DataFrame) -> DataFrame:
    """User merchant rules before the shipped ones: override by order."""
    first = user.where(F.col("stage") == "merchant").withColumn("ord", F.col("ord") - 1_000_000)
    return first.unionByName(shipped)


def upsert_rule(rules: DataFrame, stage: str, pattern: str, merchant: str, category: str) -> DataFrame:
    """Replace the rule with the same (stage, pattern), or append it at the end."""
    spark = rules.sparkSession
    if stage == "merchant":
        check_patterns(spark, [pattern], "the new rule")
    if stage == "ach":
        pattern = pattern.strip().upper()
    kept = remove_rule(rules, stage, pattern)
    last = rules.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"))
    new = last.select(F.col("ord").cast("int").alias("ord"), F.lit(stage).alias("stage"),
                      F.lit(pattern).alias("pattern"), F.lit(merchant).alias("merchant"),
                      F.lit(category).alias("category"))
    return kept.unionByName(new)


def remove_rule(rules: DataFrame, stage: str, pattern: str) -> DataFrame:
    return rules.where(~((F.col("stage") == stage) & (F.col("pattern") == pattern)))


def save_rule(spark: SparkSession, path: str, section: str, key: str, merchant: str, category: str,
              remove: bool = False) -> None:
    """Update one entry of a rules file; sections this library does not know are kept as they are."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    text = spark.read.text(path, wholetext=True).first()["value"] if fs.exists(fs_path) else "{}"
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as exc:
        raise RulesError(f"could not read rules file {path}: {exc}") from exc
    if section == "merchants":
        check_patterns(spark, [key], "the new rule")
        kept = [r for r in doc.get("merchants") or []
                if not (isinstance(r, dict) and r.get("pattern") == key)]
        if not remove:
            kept.append({"pattern": key, "merchant": merchant, "category": category})
        doc["merchants"] = kept
    elif section == "ach":
        table = doc.setdefault("ach", {})
        table.pop(key.strip().upper(), None)
        if not remove:
            table[key.strip().upper()] = {"merchant": merchant, "category": category}
    else:
        raise RulesError(f"unknown section {section!r}")
    staged = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(staged, True)
    out.write(bytearray((json.dumps(doc, indent=2, ensure_ascii=False) + "\n").encode()))
    out.close()
    # one step replaces the old file, so there is no moment without rules
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(fs_path), how)
