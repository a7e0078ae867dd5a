"""Descriptor classification: (text, account, kind) to (merchant, category).

Texts repeat heavily, so the rules run once per distinct (text, account, kind).  The result is
written as a table before it is joined back: without that cut Catalyst would push predicates on the
result below the de-duplication and run the rules on every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators.rule_index import indexed_matches, with_literals
from ledgerloom.sources.rules import RULE_SCHEMA, Rules
from ledgerloom.storage import broadcast_if_small, materialize, spread

CHUNK = 20
STAGE_RULES = 400


def first_match(subject: str, patterns: list[str], offset: int = 0, flags: str = "") -> Column:
    """1-based position of the first pattern found in column ``subject``, else null.

    One search tells whether any pattern, then whether any of a chunk, can match: most texts are done after the first.
    """
    chunks = []
    for start in range(0, len(patterns), CHUNK):
        part = patterns[start:start + CHUNK]
        branches = [f"when {X.matches_sql(subject, pattern, flags)} then {i}" for i, pattern in enumerate(part, start + offset + 1)]
        first = "case " + " ".join(branches) + " end"
        chunks.append(f"case when {X.may_match_sql(subject, part, flags)} then {first} end" if len(part) > 2 else first)
    if not chunks:
        return F.expr("cast(null as int)")
    every = f"coalesce({', '.join(chunks)})"
    return F.expr(every if len(chunks) == 1 else f"case when {X.may_match_sql(subject, patterns, flags)} then {every} end")


def with_rule_match(df: DataFrame, subject: str, rules: list, target: str, flags: str = "") -> DataFrame:
    """Struct ``target(merchant, category)`` of the first rule that matches, in rule order.

    Long rule lists are worked off in stages of a few hundred, so that cost stays linear and no
    generated method grows without bound; there is never a join of rows with rules.
    """
    number = f"{target}_no"
    df = df.withColumn(number, F.lit(None).cast("int"))
    for start in range(0, len(rules), STAGE_RULES):
        patterns = [p for p, _, _ in rules[start:start + STAGE_RULES]]
        df = df.withColumn(number, F.coalesce(F.col(number),
                                              first_match(subject, patterns, start, flags)))
    if not rules:
        empty = F.struct(F.lit(None).cast("string").alias("merchant"),
                         F.lit(None).cast("string").alias("category"))
        return df.withColumn(target, F.when(F.lit(False), empty)).drop(number)
    merchants = F.expr(f"array({', '.join(X.sql_literal(m) for _, m, _ in rules)})")
    categories = F.expr(f"array({', '.join(X.sql_literal(c) for _, _, c in rules)})")
    return df.withColumn(target, F.when(F.col(number).isNotNull(), F.struct(
        F.element_at(merchants, F.col(number)).alias("merchant"),
        F.element_at(categories, F.col(number)).alias("category")))).drop(number)


def with_rule_table(df: DataFrame, subject: str, rules: DataFrame, target: str, flags: str = "(?i)") -> DataFrame:
    """As ``with_rule_match``, for ``rules`` (ord, pattern, merchant, category) of any number.

    Rules with a required literal go through the index; the rest are tried as expressions, in ``ord``.  Of several rules with
    one ``ord`` the one with the smallest pattern counts.
    """
    rules = materialize(with_literals(rules.groupBy("ord").agg(F.min(F.struct("pattern", "merchant", "category")).alias("r"))
                                      .select("ord", "r.*")), "rules")
    found = indexed_matches(df, subject, rules.where("literals is not null"), flags)
    others = rules.where("literals is null").select("pattern", F.col("ord").cast("string").alias("ord")).orderBy(F.col("ord").cast("bigint")).collect()
    if others:
        texts = spread(df.select(F.col(subject).alias("subject")).where("subject is not null").distinct(), "subject")
        tried = with_rule_match(texts, "subject", [(r["pattern"], r["ord"], "") for r in others], "hit", flags)
        found = found.unionByName(tried.where("hit is not null").select("subject", F.col("hit.merchant").cast("bigint").alias("ord")))
        found = found.groupBy("subject").agg(F.min("ord").alias("ord"))
    hits = materialize(found.join(rules, "ord").select(F.col("subject").alias(subject), F.struct("merchant", "category").alias(target)), "hits")
    return df.join(broadcast_if_small(hits), subject, "left")


def with_originator_rule(df: DataFrame, originator: str, ach_rules: DataFrame, target: str) -> DataFrame:
    """Struct of the rule keyed on the originator id (an equi lookup on ``upper(trim(id))``).

    Of several rules with one id the last wins, so the lookup never multiplies rows.
    """
    table = ach_rules.groupBy(F.upper(F.trim("pattern")).alias("ach_key")).agg(
        F.max_by(F.struct("merchant", "category"), "ord").alias(target))
    keyed = df.withColumn("ach_key", F.upper(F.trim(originator)))
    return keyed.join(broadcast_if_small(table), "ach_key", "left").drop("ach_key")


def with_rail_outcome(df: DataFrame, text: str, payees: list, target: str) -> DataFrame:
    """Person-to-person payments by counterparty: ``target(merchant, category)`` or null."""
    who = f"{target}_who"
    df = df.withColumn(who, X.rail_counterparty(F.col(text)))
    label = X.titlecase(F.col(who))
    found = F
    for prefix, name, category in payees:
        found = found.when(F.upper(F.col(who)).startswith(prefix.upper()), _pair(
            F.concat(F.lit(name + " ("), label, F.lit(")")), F.lit(category)))
    other = _pair(F.concat(F.lit("To "), label), F.lit(V.PEOPLE))
    named = found.otherwise(other) if payees else other
    return df.withColumn(target, F.when(
        F.upper(text).rlike(V.RAIL_RECEIVED), _pair(F.lit(V.RAIL_RECEIVED_MERCHANT), F.lit(V.INCOME)))
        .when(F.col(who) == "", _pair(F.lit(V.RAIL_BLANK_MERCHANT), F.lit(V.PEOPLE)))
        .when(F.col(who).isNotNull(), named)).drop(who)


def _pair(merchant: Column, category: Column) -> Column:
    return F.struct(merchant.cast("string").alias("merchant"), category.cast("string").alias("category"))


def classify_texts(texts: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Add ``merchant`` and ``category`` to a frame with ``text, account, kind``."""
    rules = rules or Rules()
    spark = texts.sparkSession
    deposit = F.coalesce(F.col("kind") == "deposit", F.lit(False))
    card_payment = (F.col("kind") == "payment") & (F.col("account") == "credit")
    df = texts.withColumns({
        "subject_text": F.when(deposit, F.trim(F.regexp_replace("text", V.DATE_PREFIX, ""))).otherwise(F.col("text")),
        "rail_text": F.trim(F.regexp_replace(X.strip_wrappers(F.col("text")), V.TRAILING_STATE, "")),
        "originator": X.ach_originator(F.col("text")),
    }).withColumns({
        "subject": F.upper("subject_text"),
        "payee_text": X.strip_ach_tail(F.col("subject_text")),
    })
    if rules.table is not None:
        df = with_rule_table(df, "subject", rules.table, "user_hit")
    else:
        df = with_rule_match(df, "subject", rules.merchants, "user_hit", "(?i)")
    df = with_rail_outcome(df, "rail_text", rules.payees, "rail_hit")
    if rules.ach:
        table = spark.createDataFrame(
            [(i, "ach", p, m, c) for i, (p, m, c) in enumerate(rules.ach)], RULE_SCHEMA)
        df = with_originator_rule(df, "originator", table, "ach_hit")
    else:
        df = df.withColumn("ach_hit", F.when(F.lit(False), _pair(F.lit(None), F.lit(None))))
    # the costly steps see only the texts that no step before them settles: the others are null to them
    settled = F.coalesce(F.col("kind").isin(*V.KIND_OUTCOMES) | card_payment, F.lit(False))
    known = F.col("user_hit").isNotNull() | F.col("ach_hit").isNotNull()
    received = F.coalesce(F.col("subject").rlike(V.RAIL_RECEIVED), F.lit(False))
    df = df.withColumn("arriving_subject", F.when(deposit & F.col("user_hit").isNull() & ~received, F.col("subject")))
    df = with_rule_match(df, "arriving_subject", V.ARRIVAL_RULES, "arrival_hit", "(?i)")
    df = df.withColumn("open_subject", F.when(~settled & ~known & F.when(deposit, F.col("arrival_hit").isNull() & ~received).otherwise(
        F.col("rail_hit").isNull()), F.col("subject")))
    df = with_rule_match(df, "open_subject", V.DESCRIPTOR_RULES, "shipped_hit")
    nameless = F.col("open_subject").isNotNull() & F.col("shipped_hit").isNull()
    df = df.withColumns({"open_payee": F.when(nameless, F.col("payee_text")), "open_text": F.when(
        nameless & ~deposit & ~F.coalesce(F.col("kind") == "credit", F.lit(False)), F.col("text"))})
    df = X.with_clean(df, "open_payee", "clean_name")
    df = df.withColumn("name", F.coalesce(
        F.nullif(X.titlecase(F.col("clean_name")), F.lit("")), F.col("open_payee")))
    df = X.with_category_hint(df, "open_text", "hint")

    def refund_aware(hit: str) -> Column:
        category = F.when(F.col("kind") == "credit", F.lit(V.REFUNDS)).otherwise(F.col(f"{hit}.category"))
        return F.when(F.col(hit).isNotNull(), _pair(F.col(f"{hit}.merchant"), category))

    def relabelled(hit: str, category: str) -> Column:
        return F.when(F.col(hit).isNotNull(), _pair(F.col(f"{hit}.merchant"), F.lit(category)))

    arriving = F.coalesce(
        F.col("user_hit"),
        F.when(F.col("subject").rlike(V.RAIL_RECEIVED),
               _pair(F.lit(V.RAIL_RECEIVED_MERCHANT), F.lit(V.REIMBURSEMENTS))),
        F.col("arrival_hit"),
        relabelled("ach_hit", V.INCOME),
        relabelled("shipped_hit", V.REIMBURSEMENTS),
        _pair(F.col("name"), F.lit(V.ONE_OFF)),
    )
    leaving = F.coalesce(
        F.col("rail_hit"),
        refund_aware("ach_hit"), refund_aware("user_hit"), refund_aware("shipped_hit"),
        _pair(F.col("name"), F.when(F.col("kind") == "credit", F.lit(V.REFUNDS))
              .otherwise(F.coalesce(F.col("hint"), F.lit(V.UNCATEGORIZED)))),
    )
    outcome = reduce(lambda branch, item: branch.when(F.col("kind") == item[0], _pair(*map(F.lit, item[1]))),
                     V.KIND_OUTCOMES.items(), F)
    outcome = (outcome.when(card_payment,
                            _pair(*map(F.lit, V.CARD_PAYMENT_OUTCOME)))
               .when(deposit, arriving).otherwise(leaving))
    return (df.withColumn("outcome", outcome)
            .select(*texts.columns, F.col("outcome.merchant").alias("merchant"),
                    F.col("outcome.category").alias("category")))


def classification_table(transactions: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One classified row per distinct (text, account, kind), written as a table."""
    distinct = transactions.select(
        X.match_text(F.col("descriptor"), F.col("description")).alias("text"), "account", "kind").distinct()
    distinct = materialize(distinct, "texts")
    # rules cost far more than bytes suggest: keep every core busy instead of letting adaptive
    # execution merge the short partitions
    return materialize(classify_texts(spread(distinct, "text"), rules), "classification")


def with_classification(transactions: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``transactions`` with ``merchant`` and ``category``."""
    table = classification_table(transactions, rules)
    keyed = transactions.withColumn("text", X.match_text(F.col("descriptor"), F.col("description")))
    return keyed.join(broadcast_if_small(table), ["text", "account", "kind"], "left").drop("text")


def recategorize(transactions: DataFrame, rules: Rules) -> DataFrame:
    """The same rows classified again under changed rules, with the former outcome beside it."""
    former = transactions.withColumnsRenamed({"merchant": "former_merchant", "category": "former_category"})
    return with_classification(former, rules)


def applied(spend: DataFrame, category: str) -> DataFrame:
    """How many spend rows now lie in a category."""
    return spend.agg(F.count_if(F.col("category") == category).alias("applied"))
