"""Rule suggestion: propose a text for every open merchant and prove it against all rows.

No group is collected and rows are never crossed with candidates:

* the common core of a group is found from one short string per group (its shortest text) by
  folding, per start position, the longest prefix each text contains -- a plain ``min`` aggregate;
* candidates meet only the texts that share the candidate's rarest gram of at least half its length
  (of ``LONGEST_GRAM`` at most), by an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators import spend as S
from ledgerloom.storage import materialize

LONGEST_GRAM = 64


def contained_lengths(seed: str, text: str) -> Column:
    """Per start in ``seed``: the length of the longest piece from there that ``text`` contains.

    Two pointers as a fold: a step lengthens the piece while ``text`` holds it, else it moves the start on,
    after which the piece less its first character is still held; so 2n steps do for n characters.
    """
    return F.expr(f"""case when length({seed}) = 0 then cast(array() as array<int>) else aggregate(
        sequence(1, 2 * length({seed})),
        named_struct('s', 1, 'r', 0, 'found', cast(array() as array<int>)),
        (a, i) -> case
            when a.s > length({seed}) then a
            when a.s + a.r <= length({seed}) and contains({text}, substring({seed}, a.s, a.r + 1))
                then named_struct('s', a.s, 'r', a.r + 1, 'found', a.found)
            else named_struct('s', a.s + 1, 'r', greatest(a.r - 1, 0), 'found', concat(a.found, array(a.r))) end,
        a -> a.found) end""")


def longest_common_substring(texts: DataFrame, group: str, text: str, min_length: int = 4) -> DataFrame:
    """Per group: the leftmost longest piece of its shortest text that is in every text, else ''."""
    distinct = texts.select(group, F.col(text).alias("text")).distinct()
    seed = distinct.groupBy(group).agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("seed"))
    shared = (distinct.join(seed, group)
              .select(group, "seed", F.posexplode(contained_lengths("seed", "text")).alias("start", "reach"))
              .groupBy(group, "seed", "start").agg(F.min("reach").alias("reach")))
    best = shared.groupBy(group).agg(F.max_by(
        F.struct("seed", "start", "reach"), F.struct("reach", -F.col("start"))).alias("b"))
    piece = F.when(F.col("b.reach") >= min_length, F.expr("substring(b.seed, b.start + 1, b.reach)")).otherwise("")
    return seed.select(group).join(best, group, "left").select(
        group, F.coalesce(piece, F.lit("")).alias("common"))


def _grams(df: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """One row per distinct gram of ``text``."""
    size = F.length(text)

    def of_length(n: int):
        starts = F.sequence(F.lit(1), size - n + 1)
        pieces = F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(n)))
        return F.when(size >= n, pieces).otherwise(F.array().cast("array<string>"))

    arrays = [of_length(n) for n in lengths]
    return df.withColumn("gram", F.explode(F.array_distinct(F.concat(*arrays))))


def gram_size(text: Column) -> Column:
    """The largest power of two within the length of a text, and within ``LONGEST_GRAM``."""
    return F.least(F.pow(F.lit(2), F.floor(F.log2(F.length(text)))), F.lit(LONGEST_GRAM)).cast("int")


def candidate_matches(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (candidate, text) with ``contains(text, candidate)``, exact, by an equi join.

    A text holding the candidate holds each of its grams, so joining on the one gram that is rarest
    among the texts loses nothing; ``contains`` then removes the false partners.  Grams are at least
    half as long as the candidate, so the longer candidates are, the fewer texts share one.  Only the
    few gram sizes that occur (powers of two) reach the driver.
    """
    candidates = candidates.where(F.length("candidate") > 0)
    size = gram_size(F.col("candidate"))
    lengths = sorted(r[0] for r in candidates.select(size.alias("n")).distinct().collect())
    if not lengths:
        return candidates.join(texts, F.lit(False))
    own = candidates.withColumn("gram", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("candidate") - size + 1), lambda i: F.substr(F.col("candidate"), i, size)))).distinct()
    wanted = own.select("gram").distinct()
    posted = _grams(texts, "text", lengths).join(wanted, "gram", "left_semi")
    frequency = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("texts_with"))
    anchors = (own.join(frequency, "gram", "left").groupBy(*candidates.columns)
               .agg(F.min_by("gram", F.struct(F.coalesce("texts_with", F.lit(0)), "gram")).alias("gram")))
    return anchors.join(posted, "gram").where(F.col("text").contains(F.col("candidate"))).drop("gram")


def suggest_rules(df: DataFrame) -> DataFrame:
    """A proven rule per uncategorized merchant.

    Candidates are the merchant's name and the common core of its texts; the first one that is in
    every text of the merchant and in no row of another merchant that already has a category wins.
    """
    rows = S.with_match_text(S.spend_rows(df)).withColumn("text", F.upper("match_text"))
    originators = (rows.where(F.col("category") == V.UNCATEGORIZED)
                   .withColumn("originator", X.ach_originator(F.col("match_text")))
                   .groupBy("merchant").agg(F.min("originator").alias("lo"), F.max("originator").alias("hi"),
                                            F.min_by(F.substring("match_text", 1, 90), F.struct(*S.ROW_ORDER)).alias("sample")))
    texts = materialize(rows.groupBy("text", "merchant").agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.col("signed")).alias("spend"),
        F.bool_and(F.col("category") == V.UNCATEGORIZED).alias("open")), "texts")
    # targets are all rows of a merchant that has open rows
    targets = texts.join(texts.where("open").select(F.col("merchant")).distinct(), "merchant", "left_semi")
    sizes = targets.groupBy("merchant").agg(F.count(F.lit(1)).alias("target_texts"))
    common = longest_common_substring(targets, "merchant", "text")
    named = sizes.select(F.col("merchant").alias("target"), F.lit(1).alias("attempt"), F.upper("merchant").alias("candidate"))
    cored = common.select(F.col("merchant").alias("target"), F.lit(2).alias("attempt"), F.trim("common").alias("candidate"))
    candidates = materialize(named.unionByName(cored).where(F.col("candidate") != ""), "candidates")
    own = F.col("merchant") == F.col("target")
    proof = candidate_matches(candidates, texts).groupBy("target", "attempt", "candidate").agg(
        F.count_if(own).alias("covered"), F.count_if(~own & ~F.col("open")).alias("stolen"),
        F.sum("n").alias("matches"), F.sum("spend").alias("total"))
    good = proof.join(sizes.withColumnRenamed("merchant", "target"), "target").where(
        (F.col("covered") == F.col("target_texts")) & (F.col("stolen") == 0))
    first = good.groupBy("target").agg(F.min_by(F.struct("candidate", "matches", "total"), "attempt").alias("g"))
    unique = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return (originators.join(first.withColumnRenamed("target", "merchant"), "merchant", "left")
            .select("merchant", F.col("g.candidate").alias("pattern_text"), F.col("g.matches").alias("matches"),
                    F.col("g.total").alias("total"), "sample", unique.alias("originator"),
                    F.col("g").isNotNull().alias("ok")))


def rule_pattern(text: str) -> str:
    """A proven text as a rule pattern: matched literally."""
    return "".join("\\" + ch if ch in X.REGEX_META else ch for ch in text)
