"""Collocations of transaction descriptions by set-oriented mining (SETM) of occurrence relations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.batches import partitions
from ledgerloom.llm.chunks import (ASKED_PAIRS, answered, ask_pairs, from_gaps, from_planes, gaps, looked_up, number_pairs,
                                   number_words, planes, text_chunks)
from ledgerloom.storage import Workspace

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
COVERED_PERCENT = 80
BLANKS = b" \t"
BREAKS = b".,;:!?\n\v\f\r"
#: Occurrences of groups with a number, sorted by position (``gaps``, ``planes``).
RELATION = "chunk bigint, positions binary, ids binary"


def neighbours(positions: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a relation, sorted by position, with itself at the next position of the same piece.

    Returns where the pairs stand, the distinct pairs (first, rest), and which of those each one is.
    """
    at = np.flatnonzero(np.diff(positions) == 1)
    names, code = np.unique(ids, return_inverse=True)
    keys, inverse = np.unique(code[at] * len(names) + code[at + 1], return_inverse=True)
    size = max(1, len(names))
    return at, names[keys // size], names[keys % size], inverse


def relation_of(number: int, positions: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Occurrences whose group has a number, in order of position."""
    kept = np.flatnonzero(ids)
    return pa.table({"chunk": pa.array([number], pa.int64()), "positions": pa.array([gaps(positions[kept])], pa.binary()),
                     "ids": pa.array([planes(ids[kept])], pa.binary())})


NONE = relation_of(0, np.zeros(0, np.int64), np.zeros(0, np.int64)).slice(0, 0)


def _words(left: pa.Table, right: pa.Table) -> pa.Table:
    """The relation of frequent words of a chunk."""
    if not left.num_rows:
        return NONE
    tokens, positions = from_planes(left.column("tokens")[0].as_py()), from_gaps(left.column("positions")[0].as_py())
    ids, _ = looked_up(right, int(tokens.max(initial=-1)) + 1)
    return relation_of(left.column("chunk")[0].as_py(), positions, ids[tokens])


def _longer(left: pa.Table, right: pa.Table) -> pa.Table:
    """Semi join: the relation of phrases one word longer, of frequent groups only."""
    if not left.num_rows:
        return NONE
    positions, ids = from_gaps(left.column("positions")[0].as_py()), from_planes(left.column("ids")[0].as_py())
    at, first, _, inverse = neighbours(positions, ids)
    numbers, _ = looked_up(right, len(first))
    return relation_of(left.column("chunk")[0].as_py(), positions[at], numbers[inverse])


def _asking(groups: int):
    def run(batches):
        for batch in batches:
            for chunk, positions, ids in zip(*[c.to_pylist() for c in batch.columns]):
                _, first, rest, inverse = neighbours(from_gaps(positions), from_planes(ids))
                if len(first):
                    yield ask_pairs(chunk, first, rest, np.bincount(inverse, minlength=len(first)), groups)

    return run


def frequent_phrases(transactions: DataFrame, text: str, per: str, space: Workspace, least: int = LEAST,
                     longest: int = LONGEST, unnamed: str = "und") -> tuple[DataFrame, list[DataFrame]]:
    """(words per group, phrases of 2, 3, ... words): every phrase that occurs ``least`` times or more in its group.

    Phrases (id, per, words, a, heads, tails, first, rest): ``heads[i]`` counts the phrase of its first i + 1
    words, ``tails[i]`` that of its last i + 1; ``first`` and ``rest`` are the ids of the phrase without its
    last and without its first word.
    """
    texts = transactions.select(F.col(text).cast("string").alias("text"),
                                F.coalesce(F.col(per).cast("string"), F.lit(unnamed)).alias("per"))
    chunks = space.cut(text_chunks(texts, per="per", blanks=BLANKS, breaks=BREAKS), "chunks")
    totals = space.cut(chunks.groupBy("per").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n")), "totals")
    answers = number_words(chunks, space, least)
    relation = space.cut(answered(chunks.select("chunk", "tokens", "positions"), answers, _words, RELATION), "relation")
    space.drop(chunks)
    group = F.explode(F.arrays_zip(F.split(F.col("words").cast("string"), " ").alias("word"), "ids", "counts")).alias("g")
    none = F.array().cast("array<bigint>")
    level = answers.where("chunk is null").select("per", group).select(
        F.col("g.ids").alias("id"), "per", F.array("g.word").alias("words"), F.col("g.counts").alias("a"),
        none.alias("heads"), none.alias("tails"))
    groups = partitions(transactions.sparkSession)
    levels = []
    for width in range(2, longest + 1):
        answers = number_pairs(relation.mapInArrow(_asking(groups), ASKED_PAIRS), space, least)
        shorter = relation
        if width < longest:
            relation = space.cut(answered(shorter, answers, _longer, RELATION), "relation")
        space.drop(shorter)
        pairs = answers.where("chunk is null").select(
            F.explode(F.arrays_zip("ids", "counts", "first", "rest")).alias("g")).select("g.*")
        f, r = level.alias("f"), level.alias("r")
        level = space.cut(
            pairs.alias("p").join(f, F.col("p.first") == F.col("f.id")).join(r, F.col("p.rest") == F.col("r.id")).select(
                F.col("p.ids").alias("id"), "f.per", F.concat("f.words", F.slice("r.words", -1, 1)).alias("words"),
                F.col("p.counts").alias("a"), F.concat("f.heads", F.array("f.a")).alias("heads"),
                F.concat("r.tails", F.array("r.a")).alias("tails"), "p.first", "p.rest"), f"phrases{width}")
        levels.append(level)
    return totals, levels


def weakest_cut(width: int):
    """The lowest-scoring cut of a phrase, ties to the shortest first part: struct (score, k, l, r), exact."""
    cuts = []
    for k in range(1, width):
        l, r = F.element_at("heads", k), F.element_at("tails", width - k)  # noqa: E741
        whole = F.col("a").cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(9,0)")
        parts = l.cast("decimal(20,0)") + r.cast("decimal(20,0)")
        score = F.floor((whole - whole % parts) / parts).cast("bigint")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts)).alias("cut")


def mine_phrases(transactions: DataFrame, text: str = "description", per: str = "account", least: int = LEAST,
                 longest: int = LONGEST, top: int = TOP, space: Workspace | None = None) -> DataFrame:
    """Collocations of the descriptions of transactions, for each account kind.

    ``transactions`` (description, account, ...) -> (account, rank, phrase, a, l, r, n, score): of each value of ``per``
    the ``top`` best phrases of 2 to ``longest`` words that occur at least ``least`` times, by score and ``a``
    descending, then phrase.  A-Z is lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces
    into words at blanks and tabs, and a phrase lies within one piece.  ``a`` counts all its occurrences,
    overlapping ones too; ``l`` and ``r`` those of the two parts of its weakest cut, whose score
    floor(2000000 a / (l + r)) is the phrase's; ``n`` all words of the value.  A phrase is dropped if some longer phrase that
    holds it has at least 80 % of its count.

    A null text is empty, a null ``per`` counts as ``und``, repeated rows count again, texts may be of any
    length, other columns are not read, and an empty table gives an empty result.  Phrases that tie in
    score and count come in the order of their UTF-8 bytes.

    By SETM: the occurrences of frequent words form a relation sorted by (piece, position) and persisted in
    chunks; it is merge-joined with itself at the adjacent position, pairs are counted over all chunks,
    and only occurrences of frequent groups (a semi join) go on to the next length.  A phrase that longer one
    of ``a`` or more holds is also held by one just one word longer, so ``first`` and ``rest`` decide coverage.
    """
    own = space is None
    space = space or Workspace(transactions.sparkSession, "phrases")
    totals, levels = frequent_phrases(transactions, text, per, space, least, longest)
    found = []
    for k, level in enumerate(levels):
        scored = level.select("id", "per", F.array_join("words", " ").alias("phrase"), "a", weakest_cut(k + 2))
        if k + 1 < len(levels):
            above = levels[k + 1]
            holding = above.select(F.col("first").alias("id"), "a").union(above.select("rest", "a")) \
                .groupBy("id").agg(F.max("a").alias("longer"))
            scored = scored.join(holding, "id", "left").where(
                f"longer is null or cast(longer as decimal(28,0)) * 100 < cast(a as decimal(28,0)) * {COVERED_PERCENT}").drop("longer")
        found.append(scored)
    phrases = reduce(DataFrame.union, found).select("id", "per", "phrase", "a", F.col("cut.l").alias("l"),
                                                    F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("id"), F.lit(partitions(transactions.sparkSession)))
    near = phrases.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("per", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("per").orderBy(*best))).where(F.col("rank") <= top)
    result = space.cut(ranked.join(F.broadcast(totals), "per").select(
        F.col("per").alias(per), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "result")
    if own:
        space.close(result)
    return result
