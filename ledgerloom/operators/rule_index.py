"""First matching rule for rule tables of any size, by an index over the literals that each pattern needs.

A text can match a rule only if it holds one of the rule's required literals.  Each literal is anchored at its gram
that the fewest texts have: around such a gram a text cuts out the pieces that could be a literal, pieces and literals
meet in an equi join, and the regex runs on those pairs alone.  The result is the same as trying every rule in order.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import split_alternatives
from ledgerloom.storage import broadcast_if_small, materialize

GRAM = 3
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _closing(pattern: str, start: int, opens: str, closes: str) -> int:
    """Index of the bracket that closes the one at ``start``, or -1."""
    depth, i, in_class = 0, start, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif opens == "(" and in_class:
            in_class = ch != "]"
        elif opens == "(" and ch == "[":
            in_class = True
        elif ch == opens:
            depth += 1
        elif ch == closes:
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _longest_run(alternative: str) -> str | None:
    """The longest text that every match of an alternative holds, '' if none is certain; None for unusual syntax."""
    runs, run, i = [], "", 0

    def cut(dropped: int = 0) -> None:
        nonlocal run
        runs.append(run[:len(run) - dropped])
        run = ""

    while i < len(alternative):
        ch, step = alternative[i], 1
        if ch == "\\":
            following, step = alternative[i + 1:i + 2], 2
            if following in ("b", "B", "A", "Z", "z"):
                pass  # takes no text
            elif following and following in "dDwWsShHvVR":
                cut()
            elif not following or following.isalnum():
                return None
            else:
                run += following
        elif ch in "[(":
            end = _closing(alternative, i, ch, "]" if ch == "[" else ")")
            if end < 0 or (alternative.startswith("(?", i) and not alternative.startswith(("(?:", "(?i)"), i)):
                return None
            cut()
            step = end + 1 - i
        elif ch in ".^$":
            cut()
        elif ch in "*?+{":
            end = alternative.find("}", i) if ch == "{" else i
            least = alternative[i + 1:end].split(",")[0] if ch == "{" else ""
            if end < 0 or (ch == "{" and not least.isdigit()):
                return None
            cut(dropped=int(ch in "*?" or (ch == "{" and int(least) == 0)))
            step = end + 1 - i
            if alternative[i + step:i + step + 1] in ("?", "+"):
                step += 1
        else:
            run += ch
        i += step
    cut()
    return max(runs, key=len).translate(_FOLD)


def _plain_classes(pattern: str) -> bool:
    """Whether every [class] is one that ends at its first bracket: none opens with one or holds another class."""
    i, start = 0, -1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif start >= 0 and pattern[i] in "[]":
            if pattern[i] == "[" or pattern[start + 1:i] in ("", "^"):
                return False
            start = -1
        elif start < 0 and pattern[i] == "[":
            start = i
        i += 1
    return start < 0


def required_literals(pattern: str | None) -> list[str] | None:
    """One folded literal for each alternative, of which every match of ``pattern`` holds one; None if there is no such set.

    A-Z are folded, so the literals serve matching with and without regard to case.  Literals under ``GRAM``
    characters are no use for the index.
    """
    if not pattern or not _plain_classes(pattern):
        return None
    runs = [_longest_run(a) for a in split_alternatives(pattern)]
    if any(r is None or len(r) < GRAM for r in runs):
        return None
    return sorted(set(runs))


def with_literals(rules: DataFrame) -> DataFrame:
    """``rules`` (ord, pattern, ...) with ``literals``, null where the index cannot find the rule."""
    @F.pandas_udf("array<string>")
    def literals(patterns: pd.Series) -> pd.Series:
        return patterns.map(required_literals)

    return rules.withColumn("literals", literals("pattern"))


def folded(text: str):
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _grams(text: str):
    """All grams of ``text`` in order, repeats included; none for shorter texts."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substr(F.col(text), i, F.lit(GRAM)))


def grams_of(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one row for each distinct gram of ``text``; none for shorter texts."""
    return df.where(F.length(text) >= GRAM).withColumn("gram", F.explode(F.array_distinct(_grams(text))))


def anchored(literals: DataFrame, texts: DataFrame) -> DataFrame:
    """(gram, places: array of (skipped, size)): where a literal lies around the gram of it that the fewest ``low`` texts have.

    Literals that no text can hold (a gram of theirs occurs in none) have no place.
    """
    pieces = materialize(literals.where(F.length("literal") >= GRAM).select(
        F.length("literal").alias("size"), "literal", F.posexplode(_grams("literal")).alias("skipped", "gram")), "grams")
    wanted = materialize(pieces.select("gram").distinct(), "wanted")
    counts = materialize(grams_of(texts, "low").select("gram").join(broadcast_if_small(wanted), "gram", "left_semi")
                         .groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "counts")
    chosen = (pieces.join(broadcast_if_small(counts), "gram", "left").groupBy("literal")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "skipped", "size")).alias("c")).where("c.n > 0"))
    return chosen.select("c.gram", "c.skipped", "c.size").distinct().groupBy("gram").agg(
        F.collect_list(F.struct("skipped", "size")).alias("places"))


def indexed_matches(texts: DataFrame, subject: str, rules: DataFrame, flags: str = "(?i)") -> DataFrame:
    """(subject, ord): the first rule in ``ord`` that matches each distinct text; texts without one are left out.

    ``rules`` (ord, pattern, literals) with literals.  Null texts match nothing.  A text sends the pieces that lie around
    an anchoring gram as a literal would, and pieces and whole literals meet by equality: rules that share a gram but not
    the literal cost nothing, and a common literal's join is split by adaptive execution like any skewed join.
    """
    subjects = materialize(texts.select(F.col(subject).alias("subject")).where("subject is not null").distinct()
                           .withColumns({"text_id": F.monotonically_increasing_id(), "low": folded("subject")}), "subjects")
    owners = materialize(rules.select("ord", "pattern", F.explode("literals").alias("literal")), "literals")
    places = materialize(anchored(owners.select("literal").distinct(), subjects.select("low")), "places")
    found = (subjects.where(F.length("low") >= GRAM).select("text_id", "low", F.posexplode(_grams("low")).alias("at", "gram"))
             .join(broadcast_if_small(places), "gram"))
    inside = F.filter("places", lambda p: (p["skipped"] <= F.col("at")) & (F.col("at") - p["skipped"] + p["size"] <= F.length("low")))
    held = found.select("text_id", F.explode(F.transform(inside, lambda p: F.substr(
        F.col("low"), F.col("at") - p["skipped"] + 1, p["size"]))).alias("literal"))
    pairs = materialize(held.join(owners, "literal").select("text_id", "ord", "pattern").distinct(), "pairs")
    # pairs of one rule lie together, so a pattern is compiled once for a run of them
    judged = pairs.join(subjects.select("text_id", "subject"), "text_id").sortWithinPartitions("ord", "pattern")
    return judged.where(F.expr(f"subject rlike concat('{flags}', pattern)")).groupBy("subject").agg(F.min("ord").alias("ord"))
