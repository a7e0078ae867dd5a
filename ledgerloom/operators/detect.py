"""Layout detection by marker scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V

DETECT_PAGES = 3
WORD_BITS = 63


def layout_score(text: Column, required: list[str], markers: list[str]) -> Column:
    """0 without any required string, else 1 plus the number of markers that occur."""
    needed = F.lit(False)
    for r in required:
        needed = needed | text.contains(r)
    found = F.lit(1)
    for m in markers:
        found = found + text.contains(m).cast("int")
    return F.when(needed, found).otherwise(0)


def score_formats(docs: DataFrame, key: str, text: str, layouts=None) -> DataFrame:
    """One row per (document, layout) with its score.

    Layouts are a short registry, so they are literals inside the projection: no join, no shuffle.
    """
    structs = [F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"),
                        layout_score(F.col(text), required, markers).alias("score"))
               for name, label, _, _, required, markers in layouts or V.LAYOUTS]
    return docs.select(key, F.inline(F.array(*structs)))


def _strings(layouts) -> list[str]:
    return sorted({s for *_, required, markers in layouts for s in [*required, *markers]})


def page_marks(pages: DataFrame, layouts=None, key: str = "stmt_id", page: str = "page_no", text: str = "text",
               k_pages: int = DETECT_PAGES) -> DataFrame:
    """(key, pages, has_text, marks): which strings of the registry the first pages of each document hold.

    ``marks`` has a bit for each string, in whole numbers of ``WORD_BITS`` bits.  A page is searched where it lies and
    only its bits are shuffled.  Rows without a page number or text keep their document in the result.
    """
    strings = _strings(layouts or V.LAYOUTS)
    opening = F.coalesce(F.col(page) <= k_pages, F.lit(False))
    value = F.when(opening, F.col(text))
    words = []
    for first in range(0, len(strings), WORD_BITS):
        bits = [F.when(value.contains(s), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                for i, s in enumerate(strings[first:first + WORD_BITS])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    names = [f"marks_{i}" for i in range(len(words))]
    marked = pages.select(key, page, F.coalesce(value.rlike(r"\S"), F.lit(False)).alias("has_text"),
                          *[F.coalesce(w, F.lit(0)).alias(n) for w, n in zip(words, names)])
    found = marked.groupBy(key).agg(F.count(page).alias("pages"), F.bool_or("has_text").alias("has_text"),
                                    *[F.bit_or(n).alias(n) for n in names])
    return found.select(key, "pages", "has_text", F.array(*names).alias("marks"))


def detect(pages: DataFrame, key: str = "stmt_id", page: str = "page_no", text: str = "text", layouts=None,
           k_pages: int = DETECT_PAGES) -> DataFrame:
    """Best layout per document: ties keep registry order, score 0 stays unmatched with a reason.

    ``pages`` (stmt_id, page_no, text), of which the first ``k_pages`` count.
    """
    layouts = layouts or V.LAYOUTS
    place = {s: divmod(i, WORD_BITS) for i, s in enumerate(_strings(layouts))}

    def held(string: str) -> Column:
        word, bit = place[string]
        return F.get("marks", F.lit(word)).bitwiseAND(F.lit(1 << bit)) != 0

    scores = []
    for i, (name, label, _, _, required, markers) in enumerate(layouts):
        needed = reduce(lambda a, b: a | b, [held(r) for r in required], F.lit(False))
        score = F.when(needed, reduce(lambda a, b: a + b, [held(m).cast("int") for m in markers], F.lit(1))).otherwise(0)
        scores.append(F.struct((-score).alias("rank"), F.lit(i).alias("ord"), F.lit(name).alias("name"),
                               F.lit(label).alias("label"), score.alias("score")))
    ranked = page_marks(pages, layouts, key, page, text, k_pages).withColumn("ranked", F.array_sort(F.array(*scores)))
    best = F.element_at("ranked", 1)
    hit = best["score"] > 0
    others = F.transform(F.filter(F.slice("ranked", 2, len(layouts)), lambda s: s["score"] > 0), lambda s: s["label"])
    reason = (F.when(F.col("pages") == 0, "the document is empty")
              .when(~F.col("has_text"), f"the first {k_pages} pages hold no text")
              .when(~hit, "none of the known layouts: " + ", ".join(entry[1] for entry in layouts)))
    return ranked.select(
        key, F.when(hit, best["name"]).alias("layout_name"), F.when(hit, best["label"]).alias("label"),
        best["score"].alias("score"), reason.alias("error"), F.when(hit, others).otherwise(F.array()).alias("runners_up"))


def detection_summary(detections: DataFrame) -> DataFrame:
    """Documents per label, or per reason for those left out."""
    return detections.groupBy(F.coalesce("label", F.lit("skipped")).alias("label"),
                              F.when(F.col("layout_name").isNull(), F.col("error")).alias("reason")).agg(
        F.count(F.lit(1)).alias("documents"))
