"""Find statement texts that hold edited copies of test items: rare n-gram seeds and local alignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import Rolling, chunked, dealt, packed, small_batches
from ledgerloom.storage import Workspace

GRAM = 3
SPACING = 2
THRESHOLD = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_WORDS = 8
GRAMS_PER_BLOCK = 500_000
CHUNK_BYTES = 1 << 20
CELLS = 1 << 21


def _word_table() -> np.ndarray:
    """Bytes of words: a-z (A-Z as such), digits and all bytes above ASCII; zero elsewhere."""
    table = np.zeros(256, np.uint8)
    for first, last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (128, 255)):
        table[first:last + 1] = np.arange(first, last + 1)
    table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


WORD = _word_table()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit hash of each word of each text, and the text it is in."""
    body, starts, _ = packed(texts, gap=1)
    letters = WORD[body]
    inside = letters > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    owner = np.searchsorted(starts, first, "right") - 1
    return Rolling(letters).slices(first, last) >> np.uint64(1), owner


def gram_hashes(words: np.ndarray, owner: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n words in a row of one text, and the place of the first."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        grams = (grams ^ words[i:len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
    at = np.flatnonzero(owner[n - 1:] == owner[:len(grams)])
    return (grams[at] >> np.uint64(1)).astype(np.int64), at


def _members(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in ``sorted_values``, or -1; a bit table passes over most absent ones."""
    sieve = np.zeros(1 << 20, bool)
    sieve[sorted_values & 0xFFFFF] = True
    found = np.full(len(values), -1, np.int64)
    maybe = np.flatnonzero(sieve[values & 0xFFFFF])
    at = np.minimum(np.searchsorted(sorted_values, values[maybe]), len(sorted_values) - 1)
    ok = sorted_values[at] == values[maybe]
    found[maybe[ok]] = at[ok]
    return found


def item_words(items: DataFrame) -> DataFrame:
    """``items`` (item_id, text) -> (item_id, words: array<bigint>), items without words left out."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            words, owner = word_hashes(texts)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            lists = [words[a:b].astype(np.int64).tolist() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))],
                                             ["item_id", "words"])

    return (items.where("item_id is not null").select("item_id", "text")
            .mapInArrow(run, f"item_id {kind}, words array<bigint>").where(F.size("words") > 0))


def _gram_frequencies(statements: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """In how many statement texts each of ``grams`` (sorted) occurs, over all statements."""
    shared = statements.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            words, owner = word_hashes(texts)
            values, at = gram_hashes(words, owner)
            found = _members(shared.value, values)
            hit = found >= 0
            pairs = np.unique(found[hit] * len(texts) + owner[at[hit]])
            index, n = np.unique(pairs // len(texts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[index]), pa.array(n)], ["gram", "n"])

    counts = statements.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.collect()}


def rare_seeds(words: np.ndarray, frequency: dict[int, int], spacing: int = SPACING) -> np.ndarray:
    """The rarest n-gram of every ``spacing`` in a row (all if there are fewer)."""
    grams, _ = gram_hashes(words.astype(np.uint64), np.zeros(len(words), np.int64))
    rank = sorted(range(len(grams)), key=lambda i: (frequency.get(int(grams[i]), 0), i))
    place = np.empty(len(grams), np.int64)
    place[rank] = np.arange(len(grams))
    size = min(spacing, len(grams))
    return np.unique([grams[i + int(place[i:i + size].argmin())] for i in range(len(grams) - size + 1)])


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score of each passage with its item, and the passage word the alignment ends at.

    All pairs advance together, one item word at a time; the running maximum carries gaps along a row.
    """
    n, m = len(passages), max(map(len, items))
    width = max(map(len, passages))
    a, b = np.full((n, width), -1, np.int64), np.full((n, m), -2, np.int64)
    for k, (p, i) in enumerate(zip(passages, items)):
        a[k, :len(p)] = p
        b[k, :len(i)] = i
    row = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = (-GAP * np.arange(width + 1)).astype(np.int32)
    for j in range(m):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(a == b[:, j:j + 1], MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        top = row.max(axis=1)
        better = top > best
        best[better] = top[better]
        end[better] = row[better].argmax(axis=1)
    return best, end


def _candidates(statements: DataFrame, seeds: np.ndarray, owners: list[np.ndarray], lengths: np.ndarray) -> DataFrame:
    """Passages around seeds: (stmt_id, item, first: word number, words), one row per cluster of seeds."""
    kind = statements.schema["stmt_id"].dataType.simpleString()
    shared = statements.sparkSession.sparkContext.broadcast((seeds, owners, lengths))

    def run(batches):
        seeds, owners, lengths = shared.value
        for table in chunked(batches, CHUNK_BYTES, "text"):
            ids = table.column("stmt_id").combine_chunks()
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            words, owner = word_hashes(texts)
            values, at = gram_hashes(words, owner)
            found = _members(seeds, values)
            hit = np.flatnonzero(found >= 0)
            if not len(hit):
                continue
            which = [owners[k] for k in found[hit]]
            place = np.repeat(at[hit], list(map(len, which)))
            item = np.concatenate(which)
            order = np.lexsort((place, item, owner[place]))
            place, item = place[order], item[order]
            text = owner[place]
            new = np.ones(len(place), bool)
            new[1:] = ((text[1:] != text[:-1]) | (item[1:] != item[:-1])
                       | (place[1:] - place[:-1] > lengths[item[1:]]))
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(place)) - 1
            begins = np.searchsorted(owner, text[start])
            ends = np.searchsorted(owner, text[start], "right")
            low = np.maximum(begins, place[start] - lengths[item[start]])
            high = np.minimum(ends, place[stop] + GRAM + lengths[item[start]])
            lists = [words[a:b].astype(np.int64) for a, b in zip(low, high)]
            offsets = np.concatenate([[0], np.cumsum(list(map(len, lists)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text[start])), pa.array(item[start].astype(np.int32)), pa.array(low - begins),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))],
                ["stmt_id", "item", "first", "words"])

    return (statements.where("stmt_id is not null").select("stmt_id", "text")
            .mapInArrow(run, f"stmt_id {kind}, item int, first bigint, words array<bigint>"))


def _whole_copies(statements: DataFrame, items: dict[int, np.ndarray]) -> DataFrame:
    """Places where all words of a short item stand in a row, in the form of ``_candidates``."""
    kind = statements.schema["stmt_id"].dataType.simpleString()
    tables = []
    for n in sorted({len(w) for w in items.values()}):
        mine = [(int(gram_hashes(w.astype(np.uint64), np.zeros(n, np.int64), n)[0][0]), k) for k, w in items.items() if len(w) == n]
        hashes = np.array(sorted({h for h, _ in mine}), np.int64)
        tables.append((n, hashes, [np.array([k for h, k in mine if h == x], np.int32) for x in hashes]))
    shared = statements.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            ids = table.column("stmt_id").combine_chunks()
            words, owner = word_hashes([t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()])
            for n, hashes, owners in shared.value:
                values, at = gram_hashes(words, owner, n)
                found = _members(hashes, values)
                hit = np.flatnonzero(found >= 0)
                if not len(hit):
                    continue
                item = np.concatenate([owners[k] for k in found[hit]])
                place = np.repeat(at[hit], [len(owners[k]) for k in found[hit]])
                first = np.unique(np.stack([owner[place], item, place]), axis=1)
                first = first[:, np.append(True, (first[:2, 1:] != first[:2, :-1]).any(axis=0))]  # one place of a text and item
                offsets = np.arange(0, n * (first.shape[1] + 1), n, dtype=np.int32)
                lists = words[(first[2][:, None] + np.arange(n)).ravel()].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first[0])), pa.array(first[1].astype(np.int32)),
                     pa.array(first[2] - np.searchsorted(owner, first[0])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists))],
                    ["stmt_id", "item", "first", "words"])

    return (statements.where("stmt_id is not null").select("stmt_id", "text")
            .mapInArrow(run, f"stmt_id {kind}, item int, first bigint, words array<bigint>"))


def _scored(passages: DataFrame, items: list[np.ndarray], threshold: float) -> DataFrame:
    """Alignment of each distinct passage with its item, where the share of the best score is enough."""
    shared = passages.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for batch in batches:
            item = np.asarray(batch.column("item"))
            passage = [np.asarray(x.values, np.int64) for x in batch.column("words")]
            order = sorted(range(len(item)), key=lambda k: len(passage[k]))
            score, end = np.zeros(len(item)), np.zeros(len(item), np.int64)
            first = 0
            while first < len(order):
                last = first + 1
                while last < len(order) and (last + 1 - first) * len(passage[order[last]]) < CELLS // 8:
                    last += 1
                some = order[first:last]
                best, ends = align([passage[k] for k in some], [shared.value[item[k]] for k in some])
                score[some] = best / [MATCH * len(shared.value[item[k]]) for k in some]
                end[some] = ends
                first = last
            keep = pa.array(np.flatnonzero(score >= threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(keep), batch.column("words").take(keep),
                 pa.array(score).take(keep), pa.array(end).take(keep)], ["item", "words", "score", "last"])

    distinct = dealt(passages.select("item", "words").distinct(), "words")
    return distinct.mapInArrow(run, "item int, words array<bigint>, score double, last bigint")


def contaminated_statements(statements: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                            space: Workspace | None = None) -> DataFrame:
    """Statement texts with a passage that aligns with a test item.

    ``statements`` (stmt_id, text, ...), ``items`` (item_id, text, ...) -> one row per statement and
    item found: (stmt_id, item_id, score, word_end), where score (0 to 1) is the best
    local alignment of words (match 2, mismatch and gap -1) over that of the whole item.

    Words are runs of letters, digits and bytes above ASCII, A-Z lower-cased.  Every ``SPACING``
    n-grams of an item in a row, the one that the fewest statements hold is a seed, by counts over
    all statements; it is a seed however frequent it is.  Passages around seeds that are alike are
    aligned once.  Of items under ``LEAST_WORDS`` words only copies of the whole item, word for word, are found
    (score 1), by the hash of its words in a row; items without words are not searched.  Null texts are empty, texts may be of
    any length, rows with a null id are left out, repeated ids give their best row, other columns are not read, and if
    either table is empty so is the result.   Items are handled in
    blocks of about ``GRAMS_PER_BLOCK`` words, which bounds what is sent to tasks.
    """
    spark = statements.sparkSession
    small_batches(spark)
    space = space or Workspace(spark, "decontamination")
    items = space.cut(item_words(items), "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // GRAMS_PER_BLOCK))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for k in range(blocks):
        rows = items.where(block == k).dropDuplicates(["item_id", "words"]).orderBy("item_id", "words").collect()
        if not rows:
            continue
        words = [np.array(r["words"], np.int64) for r in rows]
        long = {i: w for i, w in enumerate(words) if len(w) >= LEAST_WORDS}
        short = {i: w for i, w in enumerate(words) if len(w) < LEAST_WORDS}
        parts = [_whole_copies(statements, short)] if short else []
        if long:
            grams = np.unique(np.concatenate([gram_hashes(w.astype(np.uint64), np.zeros(len(w), np.int64))[0] for w in long.values()]))
            frequency = _gram_frequencies(statements, grams)
            pairs = sorted({(int(g), i) for i, w in long.items() for g in rare_seeds(w, frequency)})
            seeds = np.array(sorted({g for g, _ in pairs}), np.int64)
            owners: list[list[int]] = [[] for _ in seeds]
            for g, i in pairs:
                owners[int(np.searchsorted(seeds, g))].append(i)
            parts.append(_candidates(statements, seeds, [np.array(o) for o in owners], np.array(list(map(len, words)))))
        passages = space.cut(reduce(DataFrame.union, parts), "passages")
        scored = space.cut(_scored(passages, words, threshold), "scored")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                      f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = (passages.join(scored, ["item", "words"]).join(names, "item")
                .select("stmt_id", "item_id", "score", (F.col("first") + F.col("last")).alias("word_end")))
        found = part if found is None else found.union(part)
    if found is None:
        return statements.limit(0).join(items.limit(0), F.lit(True)).select(
            "stmt_id", "item_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("word_end"))
    return found.groupBy("stmt_id", "item_id").agg(
        F.max("score").alias("score"), F.max_by("word_end", F.struct("score", "word_end")).alias("word_end"))


def without_contaminated(statements: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                         space: Workspace | None = None) -> DataFrame:
    """The statements, with all their columns, in which no item was found (null ids stay)."""
    found = contaminated_statements(statements, items, threshold, space).select("stmt_id").distinct()
    return statements.join(found, "stmt_id", "left_anti").select(*statements.columns)
