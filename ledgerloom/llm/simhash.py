"""SimHash fingerprints of statement texts and exact search of all close pairs by covering masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import dealt, local_components, partitions, small_batches
from ledgerloom.llm.components import connected_components
from ledgerloom.storage import Workspace

SEED = 42
PIECE_BYTES = 1 << 20
TILE = 8192


def _word_blocks(text: bytes):
    """Lower-cased words of a text, in lists that hold about one piece of it each."""
    first, n = 0, len(text)
    while first < n:
        last = min(first + PIECE_BYTES, n)
        while last < n and text[last] not in b" \t\n\v\f\r":
            last += 1
        words = text[first:last].lower().split()
        if words:
            yield words
        first = last


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits; one is set if it is set in over half of the XXH64 values of the word shingles."""
    total, held, ones = 0, [], np.zeros(64, np.int64)
    def count(words: list[bytes]) -> None:
        nonlocal total, ones
        body = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        ends = (ends[width - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        values = np.array([digest(body[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
        total += len(values)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    for words in _word_blocks(text):
        held = held + words
        if len(held) >= width:
            count(held)
            held = held[len(held) - width + 1:]
    if not total and held:
        value = np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)
        return int(value[0])
    bits = (ones * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(statements: DataFrame, width: int = 4) -> DataFrame:
    """``statements`` (stmt_id, text) -> (stmt_id, fingerprint: bigint), one row per row; null text as empty."""
    small_batches(statements.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["stmt_id", "fingerprint"])

    kind = statements.schema["stmt_id"].dataType.simpleString()
    return statements.select("stmt_id", "text").mapInArrow(run, f"stmt_id {kind}, fingerprint bigint")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks such that any two words that differ in at most ``radius`` bits agree under one of them.

    Bit i carries a vector m(i) of radius + 1 bits, and each non-zero v of that space gives the mask
    of the bits with an odd product <m(i), v>.  The vectors of at most ``radius`` differing bits
    leave some v orthogonal to all of them, and that v's mask holds none of the differing bits.
    """
    space = 1 << (radius + 1)
    carried = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (carried[i] & v).bit_count() % 2) for v in range(1, space)]


def _links_in_groups(radius: int):
    """Links within groups of equal (table, key, tile): a spanning forest of each partition's rows."""
    def run(batches):
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        cols = [np.asarray(rows.column(i)) for i in range(4)]
        order = np.lexsort(cols[::-1])
        table, key, tile, word = (c[order] for c in cols)
        words, index = np.unique(word, return_inverse=True)
        new = np.ones(len(word), bool)
        new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        group = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(word))[group]
        bits = word.view(np.uint64)
        root = np.arange(len(words))
        a_held, b_held, held = [], [], 0
        def fold():
            nonlocal root, a_held, b_held, held
            if held:
                a = np.concatenate([*a_held, np.arange(len(words))])
                b = np.concatenate([*b_held, root])
                root = local_components(len(words), a, b)
                a_held, b_held, held = [], [], 0
        left, step = np.arange(len(word)), 1
        while len(left):
            left = left[left + step < ends[left]]
            near = left[np.bitwise_count(bits[left] ^ bits[left + step]) <= radius]
            if len(near):
                a_held.append(index[near]); b_held.append(index[near + step])
                held += len(near)
                if held > 2_000_000:
                    fold()
            step += 1
        fold()
        linked = np.flatnonzero(root != np.arange(len(words)))
        yield pa.RecordBatch.from_arrays([pa.array(words[linked]), pa.array(words[root[linked]])], ["a", "b"])

    return run


def close_links(words: DataFrame, radius: int, space: Workspace, tile: int = TILE) -> DataFrame:
    """``words`` (fingerprint, distinct) -> links (a, b) whose components are those of all close pairs.

    Each mask deals the words into buckets by their masked value.  A bucket over ``tile`` words is
    split into blocks that meet pairwise in tiles of their own, so no task holds more than two
    blocks of a bucket.  A task returns a spanning forest of the close pairs it found, not the pairs.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = words.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(i).cast("short").alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(signed)])).alias("e")).select("e.table", "e.key", "fingerprint")
    crowded = space.cut(entries.groupBy("table", "key").count().where(F.col("count") > tile), "crowded")
    if crowded.isEmpty():
        placed = entries.withColumn("tile", F.lit(0))
    else:
        blocks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tile).cast("int")
        block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
        placed = (entries.join(crowded, ["table", "key"], "left").withColumn("blocks", blocks)
                  .withColumn("block", block)
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .withColumn("tile", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
                              .cast("int")))
    placed = placed.select("table", "key", "tile", "fingerprint")
    spread = dealt(placed, "table", "key", "tile")
    return spread.mapInArrow(_links_in_groups(radius), "a bigint, b bigint")


def near_duplicate_statements(statements: DataFrame, width: int = 4, radius: int = 4,
                              space: Workspace | None = None) -> DataFrame:
    """Group statement texts whose SimHash fingerprints differ in at most ``radius`` bits.

    ``statements`` (stmt_id: bigint, text: string, ...) -> (stmt_id, fingerprint: 16 hex digits,
    component_id), one row per input row.  Words are runs of non-blank characters with A-Z
    lower-cased; shingles are ``width`` words, repeats included; a shorter text is one shingle and
    a text without words (or a null text) has fingerprint zero and links like any other.
    ``component_id`` is the smallest stmt_id reachable over links; null ids are never the smallest
    (all null: null).  Repeated rows stay; other columns are not read.  An empty table gives an
    empty result.

    Equal fingerprints are folded first, so copies cost one word; the covering masks miss no pair.
    """
    spark = statements.sparkSession
    own = space is None
    space = space or Workspace(spark, "simhash")
    marked = space.cut(fingerprints(statements, width), "fingerprints")
    words = space.cut(marked.groupBy("fingerprint").agg(F.min("stmt_id").alias("low")), "words")
    links = space.cut(close_links(words.select("fingerprint"), radius, space), "links")
    found = space.cut(connected_components(links, space), "components")
    named = words.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left") \
        .select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    names = space.cut(named.join(lows, "component").select("fingerprint", "component_id"), "names")
    if own:
        space.close(marked, names)
    return marked.join(names, "fingerprint").select(
        "stmt_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(statements: DataFrame, width: int = 4, radius: int = 4,
                        space: Workspace | None = None) -> DataFrame:
    """The statements whose id is the smallest of their group, with all their columns.

    Rows with a null id cannot be compared and stay; repeated rows of a kept id fold to one row.
    """
    groups = near_duplicate_statements(statements, width, radius, space)
    kept = groups.where("stmt_id = component_id").select("stmt_id").distinct()
    named = statements.where("stmt_id is not null").join(kept, "stmt_id", "left_semi")
    first = named.dropDuplicates(["stmt_id"])
    return first.unionByName(statements.where("stmt_id is null"))
