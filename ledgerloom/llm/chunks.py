"""Texts as chunks of word numbers, and exact counts of keys over all chunks.

A chunk is a bounded set of texts that one task has tokenised together.  Counting is done in two
steps: a chunk folds equal keys first, so that a key that every text holds costs a chunk one entry, and its
distinct keys go to groups dealt by hash, which add up, number the keys and answer each chunk
with the numbers and counts of the keys it asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import mixed, partitions
from ledgerloom.storage import Workspace

CHUNK_BYTES = 8 << 20
BLANKS = b" \t\n\v\f\r"
#: Answers to chunks (``chunk`` set): the places of its keys that have a number, the numbers and counts, as ``gaps`` and ``planes``;
#: and the counted keys themselves (``chunk`` null).
ANSWERS = ("chunk bigint, at binary, numbers binary, times binary, per string, words binary, ids array<bigint>, counts array<bigint>, "
           "first array<bigint>, rest array<bigint>")
ANSWER_FIELDS = [("chunk", pa.int64()), ("at", pa.binary()), ("numbers", pa.binary()), ("times", pa.binary()), ("per", pa.string()),
                 ("words", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("ids", "counts", "first", "rest")]]


def strings(lengths: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    """Byte strings of the given lengths that lie one after another in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def split_words(texts: list[bytes], blanks: bytes = BLANKS, breaks: bytes = b""):
    """All words of all texts with A-Z lower-cased: (array of words, how many each text has, positions).

    A position counts one up from word to word, and one more for each byte of ``breaks`` and each end
    of a text between them: words are neighbours in a piece just if their positions differ by one.
    """
    body = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    kind = np.zeros(256, np.uint8)
    kind[list(blanks)] = 1
    kind[list(breaks)] = 2
    kind[10] = max(kind[10], 1)  # the end of a text
    kinds = kind[body]
    inside = np.zeros(len(body) + 2, bool)
    np.equal(kinds, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    closes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    counts = np.diff(np.searchsorted(starts, closes), prepend=0)
    positions = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), counts)
    if breaks:
        positions += np.searchsorted(np.flatnonzero(kinds == 2), starts)
    return strings(ends - starts, body[inside[1:-1]]), counts, positions


def joined(words: pa.Array) -> bytes:
    return b" ".join(words.to_pylist())


def parted(blob: bytes) -> pa.BinaryArray:
    """The words that ``joined`` put together (none of them is empty or holds a blank)."""
    body = np.frombuffer(blob, np.uint8)
    gaps = np.flatnonzero(body == 32)
    if not len(body):
        return pa.array([], pa.binary())
    return strings(np.diff(np.concatenate([[-1], gaps, [len(body)]])) - 1, body[body != 32])


def planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: all lowest bytes, then all second ones, as many as the largest number needs."""
    values = np.ascontiguousarray(values, np.int64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1).T
    return out.view(np.int64).ravel()


def gaps(values: np.ndarray) -> bytes:
    """Whole numbers in ascending order, as planes of the steps between them."""
    return planes(np.diff(values, prepend=0))


def from_gaps(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob))


def split(code: Callable[[np.ndarray], bytes], values: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of ``values``, each coded."""
    return pa.array([code(values[a:b]) for a, b in zip(firsts, ends)], pa.binary())


def text_chunks(texts: DataFrame, per: str | None = None, carry: tuple[str, ...] = (), counted: str | None = None,
                blanks: bytes = BLANKS, breaks: bytes = b"", limit: int = CHUNK_BYTES) -> DataFrame:
    """``texts`` (text, ...) -> (chunk, per, sizes, tokens, positions, words, counts, carried_0, ...), one row a chunk.

    ``tokens`` (as ``planes``) are places in ``words``, which holds the chunk's distinct words in order of their first use;
    ``counts`` says how often each occurs in texts whose column ``counted`` is true (all, without it).
    ``sizes`` are the numbers of words of the texts and the carried lists their other columns.  A chunk
    has one value of ``per`` only.  A null text is empty.  ``positions`` (as ``gaps``) are kept only
    with ``breaks``.
    """
    columns = [texts.schema[c].dataType.simpleString() for c in carry]
    schema = ", ".join(["chunk bigint, per string, sizes array<int>, tokens binary, positions binary, words binary",
                        "counts array<bigint>", *[f"carried_{k} array<{kind}>" for k, kind in enumerate(columns)]])
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def emit(number: int, value, table: pa.Table) -> pa.RecordBatch:
        body = [t or b"" for t in table.column(0).to_pylist()]
        found, sizes, positions = split_words(body, blanks, breaks)
        coded = found.dictionary_encode()
        tokens = np.asarray(coded.indices, np.int32)
        learned = np.asarray(table.column(2)).astype(bool)
        counts = np.bincount(tokens[np.repeat(learned, sizes)], minlength=len(coded.dictionary))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        arrays = [pa.array([number], pa.int64()), pa.array([value], pa.string()), one(sizes, pa.int32()),
                  pa.array([planes(tokens)], pa.binary()), pa.array([gaps(positions if breaks else tokens[:0])], pa.binary()),
                  pa.array([joined(coded.dictionary)], pa.binary()), one(counts, pa.int64())]
        for k in range(len(carry)):
            column = table.column(3 + k).combine_chunks()
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            for value in table.column(1).unique().to_pylist():
                mine = table if per is None else table.filter(
                    pc.is_null(table.column(1)) if value is None else pc.equal(table.column(1), value))
                number += 1
                yield emit(number, value, mine)
            held, size = [], 0

        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0))
            first = 0
            for row, n in enumerate(lengths.tolist()):
                size += n + 1
                if size >= limit:
                    held.append(batch.slice(first, row + 1 - first))
                    yield from flush()
                    first = row + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield from flush()

    learned = F.lit(True) if counted is None else F.coalesce(F.col(counted), F.lit(False))
    chosen = texts.select(F.col("text").cast("binary").alias("text"),
                          (F.lit(None).cast("string") if per is None else F.col(per).cast("string")).alias("per"),
                          learned.alias("learned"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    return chosen.mapInArrow(run, schema)


def by_key(function: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]]):
    """Run ``function(key, rows)`` on all rows of each key (the first column) of a partition sorted by it."""
    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() if pa.types.is_primitive(c.type) or pa.types.is_string(c.type) else c
                             for c in batch.columns]):
                if row[0] != key and held:
                    yield from function(key, held)
                    held = []
                key = row[0]
                held.append(row)
        if held:
            yield from function(key, held)

    return run


def array_of(value) -> np.ndarray:
    """A list value of a row as numpy array."""
    return np.asarray(value.values)


def dealt(asked: DataFrame, groups: int) -> DataFrame:
    """Rows of one ``shard`` in one partition, shard by shard."""
    return asked.repartitionById(groups, "shard").sortWithinPartitions("shard")


def answer_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, ANSWER_FIELDS)],
                                      [name for name, _ in ANSWER_FIELDS])


def number_words(chunks: DataFrame, space: Workspace, least: int = 1, reserved: int = 1) -> DataFrame:
    """Count the distinct (per, word) over all chunks and number those with a count of ``least`` or more.

    ``chunks`` (chunk, per, words, counts) -> ``ANSWERS``: of each chunk the places (``at``) of its words that have
    a number, with number and count; and with a null chunk the words themselves.  Numbers start at ``reserved``.
    """
    groups = partitions(chunks.sparkSession)

    def ask(batches):
        for batch in batches:
            for chunk, per, blob, counts in zip(*[c if k == 3 else c.to_pylist() for k, c in enumerate(batch.columns)]):
                words = parted(blob)
                if not len(words):
                    continue
                seed = xxhash.xxh64_intdigest(b"" if per is None else per.encode(), 1)
                shard = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words)) % groups
                order = np.argsort(shard, kind="stable")
                shards, firsts = np.unique(shard[order], return_index=True)
                ends = np.append(firsts[1:], len(order))
                blobs = [joined(words.take(pa.array(order[a:b]))) for a, b in zip(firsts, ends)]
                n = len(shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards.astype(np.int32)), pa.array([chunk] * n, pa.int64()), pa.array([per] * n, pa.string()),
                     split(gaps, order, firsts, ends), pa.array(blobs, pa.binary()), split(planes, array_of(counts)[order], firsts, ends)],
                    ["shard", "chunk", "per", "at", "words", "counts"])

    def answer(shard, rows):
        pers = sorted({r[2] for r in rows}, key=lambda p: (p is not None, p))
        code = {p: k for k, p in enumerate(pers)}
        parts = [parted(r[4].as_py()) for r in rows]
        sizes = np.array([len(p) for p in parts])
        coded = pa.concat_arrays(parts).dictionary_encode()
        key = np.asarray(coded.indices).astype(np.int64) + np.repeat([code[r[2]] for r in rows], sizes) * len(coded.dictionary)
        keys, inverse = np.unique(key, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate([from_planes(r[5].as_py()) for r in rows]))
        kept = total >= least
        ids = np.where(kept, (np.cumsum(kept) - 1) * groups + shard + reserved, 0)
        out, first = [], 0
        for row, n in zip(rows, sizes):
            mine = inverse[first:first + n]
            some = np.flatnonzero(kept[mine])
            first += n
            out.append((row[1], gaps(from_gaps(row[3].as_py())[some]), planes(ids[mine[some]]), planes(total[mine[some]]), *[None] * 6))
        for p in pers:
            mine = np.flatnonzero(kept & (keys // max(1, len(coded.dictionary)) == code[p]))
            if len(mine):
                words = coded.dictionary.take(pa.array(keys[mine] % len(coded.dictionary)))
                out.append((*[None] * 4, p, joined(words), ids[mine], total[mine], None, None))
        yield answer_batch(out)

    asked = chunks.select("chunk", "per", "words", "counts").mapInArrow(
        ask, "shard int, chunk bigint, per string, at binary, words binary, counts binary")
    return space.cut(dealt(asked, groups).mapInArrow(by_key(answer), ANSWERS), "words")


def number_pairs(asked: DataFrame, space: Workspace, least: int, reserved: int = 1) -> DataFrame:
    """Count pairs (first, rest) over all chunks and number those with a count of ``least`` or more, as ``ANSWERS``.

    ``asked`` (shard, chunk, at, first, rest, counts) comes from ``ask_pairs``.
    """
    groups = partitions(asked.sparkSession)

    def answer(shard, rows):
        parts = [(from_gaps(r[3].as_py()), from_planes(r[4].as_py()), from_planes(r[5].as_py())) for r in rows]
        first, rest, counts = (np.concatenate(c) for c in zip(*parts))
        sizes = [len(p[0]) for p in parts]
        order = np.lexsort((rest, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (rest[order][1:] != rest[order][:-1])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        total = np.zeros(int(new.sum()), np.int64)
        np.add.at(total, inverse, counts)
        kept = total >= least
        ids = np.where(kept, (np.cumsum(kept) - 1) * groups + shard + reserved, 0)
        out, begin = [], 0
        for row, n in zip(rows, sizes):
            mine = inverse[begin:begin + n]
            begin += n
            some = np.flatnonzero(kept[mine])
            if len(some):
                out.append((row[1], gaps(from_gaps(row[2].as_py())[some]), planes(ids[mine[some]]), *[None] * 7))
        one = order[new][kept]
        out.append((*[None] * 6, ids[kept], total[kept], first[one], rest[one]))
        yield answer_batch(out)

    return space.cut(dealt(asked, groups).mapInArrow(by_key(answer), ANSWERS), "pairs")


def ask_pairs(chunk: int, first: np.ndarray, rest: np.ndarray, counts: np.ndarray, groups: int) -> pa.RecordBatch:
    """Distinct pairs of a chunk, in ascending order, dealt to groups by hash."""
    shard = mixed(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.astype(np.uint64)) % np.uint64(groups)
    order = np.argsort(shard, kind="stable")
    shards, firsts = np.unique(shard[order], return_index=True)
    ends = np.append(firsts[1:], len(order))
    return pa.RecordBatch.from_arrays(
        [pa.array(shards.astype(np.int32)), pa.array([chunk] * len(shards), pa.int64()), split(gaps, order, firsts, ends),
         split(gaps, first[order], firsts, ends), split(planes, rest[order], firsts, ends), split(planes, counts[order], firsts, ends)],
        ["shard", "chunk", "at", "first", "rest", "counts"])


ASKED_PAIRS = "shard int, chunk bigint, at binary, first binary, rest binary, counts binary"


def looked_up(answers: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, count) of each of a chunk's ``size`` keys from the answers to it; zeros where none was given."""
    ids, counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for at, numbers, times in zip(*[answers.column(c).to_pylist() for c in ("at", "numbers", "times")]):
        place = from_gaps(at)
        ids[place] = from_planes(numbers)
        if times is not None:
            counts[place] = from_planes(times)
    return ids, counts


def answered(asking: DataFrame, answers: DataFrame, join: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring each chunk together with the answers to it."""
    given = answers.where("chunk is not null").select("chunk", "at", "numbers", "times")
    return asking.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(join, schema)
