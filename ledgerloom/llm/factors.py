"""Remove passages that an earlier statement text holds already: longest previous factors, distributed.

A byte goes if a string of ``SPAN`` bytes over it also starts in a statement with a smaller id, that
is, if the longest previous factor at some start over it reaches ``SPAN``.  Suffixes are compared up
to ``SPAN`` bytes, so suffix order can be dealt out:

1. Each start is named after its *anchor*, the ``GRAM``-byte gram with the smallest hash among those
   inside its span.  Equal spans have equal anchors, and consecutive starts with one anchor form a
   *run*.  Texts are cut into runs; a run equal to one of an earlier text goes as a whole.
2. Runs that share an anchor but not their bytes may still share some of their spans.  Only these
   send their bytes on; their suffixes are put in order, with the common prefix (LCP) of neighbours, up
   to ``SPAN`` bytes.  Previous and next smaller positions in that order, a position being the id of the
   statement, give the longest previous factor of each suffix, and those that reach ``SPAN`` go.
3. The starts found are brought back to their texts.

What is equal within a chunk of texts is folded there, before a shuffle, so a passage that a third of
all texts share costs a row per chunk; an anchor with many different runs in one chunk is dealt out by
span instead of by anchor.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import Rolling, chunked, mixed, packed, partitions, small_batches
from ledgerloom.storage import Workspace

SPAN = 50
GRAM = 20
CROWD = 16
CHUNK_BYTES = 1 << 20
SLICE = 1 << 18
REMOVE, COMPARE, SCATTER = 0, 1, 2

# columns of the packed rows: anchors of runs, starts found, and bytes to compare
RUN = {"h": "<u4", "d": "<u8", "doc": "<i8", "tag": "<u4", "lo": "<u4", "n": "u1", "crowd": "u1"}
FOUND = {"doc": "<i8", "tag": "<u4", "lo": "<u4", "n": "u1", "op": "u1"}
PART = {"doc": "<i8", "tag": "<u4", "lo": "<u4", "n": "u1"}
TEXT = {"doc": "<i8", "size": "<i8"}
Columns = dict[str, np.ndarray]


def freeze(columns: Columns, kinds: dict[str, str], body: bytes = b"") -> bytes:
    raw = b"".join(columns[k].astype(t).tobytes() for k, t in kinds.items())
    return zstandard.compress(raw + body, 1)


def thaw(blob: bytes, n: int, kinds: dict[str, str]) -> tuple[Columns, bytes]:
    raw, at, out = zstandard.decompress(blob), 0, {}
    for k, t in kinds.items():
        out[k] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out, raw[at:]


def taken(columns: Columns, at: np.ndarray) -> Columns:
    return {k: v[at] for k, v in columns.items()}


def joined(parts: list[Columns], kinds: dict[str, str]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in kinds.items()}


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of texts an id belongs to."""
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def dealt_rows(columns: Columns, kinds: dict[str, str], target: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(target, rows, packed rows) for each target."""
    order = np.argsort(target, kind="stable")
    sorted_target = target[order]
    edges = np.flatnonzero(np.diff(sorted_target)) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield int(target[part[0]]), len(part), freeze(taken(columns, part), kinds)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                      ["target", "kind", "n", "blob"])


ROW = "target bigint, kind int, n bigint, blob binary"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window of ``width``."""
    place, n = np.arange(len(values)), 1
    while n < width:
        step = min(n, width - n)
        later = values[step:] < values[:-step]
        values, place = np.where(later, values[step:], values[:-step]), np.where(later, place[step:], place[:-step])
        n += step
    return place


def runs_of(texts: list[bytes], ids: np.ndarray, tags: np.ndarray) -> Columns:
    """All runs of the texts: anchor ``a``, digest ``d``, text, first start ``lo`` and starts ``n``."""
    body, begins, sizes = packed(texts, gap=1)
    empty = {"a": np.zeros(0, np.uint64), **{k: np.zeros(0, t) for k, t in PART.items()}, "d": np.zeros(0, np.uint64)}
    if len(body) < SPAN:
        return empty
    rolling = Rolling(body)
    at = np.arange(len(body) - GRAM + 1)
    grams = rolling.slices(at, at + GRAM)
    anchor = _smallest(grams, SPAN - GRAM + 1)
    text = np.repeat(np.arange(len(texts)), sizes + 1)[: len(anchor)]
    inside = np.arange(len(anchor)) + SPAN <= (begins + sizes)[text]
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(anchor))
    start, stop = start[inside[start]], stop[inside[start]]
    owner = text[start]
    return {"a": grams[anchor[start]], "d": rolling.slices(start, stop - 1 + SPAN), "doc": ids[owner],
            "tag": tags[owner], "lo": (start - begins[owner]).astype(np.uint32), "n": (stop - start).astype(np.uint8)}


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins, in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _first_doc(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first doc of each row's group."""
    return doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else doc


def fold_chunk(runs: Columns) -> tuple[Columns, Columns]:
    """Runs to send on, and what is already known: equal runs of a later text of the chunk go.

    If an anchor has over ``CROWD`` different runs here, all of them are to be compared by span, and one
    of them tells the others elsewhere so.
    """
    order = np.lexsort((runs["lo"], runs["doc"], runs["d"], runs["a"]))
    r = taken(runs, order)
    same = _firsts(r["a"], r["d"])
    later = r["doc"] > _first_doc(same, r["doc"])
    group = np.cumsum(_firsts(r["a"])) - 1
    crowd = (np.bincount(group, weights=same) > CROWD)[group] if len(group) else np.zeros(0, bool)
    known = taken(r, np.flatnonzero(later | crowd))
    known["op"] = np.where(later, REMOVE, SCATTER)[later | crowd].astype(np.uint8)
    send = ~later & (~crowd | _firsts(r["a"]))
    out = taken(r, np.flatnonzero(send))
    out["crowd"] = crowd[send].astype(np.uint8)
    return out, known


def _cut_to_runs(buckets: int, groups: int):
    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            ids = np.asarray(table.column("stmt_id"), np.int64)
            tags = np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))
            send, known = fold_chunk(runs_of(texts, ids, tags))
            target = (send["a"] % np.uint64(buckets)).astype(np.int64)
            send["h"] = (send["a"] >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((send["lo"], send["doc"]))
            send, target = taken(send, order), target[order]
            rows = [(t, 0, n, blob) for t, n, blob in dealt_rows(send, RUN, target)]
            rows += [(t, 1, n, blob) for t, n, blob in dealt_rows(known, FOUND, group_of(known["doc"], groups))]
            yield _rows(rows)

    return run


def judge_runs(r: Columns) -> Columns:
    """Of all runs of some anchors: those to remove, and those to compare by their bytes."""
    order = np.lexsort((r["doc"], r["d"], r["key"]))
    r = taken(r, order)
    by_key, same = _firsts(r["key"]), _firsts(r["key"], r["d"])
    group = np.cumsum(by_key) - 1
    later = (r["doc"] > _first_doc(same, r["doc"])) & (r["crowd"] == 0)
    starts = np.flatnonzero(by_key)
    low = np.minimum.reduceat(r["doc"], starts) if len(starts) else r["doc"]
    high = np.maximum.reduceat(r["doc"], starts) if len(starts) else r["doc"]
    kinds = np.bincount(group, weights=same)
    crowd = np.bincount(group, weights=r["crowd"]) > 0
    differ = ((kinds > 1) & (low < high) | crowd)[group]
    send = differ & (~later | crowd[group]) & (r["crowd"] == 0)
    out = taken(r, np.flatnonzero(later | send))
    out["op"] = np.where(~send, REMOVE, np.where(crowd[group], SCATTER, COMPARE))[later | send].astype(np.uint8)
    return out


def _judge(groups: int):
    def run(batches):
        parts, passed = [], []
        for batch in batches:
            for target, kind, n, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if kind:
                    passed.append((target, 0, n, blob))
                else:
                    columns, _ = thaw(blob, n, RUN)
                    key = (np.uint64(target) << np.uint64(32)) | columns.pop("h").astype(np.uint64)
                    parts.append({"key": key, **columns})
            if len(passed) > 100:
                yield _rows(passed)
                passed = []
        kinds = {"key": "<u8", **{k: t for k, t in RUN.items() if k != "h"}}
        found = judge_runs(joined(parts, kinds))
        del parts
        rows = [(t, 0, n, blob) for t, n, blob in dealt_rows(found, FOUND, group_of(found["doc"], groups))]
        yield _rows(passed + rows)

    return run


def bundles(statements: DataFrame, groups: int, carry: list[str]) -> DataFrame:
    """Texts in packed bundles by group, with the columns to ``carry`` beside them."""
    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            ids = np.asarray(table.column("stmt_id"), np.int64)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            target = group_of(ids, groups)
            order = np.argsort(target, kind="stable")
            beside = table.select(range(2, 2 + len(carry))).combine_chunks()
            rows, more = [], []
            for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
                body = b"".join([texts[k] for k in part])
                rows.append((int(target[part[0]]), 1, len(part),
                             freeze({"doc": ids[part], "size": sizes[part]}, TEXT, body)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, beside.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(beside.take(pa.array(part)))
                more.append(sink.getvalue().to_pybytes() if carry else None)
            batch = _rows(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(more, pa.binary())], [*batch.schema.names, "more"])

    beside = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    return statements.select("stmt_id", "text", *beside).mapInArrow(run, ROW + ", more binary")


def _with_texts(batches, wanted: tuple[int, ...]) -> Iterator[tuple[np.ndarray, list[bytes], list[Columns], bytes]]:
    """Each bundle with the starts found in each of its texts; the rows of a group come with its starts first."""
    current, parts, starts = None, [], None
    for batch in batches:
        for target, kind, n, blob, more in zip(*[c.to_pylist() for c in batch.columns]):
            if target != current:
                current, parts, starts = target, [], None
            if not kind:
                columns, _ = thaw(blob, n, FOUND)
                parts.append(taken(columns, np.flatnonzero(np.isin(columns["op"], wanted))))
                continue
            if starts is None:
                starts = joined(parts, FOUND)
                starts = taken(starts, np.lexsort((starts["lo"], starts["tag"], starts["doc"])))
                parts = []
            columns, body = thaw(blob, n, TEXT)
            ends = np.cumsum(columns["size"])
            texts = [body[b - s:b] for b, s in zip(ends.tolist(), columns["size"].tolist())]
            first = np.searchsorted(starts["doc"], columns["doc"], "left")
            last = np.searchsorted(starts["doc"], columns["doc"], "right")
            own = []
            for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                some = slice(a, b)
                if a < b:
                    tag = zlib.crc32(texts[k])
                    mine = starts["tag"][a:b] == tag
                    some = a + np.flatnonzero(mine)
                own.append({c: starts[c][some] for c in FOUND})
            yield columns["doc"], texts, own, more


def _to_compare(buckets: int, groups: int):
    """The bytes of the runs to compare, to the bucket of their anchor or, if crowded, of each span."""
    def run(batches):
        runs, bodies, wide, spans, held = [], [], [], [], 0
        for ids, texts, own, _ in _with_texts(batches, (COMPARE, SCATTER)):
            for doc, text, some in zip(ids.tolist(), texts, own):
                for lo, n, tag, op in zip(some["lo"].tolist(), some["n"].tolist(), some["tag"].tolist(), some["op"].tolist()):
                    if op == COMPARE:
                        runs.append((doc, tag, lo, n))
                        bodies.append(text[lo:lo + n - 1 + SPAN])
                    else:
                        for k in range(lo, lo + n):
                            wide.append((doc, tag, k, 1))
                            spans.append(text[k:k + SPAN])
                    held += n - 1 + SPAN
            if held > CHUNK_BYTES:
                yield _parts(runs, bodies, wide, spans, buckets, groups)
                runs, bodies, wide, spans, held = [], [], [], [], 0
        yield _parts(runs, bodies, wide, spans, buckets, groups)

    return run


def _parts(runs, bodies, wide, spans, buckets: int, groups: int) -> pa.RecordBatch:
    """Packed rows of runs by anchor and of single spans by content, equal spans folded to the smallest doc."""
    rows = []
    if runs:
        body = np.frombuffer(b"".join(bodies), np.uint8)
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))
        begin = np.cumsum(size) - size
        at = np.arange(len(body) - GRAM + 1)
        grams = np.append(Rolling(body).slices(at, at + GRAM), np.uint64(0))
        # the anchor is the smallest gram among those inside every span of the run
        edges = np.stack([begin + size - SPAN, begin + SPAN - GRAM + 1], axis=1).ravel()
        target = (np.minimum.reduceat(grams, edges)[::2] % np.uint64(buckets)).astype(np.int64)
        rows += _part_rows(runs, bodies, target)
    if spans:
        first: dict[bytes, int] = {}
        for row, span in zip(wide, spans):
            first[span] = min(row[0], first.get(span, row[0]))
        known = [row for row, span in zip(wide, spans) if row[0] > first[span]]
        if known:
            columns = {k: np.array(v, t) for (k, t), v in zip(PART.items(), zip(*known))}
            columns["op"] = np.full(len(known), REMOVE, np.uint8)
            rows += [(t, 1, n, blob) for t, n, blob in dealt_rows(columns, FOUND, group_of(columns["doc"], groups))]
        kept = [k for k, (row, span) in enumerate(zip(wide, spans)) if row[0] == first[span]]
        wide, spans = [wide[k] for k in kept], [spans[k] for k in kept]
        at = np.arange(0, len(spans) * SPAN, SPAN)
        target = (Rolling(np.frombuffer(b"".join(spans), np.uint8)).slices(at, at + SPAN) % np.uint64(buckets)).astype(np.int64)
        rows += _part_rows(wide, spans, target)
    return _rows(rows)


def _part_rows(runs, bodies, target):
    order = np.argsort(target, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
        some = [runs[k] for k in part]
        columns = {k: np.array(v, t) for (k, t), v in zip(PART.items(), zip(*some))}
        out.append((int(target[part[0]]), 0, len(part), freeze(columns, PART, b"".join([bodies[k] for k in part]))))
    return out


def _words(body: np.ndarray, starts: np.ndarray, places: tuple[int, ...]) -> list[np.ndarray]:
    """The eight bytes at each of ``places`` behind a start, as numbers that are in the order of the bytes."""
    out = []
    for at in places:
        word = np.zeros(len(starts), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | body[starts + (at + k)].astype(np.uint64)
        out.append(word)
    return out


def suffix_order(body: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``SPAN`` bytes, then by doc, and the common prefix (up to ``SPAN``) of each with the one before."""
    places = (*range(0, SPAN - 7, 8), SPAN - 8)
    words = _words(body, starts, places)
    order = np.lexsort((doc, *words[::-1]))
    common = np.zeros(len(starts), np.uint8)
    same = np.ones(max(len(starts) - 1, 0), bool)
    for at, word in zip(places, words):
        word = word[order]
        differ = word[1:] ^ word[:-1]
        equal = sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.uint8) for k in range(1, 9))
        common[1:] = np.where(same, at + equal, common[1:])
        same &= differ == 0
    return order, common


def factors_before(doc: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """What each suffix shares with its previous smaller position: the next one before it, in suffix order, of a smaller doc.

    0 where that is under ``least``.  Nothing between a suffix and ``place`` has a smaller doc, so whoever finds none at
    ``place`` goes on from where that one got to; a walk ends once it shares less than ``least`` bytes.
    """
    place, shared = np.arange(len(doc)) - 1, common.copy()
    shared[:1] = 0
    open_ = np.flatnonzero(shared >= least)
    open_ = open_[doc[place[open_]] >= doc[open_]]
    while len(open_):
        at = place[open_]
        further, less = place[at], np.minimum(shared[open_], shared[at])
        place[open_], shared[open_] = further, less
        open_ = open_[less >= least]
        open_ = open_[doc[place[open_]] >= doc[open_]]
    return np.where(shared >= least, shared, 0)


def longest_previous_factors(doc: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor of each suffix in suffix order: the longer of what it shares with its previous and
    with its next smaller position (0 if under ``least``)."""
    mirrored = np.zeros_like(common)
    mirrored[1:] = common[:0:-1]
    return np.maximum(factors_before(doc, common, least), factors_before(doc[::-1], mirrored, least)[::-1])


def previous_factors(body: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the longest previous factor of the suffix at a start reaches ``SPAN``.

    Slices of the suffix order are taken one after the other.  They end where the first eight bytes change, so
    nothing within reach of ``SPAN`` bytes is cut apart.
    """
    first, = _words(body, starts, (0,))
    order = np.argsort(first, kind="stable")
    first = first[order]
    reached, begin = np.zeros(len(starts), bool), 0
    while begin < len(order):
        end = min(begin + SLICE, len(order))
        end = int(np.searchsorted(first, first[end - 1], "right"))
        some = order[begin:end]
        inside, common = suffix_order(body, starts[some], doc[some])
        some = some[inside]
        reached[some] = longest_previous_factors(doc[some], common, SPAN) >= SPAN
        begin = end
    return reached


def _compare(groups: int):
    def run(batches):
        parts, bodies, passed = [], [], []
        for batch in batches:
            for target, kind, n, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if kind:
                    passed.append((target, 0, n, blob))
                    continue
                columns, body = thaw(blob, n, PART)
                parts.append(columns)
                bodies.append(body)
        p = joined(parts, PART)
        if len(p["doc"]):
            n = p["n"].astype(np.int64)
            size = n - 1 + SPAN
            run_of = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(run_of)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(np.cumsum(size) - size, n) + within
            later = np.flatnonzero(previous_factors(np.frombuffer(b"".join(bodies), np.uint8), starts, p["doc"][run_of]))
            own, place = run_of[later], within[later]
            new = _firsts(own, place - np.arange(len(place)))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(own)))
            found = taken(p, own[first])
            found["lo"] = found["lo"] + place[first].astype(np.uint32)
            found["n"] = count.astype(np.uint8)
            found["op"] = np.full(len(first), REMOVE, np.uint8)
            passed += [(t, 0, n, blob) for t, n, blob in dealt_rows(found, FOUND, group_of(found["doc"], groups))]
        yield _rows(passed)

    return run


def _cut_out(batches):
    """(stmt_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each text."""
    for ids, texts, own, more in _with_texts(batches, (REMOVE,)):
        removed, spans, digest, left = [], [], [], []
        for text, some in zip(texts, own):
            rest, gone, count = text, 0, 0
            if len(some["lo"]):
                lo = some["lo"].astype(np.int64)
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, lo, 1)
                np.add.at(change, lo + some["n"] - 1 + SPAN, -1)
                covered = np.cumsum(change[:-1]) > 0
                gone = int(covered.sum())
                count = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                rest = np.frombuffer(text, np.uint8)[~covered].tobytes()
            removed.append(gone)
            spans.append(count)
            digest.append(hashlib.sha256(rest).hexdigest())
            left.append(rest.decode("utf-8", "ignore"))
        beside = pa.ipc.open_stream(more).read_all().combine_chunks() if more else None
        columns = [c.combine_chunks() for c in beside.columns] if beside else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string()), *columns],
            ["stmt_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept",
             *[f"carried_{k}" for k in range(len(columns))]])


def remove_repeated_passages(statements: DataFrame, space: Workspace | None = None,
                             carry: list[str] | None = None) -> DataFrame:
    """Cut passages out of statement texts that a statement with a smaller id holds.

    ``statements`` (stmt_id: bigint, text, ...) -> one row per row: (stmt_id, n_bytes, n_removed,
    n_spans, kept_sha256, kept).  Texts are UTF-8 bytes (null: empty).  A byte goes if it lies in a
    string of 50 bytes that also starts in a statement with a smaller id, in the texts as given; strings
    do not cross texts, and copies within a text or between rows of one id stay.  ``kept`` is what is
    left as text, without the bytes of characters cut in half; ``kept_sha256`` is of all bytes left.
    Rows with a null id have no place in the order: they stay whole and no other row is compared with
    them.  Texts under 50 bytes stay whole, longer ones may have any length; an empty
    table gives an empty result.  Other columns are not read, but for those to ``carry``, which
    come last under the names carried_0, carried_1 and so on.
    """
    spark = statements.sparkSession
    small_batches(spark)
    space = space or Workspace(spark, "factors")
    # one bucket of anchors and one group of texts per partition: packed rows go to the partition they name
    n = buckets = groups = partitions(spark)
    carry = carry or []
    known = statements.where("stmt_id is not null").withColumn("stmt_id", F.col("stmt_id").cast("bigint"))
    runs = known.select("stmt_id", "text").mapInArrow(_cut_to_runs(buckets, groups), ROW)
    found = space.cut(runs.repartitionById(n, F.col("target").cast("int")).mapInArrow(_judge(groups), ROW), "found")

    def with_texts(starts: DataFrame, carry: list[str]) -> DataFrame:
        starts = starts.withColumn("more", F.lit(None).cast("binary"))
        rows = starts.union(bundles(known, groups, carry))
        return rows.repartitionById(n, F.col("target").cast("int")).sortWithinPartitions("target", "kind")

    parts = with_texts(found, []).mapInArrow(_to_compare(buckets, groups), ROW)
    more = space.cut(parts.repartitionById(n, F.col("target").cast("int")).mapInArrow(_compare(groups), ROW), "more")
    shape = "stmt_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
    beside = [f"carried_{k} {statements.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)]
    cut = with_texts(found.union(more), carry).mapInArrow(_cut_out, ", ".join([shape, *beside]))
    text = F.coalesce("text", F.lit(""))
    whole = statements.where("stmt_id is null").select(
        F.lit(None).cast("bigint").alias("stmt_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(text, 256).alias("kept_sha256"), text.alias("kept"),
        *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    return cut.union(whole)


def without_repeated_passages(statements: DataFrame, space: Workspace | None = None) -> DataFrame:
    """``statements`` with their columns, repeated passages cut out of ``text``.

    A statement of which only blanks are left goes; one that lost nothing keeps its text (null too).
    """
    columns = statements.columns
    beside = [c for c in columns if c != "text"]
    no_text = "text is null"
    cut = remove_repeated_passages(statements.withColumn(no_text, F.col("text").isNull()), space, [*beside, no_text])
    text = F.when(~F.col(f"carried_{len(beside)}"), F.col("kept"))
    return cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S")).select(
        *[(text if c == "text" else F.col(f"carried_{beside.index(c)}")).alias(c) for c in columns])
