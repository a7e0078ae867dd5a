"""Pack tokenised statement texts into sequences of fixed length by linear grouping and best fit."""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.batches import partitions, small_batches
from ledgerloom.storage import Workspace

CAPACITY = 2048
LARGE = 256
GROUPS = 128
END = b"\0\0\0\0"


class Encoder:
    """Token ids (little-endian bytes) of a text, as the tokenizer file gives them.

    With ``ranks_path``, the same vocabulary as merge ranks, texts without a special string are
    encoded by the faster library; the others always go to the tokenizer.
    """

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = byte_ranks(ranks_path) if ranks_path else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if self.ranks and not any(s in text for s in self.special):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def byte_ranks(path: str):
    """The byte-level vocabulary of a merge-rank file as an encoder without special tokens."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks_path: str | None = None) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def pieces_of(statements: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
              ranks_path: str | None = None) -> DataFrame:
    """``statements`` (stmt_id, text) -> (stmt_id, piece, start, length, ids_crc32).

    A text's ids end with id 0; a null text is empty.  Longer ones are cut into pieces of
    ``capacity`` ids, of which the first may be shorter.
    """
    small_batches(statements.sparkSession)
    kind = statements.schema["stmt_id"].dataType

    def run(batches):
        ids_of = encoder(tokenizer_path, ranks_path).encode
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = ids_of(text or "") + END
                n, first, k = len(ids) // 4, 0, 0
                last = n % capacity or capacity
                while first < n:
                    rows.append(row); piece.append(k); start.append(first); length.append(last - first)
                    crc.append(zlib.crc32(ids[4 * first:4 * last]))
                    first, last, k = last, last + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["stmt_id", "piece", "start", "length", "ids_crc32"])

    return statements.select("stmt_id", "text").mapInArrow(
        run, f"stmt_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _fill(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Counts of each size for one sequence: the largest left, then the best completion (subset sums)."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach: list[tuple[int, int] | None] = [None] * (room + 1)
    reach[0] = (-1, 0)
    best = 0
    for i in range(first, len(sizes)):
        s, n = sizes[i], left[i] - (i == first)
        if n <= 0 or s > room:
            continue
        used = [0] * (room + 1)
        for total in range(s, room + 1):
            if reach[total] is None and reach[total - s] is not None and used[total - s] < n:
                used[total] = used[total - s] + 1
                reach[total] = (i, total - s)
                best = max(best, total)
        if reach[room] is not None:
            best = room
            break
    counts = [0] * len(sizes)
    counts[first] = 1
    while best:
        i, best = reach[best]
        counts[i] += 1
    return counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE,
         groups: int = GROUPS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``histogram``: pieces of each length -> [(((length, copies), ...), sequences)].

    Linear grouping: the lengths over ``large``, in descending order, fall into ``groups`` groups of
    equal cardinality, each rounded up to its largest.  Configurations of these few sizes are
    chosen one after the other, each the largest size left with its best completion and used as
    often as the groups allow.  Actual lengths then take the places of their group in order, and the
    small ones go to the fullest sequence with room.  Work and result depend on the number of
    distinct lengths, not of pieces.
    """
    bigs = sorted((n for n in histogram if n > large and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in bigs)
    if len(bigs) <= groups:
        parts = [[[n, histogram[n]]] for n in bigs]
    else:
        parts, share, filled = [[]], -(-total // groups), 0
        for n in bigs:
            rest = histogram[n]
            while rest:
                if filled == share:
                    parts.append([])
                    filled = 0
                take = min(rest, share - filled)
                parts[-1].append([n, take])
                filled += take
                rest -= take
    sizes = [p[0][0] for p in parts]
    left = [sum(c for _, c in p) for p in parts]
    at = [0] * len(parts)
    runs: list[tuple[dict[int, int], int]] = []
    while any(left):
        counts = _fill(sizes, left, capacity)
        slots = [i for i, c in enumerate(counts) for _ in range(c)]
        times = min(left[i] // c for i, c in enumerate(counts) if c)
        for i, c in enumerate(counts):
            left[i] -= c * times
        # each slot is a run of actual lengths; cut all slots where any of them changes its length
        tracks = []
        for i in slots:
            need, track = times, []
            while need:
                n, c = parts[i][at[i]]
                take = min(need, c)
                track.append([n, take])
                need -= take
                parts[i][at[i]][1] -= take
                if not parts[i][at[i]][1]:
                    at[i] += 1
            tracks.append(track)
        where = [0] * len(tracks)
        while times:
            step = min(t[w][1] for t, w in zip(tracks, where))
            content: dict[int, int] = {}
            for k, t in enumerate(tracks):
                n = t[where[k]][0]
                content[n] = content.get(n, 0) + 1
                t[where[k]][1] -= step
                if not t[where[k]][1]:
                    where[k] += 1
            runs.append((content, step))
            times -= step
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for content, n in runs:
        rooms.setdefault(capacity - sum(k * c for k, c in content.items()), []).append((content, n))
    order = sorted(rooms)

    def put(room: int, run: tuple[dict[int, int], int]) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append(run)

    for n in sorted((n for n in histogram if n <= large), reverse=True):
        need = histogram[n]
        while need:
            i = bisect_left(order, n)
            if i == len(order):
                fit = min(capacity // n, need)
                times = need // fit
                put(capacity - n * fit, ({n: fit}, times))
                need -= fit * times
                continue
            room = order[i]
            content, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[i]
            fit = min(room // n, need)
            take = min(times, need // fit)
            if take < times:
                put(room, (content, times - take))
            put(room - n * fit, (content | {n: content.get(n, 0) + fit}, take))
            need -= fit * take
    return [(tuple(sorted(content.items(), reverse=True)), n) for room in rooms.values() for content, n in room]


def pack(pieces: DataFrame, capacity: int = CAPACITY, space: Workspace | None = None) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (stmt_id, piece, start, length, ids_crc32).

    Only the counts of the at most ``capacity`` lengths reach the driver, and the plan that comes
    back is as small.  A piece's place among those of its length is its rank within a hashed slot
    plus the sizes of the slots before, so a length that many pieces share is ranked in parts.
    """
    spark = pieces.sparkSession
    space = space or Workspace(spark, "packing")
    slots = partitions(spark, 8)
    slot = F.pmod(F.xxhash64("stmt_id", "piece", "ids_crc32"), F.lit(slots)).cast("int")
    placed = space.cut(pieces.withColumn("slot", slot), "pieces")
    counts = space.cut(placed.groupBy("length", "slot").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows, base = [], 0
    ranks = dict.fromkeys(histogram, 0)
    for content, times in plan(histogram, capacity):
        for n, copies in content:
            rows.append((n, ranks[n], base, copies))
            ranks[n] += copies * times
        base += times
    rows.sort()
    by_length = {}
    for n, rank, first, copies in rows:
        by_length.setdefault(n, []).append((rank, first, copies))
    shared = spark.sparkContext.broadcast({n: np.array(x, np.int64).T for n, x in by_length.items()})
    before = (F.sum("count").over(Window.partitionBy("length").orderBy("slot"))
              - F.col("count")).alias("before")
    inside = F.row_number().over(Window.partitionBy("length", "slot").orderBy("stmt_id", "piece", "ids_crc32"))
    ranked = (placed.withColumn("inside", inside)
              .join(counts.select("length", "slot", before), ["length", "slot"])
              .withColumn("rank", F.col("inside") - 1 + F.col("before")).drop("slot", "inside", "before"))
    kind = pieces.schema["stmt_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            out = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                starts, first, copies = shared.value[n]
                k = np.searchsorted(starts, rank[at], "right") - 1
                out[at] = first[k] + (rank[at] - starts[k]) // copies[k]
            names = ["stmt_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out)], [*names, "sequence_id"])

    dealt = ranked.mapInArrow(run, f"stmt_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                   "sequence_id bigint")
    row = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "stmt_id", "piece", "ids_crc32") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("offset", F.sum("length").over(row) - F.col("length"))


def pack_statements(statements: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                    ranks_path: str | None = None, space: Workspace | None = None) -> DataFrame:
    """Pack whole statement texts into few sequences of at most ``capacity`` tokens.

    ``statements`` (stmt_id, text, ...) -> one row per piece (stmt_id, piece, start, length,
    ids_crc32, sequence_id, offset).  A null or empty text is one token (id 0).  Repeated rows and
    ids are packed as often as they come; rows with a null id too.  Other columns are not read; an
    empty table gives an empty result.
    """
    return pack(pieces_of(statements, tokenizer_path, capacity, ranks_path), capacity, space)
