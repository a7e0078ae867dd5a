"""Hard negatives of anchor vectors from Hilbert-ordered blocks with zone maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.batches import partitions
from ledgerloom.llm.chunks import array_of
from ledgerloom.storage import Workspace

SCALE = 256.0
BLOCK = 512
ANCHORS = 256
ZONES = 2048
READ = 64
CURVE_BITS = 2
POSITIVES = 5
NEGATIVES = 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
EXACT = float(1 << 53)
BLOCKS = ("block bigint, label bigint, size int, width int, low array<double>, high array<double>, vec_ids array<bigint>, "
          "codes array<double>")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (whole coordinates under 2**bits) along the Hilbert curve, as rows of bytes.

    Skilling's transform, over all points at once: undo the rotations of each level from the top, Gray-encode, and
    read the bits of all dimensions level by level.
    """
    x = points.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(up, q - 1, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    levels = [((x >> np.uint32(b)) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T, axis=1)


def interval_products(low: np.ndarray, high: np.ndarray, low_2: np.ndarray, high_2: np.ndarray):
    """Bounds (least, most) of the inner products of any vector in box a with any in box b, for all pairs of boxes."""
    least, most = np.zeros((len(low), len(low_2))), np.zeros((len(low), len(low_2)))
    for d in range(low.shape[1]):
        ends = [np.multiply.outer(a[:, d], b[:, d]) for a in (low, high) for b in (low_2, high_2)]
        least += np.minimum.reduce(ends)
        most += np.maximum.reduce(ends)
    return least, most


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers as 64-bit integers; one beyond that range counts as its end."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _curve(bits: int):
    """Scale rows and append their place on the curve: direction times the root of the width, cut into cells from -2 to 2."""
    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            widths = np.asarray(pc.list_value_length(vectors))
            codes, keys = [None] * batch.num_rows, [b""] * batch.num_rows
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                rows = np.floor(np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), -1) * SCALE)
                largest = np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1)
                unit = rows / largest
                unit *= np.sqrt(width) / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
                cell = np.clip(np.floor((unit + 2) * (1 << bits) / 4), 0, (1 << bits) - 1)
                for k, row, key in zip(at.tolist(), rows, hilbert_keys(cell, bits)):
                    codes[k], keys[k] = row, key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(widths, pa.int32()), pa.array(codes, pa.list_(pa.float64())),
                 pa.array(keys, pa.binary())], ["vec_id", "label", "width", "codes", "key"])

    return run


def _cut_blocks(size: int):
    """Cut sorted rows into blocks of one label and width, with the least and largest value of each dimension."""
    def run(batches):
        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def block():
            table = pa.Table.from_batches(held)
            rows = np.asarray(table.column("codes").combine_chunks().flatten()).reshape(table.num_rows, -1)
            ids = np.asarray(table.column("vec_id"))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([key[0]], pa.int64()), pa.array([len(ids)], pa.int32()),
                 pa.array([key[1]], pa.int32()), one(rows.min(axis=0), pa.float64()), one(rows.max(axis=0), pa.float64()),
                 one(ids, pa.int64()), one(rows.ravel(), pa.float64())],
                ["block", "label", "size", "width", "low", "high", "vec_ids", "codes"])

        for batch in batches:
            labels, widths = np.asarray(batch.column("label")), np.asarray(batch.column("width"))
            edges = np.flatnonzero((labels[1:] != labels[:-1]) | (widths[1:] != widths[:-1])) + 1
            for first, last in zip([0, *edges], [*edges, batch.num_rows]):
                while first < last:
                    now = (int(labels[first]), int(widths[first]))
                    if held and (now != key or sum(h.num_rows for h in held) >= size):
                        yield block()
                        number, held = number + 1, []
                    key = now
                    room = size - sum(h.num_rows for h in held)
                    held.append(batch.slice(first, min(last - first, room)))
                    first += min(last - first, room)
        if held:
            yield block()

    return run


def in_blocks(keyed: DataFrame, size: int, space: Workspace, name: str) -> DataFrame:
    """``keyed`` (vec_id, label, width, codes, key) as rows of ``BLOCKS``, in the order of label, width and curve."""
    order = ["label", "width", "key", "vec_id"]
    ordered = keyed.repartitionByRange(partitions(keyed.sparkSession), *order).sortWithinPartitions(*order)
    return space.cut(ordered.mapInArrow(_cut_blocks(size), BLOCKS), name)


def _matrix(column, count: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(count, -1)


def _choose(same: bool):
    """Which blocks an anchor group may have to read, by interval arithmetic on the zone maps alone."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, most = np.zeros(0, int), np.zeros(0, int), np.zeros((0, 0))
        if left.num_rows and right.num_rows:
            least, most = interval_products(*(_matrix(t.column(c), t.num_rows) for t in (left, right) for c in ("low", "high")))
            most += 1e-9 * np.abs(most)  # the bounds are sums of doubles
            least -= 1e-9 * np.abs(least)
            equal = np.asarray(left.column("label"))[:, None] == np.asarray(right.column("label"))[None, :]
            i, j = np.nonzero((equal == same) & (most >= np.asarray(left.column("from"))[:, None])
                              & (least <= np.asarray(left.column("to"))[:, None]))
        return pa.table({"anchors": np.asarray(left.column("block"))[i], "block": np.asarray(right.column("block"))[j], "most": most[i, j]},
                        pa.schema([("anchors", pa.int64()), ("block", pa.int64()), ("most", pa.float64())]))

    return run


def chosen(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(anchors, block, most): blocks whose bounds meet the range ``from`` to ``to`` of a group.

    Only zone maps are read.  Groups and blocks meet in tiles of about ``ZONES`` each, so no task sees all of either.
    """
    n, m = 1 + blocks.count() // ZONES, 1 + anchors.count() // ZONES
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    part = lambda count: F.pmod(F.xxhash64("block"), F.lit(count)).cast("int")
    left = anchors.select("block", "label", "width", "low", "high", "from", "to", part(m).alias("part")).withColumn("slice", every(n))
    right = blocks.select("block", "label", "width", "low", "high", part(n).alias("slice")).withColumn("part", every(m))
    key = ["part", "slice", "width"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_choose(same), "anchors bigint, block bigint, most double")


def reading(pairs: DataFrame, anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """The chosen blocks with the data of both sides.  A group's blocks are dealt into slices of about ``READ`` blocks."""
    n = 1 + blocks.count() // READ
    left = pairs.join(blocks.select("block", "vec_ids", "codes"), "block").withColumn(
        "slice", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    right = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, ["anchors", "slice"]).sortWithinPartitions("anchors")


def merged(best: list, scores: np.ndarray, ids: np.ndarray, limit: int) -> list:
    """The first ``limit`` (score, id) by score descending and id ascending, of those held and the given ones."""
    rows = best + list(zip(scores.tolist(), ids.tolist()))
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:limit]


def _best(limit: int, names: list[str]):
    """Best ``limit`` rows of each wish (anchor, positive or null, from, to) over the blocks that a task reads.

    Input: anchors, anchor_ids, anchor_codes, wish_anchor, wish_positive, wish_from, wish_to, vec_ids, codes; the lists of
    one anchor group are alike in all its rows.  A group's lists are merged from block to block.
    """
    smallest = -(1 << 63)

    def run(batches):
        group, wishes, best = None, None, None

        def flush():
            rows = [(group, a, p, v, s) for a, p, found in zip(*wishes[:2], best) for s, v in found]
            columns = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

        for batch in batches:
            for number, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                a_ids, a_codes, anchor, positive, least, most, b_ids, b_codes = map(array_of, row)
                if number != group:
                    if group is not None:
                        yield flush()
                    group, wishes, best = number, (anchor.tolist(), positive.tolist()), [[] for _ in anchor]
                    sort = np.argsort(a_ids)
                    owner = sort[np.searchsorted(a_ids[sort], anchor)]
                    floor = np.full(len(anchor), smallest)
                scores = products(a_codes.reshape(len(a_ids), -1), b_codes.reshape(len(b_ids), -1))
                for first in range(0, len(owner), 256):
                    some = slice(first, first + 256)
                    mine = scores[owner[some]]
                    hits = ((mine >= np.maximum(least, floor)[some, None]) & (mine <= most[some, None])
                            & (b_ids[None, :] != anchor[some, None]))
                    for k in np.flatnonzero(hits.any(axis=1)).tolist():
                        found = merged(best[first + k], mine[k, hits[k]], b_ids[hits[k]], limit)
                        best[first + k] = found
                        floor[first + k] = found[-1][0] if len(found) == limit else smallest
        if group is not None:
            yield flush()

    return run


FOUND = ["anchors", "anchor_id", "positive_id", "vec_id", "score"]
WISHES = ["anchors", "anchor_ids", "anchor_codes", "wish_anchor", "wish_positive", "wish_from", "wish_to", "vec_ids", "codes"]


def best_rows(pairs: DataFrame, anchors: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """``FOUND`` rows with ``rank``: the first ``limit`` of each wish over all chosen blocks."""
    found = reading(pairs, anchors, blocks).select(*WISHES).mapInArrow(
        _best(limit, FOUND), ", ".join(f"{c} bigint" for c in FOUND))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def mine_hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                        least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, block: int = BLOCK,
                        space: Workspace | None = None) -> DataFrame:
    """For each anchor and each of its positives, the highest-scoring rows of other labels in the positive's window.

    ``vectors`` (vec_id: bigint, embedding: array<float or double>, label, ...) -> (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score).  Statement records hold no vectors, so this operator is general.
    Anchors are the rows whose vec_id is divisible by ``anchor_every``.  Components become floor(256 x), and a score is
    the inner product of these whole numbers with the anchor's, exact.  Positives are the anchor's first ``positives``
    other rows of its label; negatives the first ``negatives`` rows of other labels with
    least_percent * p <= 100 * n <= most_percent * p.  Higher scores come first, ties by the smaller vec_id.

    A row with a null id, a null label, a null or empty vector, or a component that is null or not finite (once scaled)
    takes no part.  Of rows with one vec_id the one with the smallest label, then vector, takes part.  Vectors of
    different lengths never meet.  A score beyond 64 bits counts as the end of that range.  Other columns are not
    read; an empty table gives an empty result.

    Rows are sorted by label and Hilbert curve and written in Parquet blocks with the least and largest value of each
    dimension; so are the anchors, in groups.  Interval arithmetic on these zone maps alone tells which blocks a group
    must read: its most promising block gives a lower bound on its last positive, then come all blocks of
    its label that can reach that bound, and for negatives all blocks of other labels that can meet its windows.
    In many dimensions boxes are wide, so the bounds exclude little beside the label and the work grows with
    anchors times rows.
    """
    spark = vectors.sparkSession
    own = space is None
    space = space or Workspace(spark, "negatives")
    scaled = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"),
                            F.col("embedding").cast("array<double>").alias("embedding"))
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf"))))
    rows = scaled.where(F.coalesce(good, F.lit(False))).groupBy("vec_id") \
        .agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    keyed = space.cut(rows.mapInArrow(
        _curve(CURVE_BITS), "vec_id bigint, label bigint, width int, codes array<double>, key binary"), "keyed")
    blocks = in_blocks(keyed, block, space, "blocks")
    groups = in_blocks(keyed.where(F.col("vec_id") % anchor_every == 0), ANCHORS, space, "anchors")
    ends = [F.lit(-(1 << 63)).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint")]
    nothing = F.transform("vec_ids", lambda v: F.lit(-1).cast("bigint"))
    wishes = groups.select(F.col("block").alias("anchors"), F.col("vec_ids").alias("anchor_ids"), F.col("codes").alias("anchor_codes"),
                           F.col("vec_ids").alias("wish_anchor"), nothing.alias("wish_positive"),
                           F.transform("vec_ids", lambda v: ends[0]).alias("wish_from"),
                           F.transform("vec_ids", lambda v: ends[1]).alias("wish_to"))
    zones = groups.withColumn("from", F.lit(float("-inf"))).withColumn("to", F.lit(float("inf")))
    near = space.cut(chosen(zones, blocks, True), "near")
    home = near.groupBy("anchors").agg(F.max_by("block", F.struct("most", "block")).alias("block"))
    first = best_rows(home, wishes, blocks, positives)
    reached = first.where(F.col("rank") == positives).groupBy("anchors").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    bound = reached.join(groups.select(F.col("block").alias("anchors"), "size"), "anchors") \
        .select("anchors", F.when(F.col("n") == F.col("size"), F.col("score")).alias("bound"))
    wanted = near.join(bound, "anchors", "left").where("bound is null or most >= bound").select("anchors", "block")
    chosen_positives = space.cut(best_rows(wanted, wishes, blocks, positives), "positives")
    useful = chosen_positives.where("score >= 0").select(
        "anchors", "anchor_id", F.col("vec_id").alias("positive_id"), "score",
        F.expr(f"cast(ceil(cast(score as decimal(25,0)) * {least_percent} / 100) as bigint)").alias("from"),
        F.expr(f"cast(floor(cast(score as decimal(25,0)) * {most_percent} / 100) as bigint)").alias("to"))
    lists_of = useful.groupBy("anchors").agg(
        F.sort_array(F.collect_list(F.struct("anchor_id", "positive_id", "from", "to"))).alias("w"),
        F.min("from").cast("double").alias("from"), F.max("to").cast("double").alias("to"))
    windows = space.cut(groups.withColumnRenamed("block", "anchors").join(lists_of, "anchors").select(
        "anchors", F.col("anchors").alias("block"), "label", "width", "low", "high", "from", "to", F.col("vec_ids").alias("anchor_ids"),
        F.col("codes").alias("anchor_codes"), F.col("w.anchor_id").alias("wish_anchor"), F.col("w.positive_id").alias("wish_positive"),
        F.col("w.from").alias("wish_from"), F.col("w.to").alias("wish_to")), "windows")
    far = chosen(windows, blocks, False).select("anchors", "block")
    found = best_rows(far, windows.drop("block", "label", "width", "low", "high", "from", "to"), blocks, negatives)
    result = space.cut(found.join(useful.select("anchor_id", "positive_id", "score").withColumnRenamed("score", "positive_score"),
                                  ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "negatives")
    if own:
        space.close(result)
    return result
