"""Ordered scans (running sum, previous row, last value seen) that survive a hot key.

A plain window puts a whole key into one task.  Here each key is cut into consecutive segments
(a date, a page, a block of ids): rows are scanned inside (key, segment), segments are summarized
with map-side combine, the short summary is scanned per key, and the carry is joined back on
(key, segment).  The big side is shuffled once, on (key, segment), for both the join and the
window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.storage import dealt_rows

LONG_KEY = 50_000  # rows of a key that one task scans at most


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, all rows) of ``df``, which is read for it: what ``ordered_scan`` chooses its way by."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def are_short(sizes: tuple[int, int] | None) -> bool:
    return sizes is not None and sizes[0] <= LONG_KEY


def ordered_scan(df: DataFrame, keys: list[str], segments: list[str], order: list[str], *,
                 sums: dict[str, Column] | None = None,
                 previous: dict[str, Column] | None = None,
                 last_seen: dict[str, Column] | None = None,
                 seen_before: dict[str, Column] | None = None,
                 preceding: dict[str, tuple[Column, int]] | None = None,
                 following: dict[str, tuple[Column, int]] | None = None,
                 sizes: tuple[int, int] | None = None) -> DataFrame:
    """Add scan columns over ``keys`` ordered by ``segments`` then ``order``.

    ``sums``: inclusive running sum; ``previous``: the value on the row before; ``last_seen``: the
    last non-null value up to and including the row; ``seen_before``: the same without the row;
    ``preceding`` and ``following`` (value, n): the values of up to n rows before or after the row, in order.
    For those each segment lends its first and last n rows to its neighbours.
    ``segments + order`` must be a total order
    inside a key, a null key or segment is an error (it would join with nothing), and a segment must be a contiguous stretch of it.  ``df`` is read twice (rows and
    summary), so a chain of scans is cut with ``materialize`` between its links.

    ``sizes`` are the ``key_sizes`` of ``df``, or of a frame that holds it.  If no key is longer than ``LONG_KEY``, rows are dealt
    out by ``keys`` and scanned by plain windows: ``df`` is read once, and links of a chain over one key share a shuffle.
    """
    sums, previous, last_seen, seen_before = sums or {}, previous or {}, last_seen or {}, seen_before or {}
    preceding, following = preceding or {}, following or {}
    near = {**preceding, **following}
    carried = {**last_seen, **seen_before}
    whole = not segments or are_short(sizes)
    inside = Window.partitionBy(*keys).orderBy(*segments, *order) if whole else Window.partitionBy(*keys, *segments).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    inputs = {f"in_{o}": c for o, c in {**sums, **previous, **carried}.items()}
    inputs |= {f"in_{o}": F.struct(c.alias("v")) for o, (c, _) in near.items()}
    df = (dealt_rows(df, sizes[1], *keys) if segments and whole else df).withColumns(inputs)
    if segments:
        # a chain over one key shares its shuffle only while the key stays as it is, so a segment tells of null keys there
        known = {segments[0]: F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]), F.col(segments[0]))} if whole else {}
        df = df.withColumns(known)
        df = df.withColumns({c: not_null(df, c) for c in dict.fromkeys(segments if whole else keys + segments) if df.schema[c].nullable})
    local = {o: F.sum(f"in_{o}").over(so_far) for o in sums}
    local |= {o: F.lag(f"in_{o}").over(inside) for o in previous}
    local |= {o: F.last(f"in_{o}", ignorenulls=True).over(so_far) for o in last_seen}
    local |= {o: F.last(f"in_{o}", ignorenulls=True).over(earlier) for o in seen_before}
    local |= {o: F.array_compact(F.array(*[F.lag(f"in_{o}", k).over(inside) for k in range(n, 0, -1)])) for o, (_, n) in preceding.items()}
    local |= {o: F.array_compact(F.array(*[F.lead(f"in_{o}", k).over(inside) for k in range(1, n + 1)])) for o, (_, n) in following.items()}
    plain = {o: F.transform(o, lambda x: x["v"]) for o in near}
    if whole:
        local |= {o: F.coalesce(local[o], F.lit(0)) for o in sums if segments}
        return df.withColumns(local).withColumns(plain).drop(*inputs)

    summary = df.groupBy(*keys, *segments).agg(
        *[F.sum(f"in_{o}").alias(f"end_{o}") for o in sums],
        *[F.max_by(f"in_{o}", position).alias(f"end_{o}") for o in previous],
        *[F.max_by(f"in_{o}", F.when(F.col(f"in_{o}").isNotNull(), position)).alias(f"end_{o}")
          for o in carried],
    ) if sums or previous or carried else None
    if near:
        edges = _edges(df, keys, segments, order, preceding, following)
        summary = edges if summary is None else summary.join(edges, keys + segments)
    across = Window.partitionBy(*keys).orderBy(*segments)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carries = {f"carry_{o}": F.sum(f"end_{o}").over(before) for o in sums}
    carries |= {f"carry_{o}": F.lag(f"end_{o}").over(across) for o in previous}
    carries |= {f"carry_{o}": F.last(f"end_{o}", ignorenulls=True).over(before) for o in carried}
    carries |= {f"carry_{o}": _last(F.flatten(F.collect_list(f"end_{o}").over(across.rowsBetween(-n, -1))), n)
                for o, (_, n) in preceding.items()}
    carries |= {f"carry_{o}": F.slice(F.flatten(F.collect_list(f"end_{o}").over(across.rowsBetween(1, n))), 1, n)
                for o, (_, n) in following.items()}
    carry = summary.select(*keys, *segments, *[c.alias(o) for o, c in carries.items()])

    out = df.join(carry, keys + segments).withColumns(
        local | {"row_in_segment": F.row_number().over(inside)})
    final = {o: F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"carry_{o}"), F.lit(0)) for o in sums}
    final |= {o: F.when(F.col("row_in_segment") == 1, F.col(f"carry_{o}")).otherwise(F.col(o))
              for o in previous}
    final |= {o: F.coalesce(F.col(o), F.col(f"carry_{o}")) for o in carried}
    final |= {o: _last(F.concat(F.col(f"carry_{o}"), F.col(o)), n) for o, (_, n) in preceding.items()}
    final |= {o: F.slice(F.concat(F.col(o), F.col(f"carry_{o}")), 1, n) for o, (_, n) in following.items()}
    return out.withColumns(final).withColumns(plain).drop(*inputs, *carries, "row_in_segment")


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def _edges(df: DataFrame, keys: list[str], segments: list[str], order: list[str], preceding: dict, following: dict) -> DataFrame:
    """The last rows of each segment for its successors and the first for its predecessors, a few rows a segment."""
    most = max(n for _, n in {**preceding, **following}.values())
    inside = Window.partitionBy(*keys, *segments)
    placed = df.withColumns({"from_start": F.row_number().over(inside.orderBy(*order)), "in_all": F.count(F.lit(1)).over(inside)}) \
        .withColumn("from_end", F.col("in_all") - F.col("from_start") + 1)
    position = F.struct(*order).alias("at")

    def rows(name: str, rank: str, n: int) -> Column:
        kept = F.collect_list(F.when(F.col(rank) <= n, F.struct(position, F.col(f"in_{name}").alias("v"))))
        return F.transform(F.array_sort(kept, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)),
                           lambda x: x["v"]).alias(f"end_{name}")

    return placed.where((F.col("from_start") <= most) | (F.col("from_end") <= most)).groupBy(*keys, *segments).agg(
        *[rows(o, "from_end", n) for o, (_, n) in preceding.items()],
        *[rows(o, "from_start", n) for o, (_, n) in following.items()])


def not_null(df: DataFrame, name: str) -> Column:
    refused = F.raise_error(f"ordered_scan: null in {name!r}").cast(df.schema[name].dataType)
    return F.coalesce(F.col(name), refused)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str,
                    width: int = 1000) -> DataFrame:
    """Exact median of ``value`` counted ``weight`` times, per key: (keys, median).

    ``df`` holds one row per (key, value).  Ranks come from an ordered scan over value bands, so a
    key with very many different values is spread over tasks.
    """
    ranked = ordered_scan(
        df.withColumn("value_band", F.floor(F.col(value) / width)), keys, ["value_band"], [value],
        sums={"upto": F.col(weight)})
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("all_weight"))
    hit = ranked.join(totals, keys)
    low, high = F.floor((F.col("all_weight") + 1) / 2), F.ceil((F.col("all_weight") + 1) / 2)
    start = F.col("upto") - F.col(weight)

    def at(rank: Column) -> Column:
        return F.max(F.when((start < rank) & (rank <= F.col("upto")), F.col(value).cast("double")))

    return hit.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))
