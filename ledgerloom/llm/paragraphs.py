"""Near-duplicate paragraphs: MinHash bands, exact Jaccard and components of what to remove."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.batches import Rolling, chunked, dealt, local_components, mixed, packed, small_batches
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.decontaminate import gram_hashes
from ledgerloom.llm.simhash import near_duplicate_statements
from ledgerloom.storage import Workspace, broadcast_if_small

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 64
FEW = 8
TILE = 1024
TEXT_TILE = 512
PASSAGE = 50
WINDOW = 38
COLUMNS = 4096
CHUNK_BYTES = 1 << 20
SEEDS = mixed(np.arange(1, MOST_HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, within ``hashes``, find a pair at ``similarity`` with ``recall``.

    A band key is 64 bits, so rows are a power of two.
    """
    for rows in (16, 8, 4, 2, 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity ** rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding within the given number of hashes reaches the recall")


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


LETTERS = _letters()


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    body, starts, _ = packed(texts, gap=1)
    letters = LETTERS[body]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letters > 0, [False]]).astype(np.int8)))
    owner = np.searchsorted(starts, edge[::2], "right") - 1
    return Rolling(letters).slices(edge[::2], edge[1::2]), owner


def _seeded(grams: np.ndarray, k: int) -> np.ndarray:
    """Member ``k`` of the hash family: mixed again under a seed, as minima of mere multiples are correlated."""
    h = (grams ^ SEEDS[k]) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def signatures(texts: list[bytes], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, bands), each of ``rows`` minima of 16 bits, and which texts have a shingle."""
    words, owner = _words(texts)
    grams, at = gram_hashes(words, owner, SHINGLE)
    grams, owner = mixed(grams.astype(np.uint64)), owner[at]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    keys = np.zeros((len(texts), bands), np.uint64)
    if len(grams):
        have = owner[starts]
        for k in range(bands * rows):
            low = np.minimum.reduceat(_seeded(grams, k), starts)
            keys[have, k // rows] = (keys[have, k // rows] << np.uint64(64 // rows)) | (mixed(low) >> np.uint64(64 - 64 // rows))
    known = np.zeros(len(texts), bool)
    known[owner[starts]] = True
    return keys.view(np.int64), known


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _marked(lines: DataFrame, bands: int, rows: int, short: bool = False, every: bool = False) -> DataFrame:
    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("stmt_id", "line_no")}

    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            keys, known = signatures(texts, bands, rows)
            judged = known | np.fromiter((every or bool(t.strip()) for t in texts), bool, len(texts)) if short or every else known
            at = np.flatnonzero(judged)
            content = [hashlib.blake2b(normal(texts[k]), digest_size=16).digest() for k in at.tolist()]
            ends = np.concatenate([[0], np.cumsum(known[at] * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[at[known[at]]].ravel()))
            yield pa.RecordBatch.from_arrays(
                [table.column("stmt_id").combine_chunks().take(pa.array(at)),
                 table.column("line_no").combine_chunks().take(pa.array(at)), pa.array(content, pa.binary()), lists],
                ["stmt_id", "line_no", "content", "keys"])

    return lines.where("stmt_id is not null and line_no is not null").select("stmt_id", "line_no", "text").mapInArrow(
        run, f"stmt_id {kinds['stmt_id']}, line_no {kinds['line_no']}, content binary, keys array<bigint>")


def jaccard(a: bytes, b: bytes) -> float:
    """Exact Jaccard similarity of the word shingles of two normal texts."""
    def shingles(text):
        w = text.split(b" ")
        return set(zip(*[w[i:] for i in range(SHINGLE)]))
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those ``pairs`` (a, b) whose exact similarity is enough."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([k for k in range(len(a)) if jaccard(a[k], b[k]) >= similarity], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("normal").alias("x")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("normal").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def linked(texts: list[bytes], similarity: float) -> np.ndarray:
    """For each of some normal texts the first one it is connected to, by exact similarity of all pairs.

    Shared shingles of all pairs are products of the incidence matrix, taken ``COLUMNS`` shingles at a
    time; a shingle of one text only adds to no intersection and is left out.
    """
    words, owner = _words(texts)
    values, at = gram_hashes(words, owner, SHINGLE)
    pairs = np.unique(np.stack([owner[at], values]), axis=1)
    sizes = np.bincount(pairs[0], minlength=len(texts))
    _, column, holders = np.unique(pairs[1], return_inverse=True, return_counts=True)
    shared = holders[column] > 1
    line, column = pairs[0][shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(texts), len(texts)), np.float32)
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        some = (column >= first) & (column < first + COLUMNS)
        incidence = np.zeros((len(texts), COLUMNS), np.float32)
        incidence[line[some], column[some] - first] = 1
        common += incidence @ incidence.T
    union = sizes[:, None] + sizes - common
    i, j = np.nonzero(common >= similarity * union - 1e-4)
    exact = common[i, j].astype(np.float64) / np.maximum(union[i, j], 1) >= similarity
    return local_components(len(texts), i[exact], j[exact])


def _crowded_links(similarity: float):
    """A spanning forest of the links within each tile; the rows of a tile follow one another."""
    def run(batches):
        nodes, texts, key = [], [], None

        def links():
            root = linked(texts, similarity)
            names = np.array(nodes, np.int64)
            apart = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(names[root[apart]]), pa.array(names[apart])], ["a", "b"])

        for batch in batches:
            for tile, node, text in zip(*[c.to_pylist() for c in batch.columns]):
                if tile != key:
                    if len(nodes) > 1:
                        yield links()
                    nodes, texts, key = [], [], tile
                nodes.append(node)
                texts.append(text)
        if len(nodes) > 1:
            yield links()

    return run


def _within_crowded(members: DataFrame, texts: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links within buckets of many: ``members`` (band, key, size, node).

    A bucket over ``tile`` members is split into blocks, and every two blocks meet in a tile of their own.
    """
    placed = (members.join(texts, "node").withColumn("blocks", F.ceil(F.col("size") / tile).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(F.concat_ws("/", "band", "key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
                      "node", "normal"))
    return dealt(placed, "tile").sortWithinPartitions("tile").mapInArrow(_crowded_links(similarity), "a bigint, b bigint")


def _within_few(members: DataFrame) -> DataFrame:
    """All pairs of buckets of at most ``FEW`` members."""
    few = members.groupBy("band", "key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    pairs = few.select(F.posexplode("nodes").alias("i", "a"), "nodes").select("a", F.explode(F.slice(
        "nodes", F.col("i") + 2, F.size("nodes"))).alias("b"))
    return pairs.distinct()


def duplicate_lines(lines: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
                    space: Workspace | None = None, short: bool = False, tile: int | None = None,
                    alike: DataFrame | None = None) -> DataFrame:
    """Lines (paragraphs) of statement texts that repeat, exactly or nearly.

    ``lines`` (stmt_id, line_no, text, ...) -> (stmt_id, line_no, class_stmt_id, class_line_no, removed),
    one row per line of a class of two or more: the class is named by its first line, and all others
    are removed.  Two lines link if the Jaccard similarity of their sets of five-word shingles (words
    between blanks, A-Z lower-cased) is at least ``similarity``; classes are the components.  A line
    under five words has no shingle: it is not judged, or with ``short`` forms a class with lines of
    the same words, if it has any.  Null texts are empty; rows with a null id or
    number are left out; repeated rows are lines of their own; lines may be of any length.  Other columns
    are not read.  An empty table gives an empty result.

    Equal lines are folded first.  Lines that share a MinHash band meet; the bands find a pair at the
    similarity itself with ``recall``.  The pairs of a bucket of at most ``FEW`` lines are verified one by
    one; the lines of a larger one meet in tiles, where the exact similarities of all of them are one
    matrix product, and only a spanning forest of the links leaves a tile (of up to two blocks of ``tile``
    lines, ``TILE`` if not given).  No bucket is cut short.

    ``alike`` (line_no, alike: bigint; one row a line_no) are groups that another search found: the lines of one are
    of one class, whatever their similarity, and every line is judged, also one without words.
    """
    spark = lines.sparkSession
    small_batches(spark)
    space_of_its_own = space is None
    space = space or Workspace(spark, "paragraphs")
    bands, rows = tune_bands(similarity, recall)
    marked = _marked(lines, bands, rows, short, alike is not None)
    first = F.min(F.struct("stmt_id", "line_no")).alias("first")
    contents = space.cut(marked.groupBy("content").agg(first, F.count("*").alias("copies"), F.first("keys").alias("keys"))
                         .withColumn("node", F.monotonically_increasing_id()), "contents")
    buckets = contents.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = space.cut(buckets.join(shared, ["band", "key"]), "members")
    needed = members.select("node").distinct().join(contents.select("node", "first", "content"), "node")
    needed = needed.select("node", "first.stmt_id", "first.line_no", "content")
    texts = space.cut(_texts_of(lines, needed), "texts")
    few = F.col("size") <= FEW
    links = _verified(_within_few(members.where(few)), texts, similarity).union(
        _within_crowded(members.where(~few), texts, similarity, tile or TILE))
    if alike is not None:
        grouped = space.cut(contents.select("node", F.col("first.line_no").alias("line_no")).join(alike, "line_no")
                            .select("node", "alike"), "alike")
        heads = grouped.groupBy("alike").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
        links = links.union(grouped.join(heads, "alike").where("node <> head").select("head", "node"))
    links = space.cut(links, "links")
    groups = connected_components(links, space)
    named = space.cut(contents.join(groups, "node", "left").select(
        "content", "first", "copies", F.coalesce("component", "node").alias("component")), "named")
    classes = named.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("size")).where("size > 1")
    repeated = space.cut(named.join(classes, "component").select("content", "head"), "classes")
    if space_of_its_own:
        space.close(repeated)
    own = F.struct("stmt_id", "line_no")
    return marked.select("stmt_id", "line_no", "content").join(repeated, "content").select(
        "stmt_id", "line_no", F.col("head.stmt_id").alias("class_stmt_id"), F.col("head.line_no").alias("class_line_no"),
        (own != F.col("head")).alias("removed"))


def first_of_each_class(statements: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
                        space: Workspace | None = None) -> DataFrame:
    """The statements that are the first of their class of near-duplicate texts, with all their columns.

    ``statements`` (stmt_id, text, ...): classes are the components over two kinds of links together.  The groups of
    ``near_duplicate_statements`` (SimHash, all pairs of its radius; texts without words and null texts are alike) count as
    they are.  As that radius holds few pairs near the similarity, a whole text is also judged as one line of
    ``duplicate_lines``: exact similarity of texts that share a MinHash band, equal words of short ones.
    Rows with a null id stay; rows of one id fold only if their texts are equal, and are judged like rows of
    different ids else.
    """
    columns = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(statements.columns)]
    whole = statements.select(*columns, "stmt_id", "text", F.xxhash64("text").alias("line_no"))
    near = Workspace(statements.sparkSession, "near")
    close = near_duplicate_statements(whole.where("stmt_id is not null").select(F.col("line_no").alias("stmt_id"), "text"), space=near)
    alike = close.groupBy(F.col("stmt_id").alias("line_no")).agg(F.min("component_id").alias("alike"))
    found = duplicate_lines(whole.select("stmt_id", "line_no", "text"), similarity, recall, space, short=True, tile=TEXT_TILE, alike=alike)
    near.close()
    named = whole.where("stmt_id is not null").dropDuplicates(["stmt_id", "line_no"])
    kept = named.join(found.where("removed").select("stmt_id", "line_no"), ["stmt_id", "line_no"], "left_anti")
    return kept.select(*[F.col(f"carried_{k}").alias(c) for k, c in enumerate(statements.columns)]).unionByName(statements.where("stmt_id is null"))


def _sliding(reduce, values: np.ndarray, width: int) -> np.ndarray:
    """``reduce`` (np.minimum or np.maximum) over every ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values = reduce(values[:-size], values[size:])
        size *= 2
    return reduce(values[:len(values) - (width - size)], values[width - size:])


def windows(texts: list[bytes], passage: int = PASSAGE, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Windows of ``window`` words of the texts: text, first word and digest of each.

    Of the windows that fit into ``passage`` words in a row, the one whose first five words have the
    smallest hash is taken (equal ones all), so a run of ``passage`` words that two texts share has a
    window that both take, whatever is around it.
    """
    words, owner = _words(texts)
    none = np.zeros(0, np.int64)
    if len(words) < passage:
        return none, none, none
    choices = passage - window + 1
    grams = np.zeros(len(words), np.uint64)
    values, at = gram_hashes(words, owner, SHINGLE)
    grams[at] = values.astype(np.uint64) + np.uint64(1)
    lows = _sliding(np.minimum, grams, choices)[:len(words) - passage + 1]
    lows[owner[:len(lows)] != owner[passage - 1:]] = 0
    edge = np.zeros(choices - 1, np.uint64)
    lows = _sliding(np.maximum, np.concatenate([edge, lows, edge]), choices)
    at = np.flatnonzero((lows == grams[:len(lows)]) & (lows > 0))
    forward, back = Rolling.powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * forward[:len(words)], out=sums[1:])
    digest = mixed((sums[at + window] - sums[at]) * back[at])
    starts = np.searchsorted(owner, owner[at])
    return owner[at], at - starts, digest.view(np.int64)


def _windowed(lines: DataFrame, passage: int, window: int) -> DataFrame:
    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("stmt_id", "line_no")}

    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            at, first, digest = windows(texts, passage, window)
            yield pa.RecordBatch.from_arrays(
                [table.column(c).combine_chunks().take(pa.array(at)) for c in ("stmt_id", "line_no")]
                + [pa.array(first.astype(np.int32)), pa.array(digest)], ["stmt_id", "line_no", "first", "digest"])

    long = F.length("text") >= 2 * passage - 1
    return lines.where("stmt_id is not null and line_no is not null").where(long).select("stmt_id", "line_no", "text") \
        .mapInArrow(run, f"stmt_id {kinds['stmt_id']}, line_no {kinds['line_no']}, first int, digest bigint")


def repeated_passages(lines: DataFrame, passage: int = PASSAGE, window: int = WINDOW,
                      space: Workspace | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Passages inside lines that an earlier place holds word for word, whatever is around them.

    ``lines`` (stmt_id, line_no, text, ...) -> (stmt_id, line_no, first_word, n_words, class_stmt_id,
    class_line_no, class_first_word): n_words words from first_word on (from 0; A-Z lower-cased, blanks
    folded) are made of windows that earlier places (by id, line and word) hold too; the first ``window``
    words stand first at the class's place.  Every run of ``passage`` words that two places share gives
    at least ``window`` of its words at the later place; shorter runs may.  The rows of a line do not
    overlap.  A window that runs into its own first place is not one more.
    Null texts hold nothing, nor do rows with a null id or number; other columns are not read; an empty table gives
    an empty result.  Lines of ``removed`` (stmt_id, line_no) hold nothing, so that no passage is cut for one
    that goes itself.  Windows meet by 64-bit digests; they are folded by digest before they meet.
    """
    small_batches(lines.sparkSession)
    own = space is None
    space = space or Workspace(lines.sparkSession, "passages")
    found = _windowed(lines, passage, window)
    if removed is not None:
        found = found.join(broadcast_if_small(removed), ["stmt_id", "line_no"], "left_anti")
    found = space.cut(found, "windows")
    place = F.struct("stmt_id", "line_no", "first")
    repeated = space.cut(found.groupBy("digest").agg(F.min(place).alias("head"), F.count("*").alias("n"))
                         .where("n > 1").select("digest", "head"), "repeated")
    if own:
        space.close(found, repeated)
    inside = (F.col("stmt_id") == F.col("head.stmt_id")) & (F.col("line_no") == F.col("head.line_no")) \
        & (F.col("first") < F.col("head.first") + window)
    later = found.join(broadcast_if_small(repeated), "digest").where(~inside & (place != F.col("head")))
    along = Window.partitionBy("stmt_id", "line_no").orderBy("first")
    runs = later.select("stmt_id", "line_no", "first", "head", (
        F.col("first") - F.lag("first").over(along) > window).cast("int").alias("new"))
    runs = runs.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along))
    spans = runs.groupBy("stmt_id", "line_no", "run").agg(
        F.min("first").alias("first_word"), F.max("first").alias("last"),
        F.min(F.struct("first", "head"))["head"].alias("head"))
    return spans.select(
        "stmt_id", "line_no", "first_word", (F.col("last") + window - F.col("first_word")).alias("n_words"),
        F.col("head.stmt_id").alias("class_stmt_id"), F.col("head.line_no").alias("class_line_no"),
        F.col("head.first").alias("class_first_word"))


def _texts_of(lines: DataFrame, needed: DataFrame) -> DataFrame:
    """The normal text of each needed line."""
    def run(batches):
        for batch in batches:
            nodes, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {}
            for node, content, text in zip(nodes, contents, batch.column(2).cast(pa.binary()).to_pylist()):
                body = normal(text or b"")
                if hashlib.blake2b(body, digest_size=16).digest() == content:
                    out[node] = body
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())],
                                             ["node", "normal"])

    found = lines.select("stmt_id", "line_no", "text").join(needed.hint("shuffle_hash"), ["stmt_id", "line_no"])
    return found.select("node", "content", "text").mapInArrow(run, "node bigint, normal binary").dropDuplicates(["node"])
