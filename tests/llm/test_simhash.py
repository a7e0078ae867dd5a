import itertools
import re

import pytest
import xxhash
from fixtures import hostile_rows, statements

from ledgerloom.llm import simhash
from ledgerloom.storage import Workspace


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def brute_components(prints):
    ids = sorted({i for i, _ in prints if i is not None})
    group = {f: {f} for _, f in prints}
    for a, b in itertools.combinations(list(group), 2):
        if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
            group[a] |= group[b]
            for f in group[b]:
                group[f] = group[a]
    low = {}
    for i, f in prints:
        if i is not None:
            key = id(group[f])
            low[key] = min(i, low.get(key, ids[-1]))
    return sorted(((i, f"{f:016x}", low.get(id(group[f]))) for i, f in prints), key=str)


def test_matches_brute_force(spark):
    rows = hostile_rows()
    got = sorted((tuple(r) for r in simhash.near_duplicate_statements(statements(spark, rows)).collect()), key=str)
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t in rows])


def test_spark_hash_is_the_same_hash(spark):
    got = spark.sql("select xxhash64('a b c d')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_pieces_of_a_long_text_join(monkeypatch):
    text = hostile_rows()[0][1] or "a b c"
    text = (text + " ") * 200
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE_BYTES", 100)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(2, 16)
    for bits in itertools.chain(*(itertools.combinations(range(16), k) for k in range(3))):
        differ = sum(1 << b for b in bits)
        assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("tile", [2, 8192])
def test_crowded_buckets_split_into_tiles(spark, tile):
    words = [0] + [1 << b for b in range(40)] + [(1 << 40) | (1 << b) for b in range(3)] + [-1, -2, -4]
    frame = spark.createDataFrame([(w,) for w in words], "fingerprint bigint")
    space = Workspace(spark, "test")
    links = space.cut(simhash.close_links(frame, 4, space, tile))
    found = {r["node"]: r["component"] for r in simhash.connected_components(links, space).collect()}
    space.close()
    assert {found[w] for w in words[:44]} == {0}
    assert {found[w] for w in words[44:]} == {-4}


def test_first_of_each_group_keeps_columns(spark):
    frame = statements(spark, [(2, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (3, "other words here"), (None, "a b c d e")])
    kept = simhash.first_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted([r["stmt_id"] for r in kept.collect()], key=str) == [1, 3, None]


def test_empty_table(spark):
    assert simhash.near_duplicate_statements(statements(spark, [])).count() == 0
