import hashlib
import random

import numpy as np
import pytest
from fixtures import hostile_rows, prose, statements

from ledgerloom.llm import factors


def brute(rows):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                s = b[k:k + 50]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
    return sorted(out, key=str)


def check(spark, rows):
    got = factors.remove_repeated_passages(statements(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def brute_factors(suffixes, doc, least):
    def shared(a, b):
        return next((k for k in range(factors.SPAN) if a[k] != b[k]), factors.SPAN)
    best = [max([shared(a, b) for b, e in zip(suffixes, doc) if e < d], default=0) for a, d in zip(suffixes, doc)]
    return [x if x >= least else 0 for x in best]


@pytest.mark.parametrize("letters,seed", [(1, 0), (2, 1), (2, 2), (3, 3), (256, 4)])
def test_longest_previous_factors(letters, seed):
    rng = np.random.default_rng(seed)
    body = rng.integers(0, letters, 460).astype(np.uint8)
    body[200:330] = body[20:150]
    body[330:400] = body[40:110]
    starts = rng.permutation(len(body) - factors.SPAN + 1)
    doc = rng.integers(0, 9, len(starts))
    order, common = factors.suffix_order(body, starts, doc)
    suffixes = [bytes(body[k:k + factors.SPAN]) for k in starts[order].tolist()]
    assert suffixes == sorted(suffixes)
    for least in (1, 7, factors.SPAN):
        got = factors.longest_previous_factors(doc[order], common, least).tolist()
        assert got == brute_factors(suffixes, doc[order].tolist(), least)


@pytest.mark.parametrize("size", [1, 3, 50, 1 << 18])
def test_slices_of_the_suffix_order(monkeypatch, size):
    monkeypatch.setattr(factors, "SLICE", size)
    body = np.frombuffer((b"the same words come again and again, " * 9 + b"z" * 90 + b"\0" * 70), np.uint8)
    starts = np.arange(len(body) - factors.SPAN + 1)
    doc = (starts * 7) % 11
    spans = [bytes(body[k:k + factors.SPAN]) for k in starts.tolist()]
    low = {}
    for s, d in zip(spans, doc.tolist()):
        low[s] = min(d, low.get(s, d))
    assert factors.previous_factors(body, starts, doc).tolist() == [low[s] < d for s, d in zip(spans, doc.tolist())]
    assert factors.previous_factors(body, starts[:0], doc[:0]).tolist() == []


def test_hostile_rows(spark):
    check(spark, [r for r in hostile_rows() if len(r[1] or "") < 50_000] + [(80, "z" * 49), (81, "z" * 50), (82, "z" * 51)])


@pytest.mark.parametrize("crowd,chunk", [(16, 2 << 20), (1, 2000), (2, 500)])
def test_passages_in_changing_surroundings(spark, monkeypatch, crowd, chunk):
    monkeypatch.setattr(factors, "CROWD", crowd)
    monkeypatch.setattr(factors, "CHUNK_BYTES", chunk)
    rng = random.Random(crowd)
    shared = [prose(rng, n) for n in (9, 12, 30, 60)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 12)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts.insert(rng.randint(0, 3), s[a:len(s) - rng.randint(0, len(s) // 3)])
        rows.append((rng.randint(0, 90), rng.choice([" ", "", "é"]).join(parts)))
    check(spark, rows)


def test_columns_and_empty_tables(spark):
    text = "one passage of more than fifty bytes that two statements hold "
    frame = statements(spark, [(1, text), (2, text), (3, text + "and more of it"), (None, text), (4, None)])
    left = factors.without_repeated_passages(frame)
    assert left.columns == frame.columns
    rows = {r["stmt_id"]: r for r in left.collect()}
    assert set(rows) == {1, 3, None, 4}
    assert rows[3]["text"] == "and more of it" and rows[1]["text"] == text and rows[4]["text"] is None
    assert rows[3]["n"] == 7
    assert factors.remove_repeated_passages(statements(spark, [])).count() == 0
