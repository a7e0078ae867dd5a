import itertools
import random

import numpy as np
import pytest

from ledgerloom.llm import hard_negatives as H

SHAPE = "vec_id bigint, embedding array<double>, label int, anchors bigint, block bigint, key string, score double"


def brute(rows, every=100, positives=5, negatives=10, least=30, most=90):
    """Hard negatives of (vec_id, embedding, label) rows, in Python integers."""
    finite = lambda v: v is not None and abs(v) < float("inf") and abs(v * 256) < float("inf")
    use = {}
    for number, vector, label in rows:
        if number is not None and label is not None and vector and all(map(finite, vector)):
            use[number] = min(use.get(number, (label, vector)), (label, vector))
    codes = {i: [int(np.floor(v * 256.0)) for v in vector] for i, (_, vector) in use.items()}
    clip = lambda s: min(max(s, -2 ** 63), 2 ** 63 - 1)
    out = []
    for a in use:
        if a % every == 0:
            score = {b: clip(sum(x * y for x, y in zip(codes[a], codes[b]))) for b in use if b != a and len(codes[a]) == len(codes[b])}
            order = sorted(score, key=lambda b: (-score[b], b))
            for p in [b for b in order if use[b][0] == use[a][0]][:positives]:
                window = [b for b in order if use[b][0] != use[a][0] and least * score[p] <= 100 * score[b] <= most * score[p]]
                out += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(window[:negatives], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                  for r in frame.collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", 0.5) for r in rows], SHAPE)


def vectors(n=300, width=6, labels=3, seed=2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1, 0.3) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("width, bits", [(1, 3), (2, 3), (3, 2), (5, 1)])
def test_curve_visits_every_cell_by_single_steps(width, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=width)))
    keys = [k.tobytes() for k in H.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_all_products():
    rng = np.random.default_rng(3)
    boxes = [np.sort(rng.integers(-50, 50, (2, 8, 5)).astype(float), axis=0) for _ in range(2)]
    least, most = H.interval_products(*boxes[0], *boxes[1])
    for _ in range(200):
        a, b = (low + rng.random(low.shape) * (high - low) for low, high in boxes)
        inner = a @ b.T
        assert (least - 1e-9 <= inner).all() and (inner <= most + 1e-9).all()


@pytest.mark.parametrize("block", [4, 512])
def test_matches_brute_force(spark, block):
    rows = vectors()
    expected = brute(rows, every=10)
    assert expected and rows_of(H.mine_hard_negatives(frame_of(spark, rows), anchor_every=10, block=block)) == expected


def test_hostile_rows(spark):
    rows = vectors(80)
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None], 1), (203, [float("nan")] * 6, 1), (204, [float("inf")] * 6, 0),
             (205, [1e307] * 6, 1), (None, [0.1] * 6, 1), (206, [0.1] * 6, None), (40, [0.5] * 6, 0), (40, [0.5] * 6, 0),
             (300, [0.0] * 6, 0), (301, [0.0] * 6, 0), (400, [0.5, 0.5], 0), (401, [0.4, 0.5], 0), (402, [0.2, 0.2], 1)]
    rows += [(500 + k, [0.25] * 6, k % 2) for k in range(30)]  # ties
    rows += [(i, [float(x) for x in v], k) for i, v, k in [
        (700, [1e15, 1e15, 0, 0, 0, 0], 0), (701, [1e16, 1e15, 3.5, 0, 0, 0], 0), (702, [1e15, -1e14, 0, 0, 0, 0], 1),
        (703, [1e9, 0, 0, 0, 0, 0], 1)]]
    expected = brute(rows, every=10)
    got = rows_of(H.mine_hard_negatives(frame_of(spark, rows), anchor_every=10, block=8))
    assert got == expected
    assert {a for a, *_ in expected} >= {400, 500, 700}


def test_empty_tables(spark):
    assert H.mine_hard_negatives(frame_of(spark, [])).collect() == []
    assert H.mine_hard_negatives(frame_of(spark, [(0, [0.5], 1)])).collect() == []
    assert H.mine_hard_negatives(frame_of(spark, vectors(90)[1:])).collect() == []


def test_far_blocks_are_not_read(spark):
    """Two tight bundles of one label at right angles: the far one cannot hold a positive."""
    rng = random.Random(1)
    rows = [(i, [2 + rng.random() / 50, rng.random() / 50] if i % 2 else [rng.random() / 50, 2 + rng.random() / 50], 0)
            for i in range(1, 201)]
    from ledgerloom.storage import Workspace
    space = Workspace(spark, "test")
    keyed = space.cut(frame_of(spark, rows).select("vec_id", "label", "embedding").selectExpr(
        "vec_id", "cast(label as bigint) label", "embedding").mapInArrow(
            H._curve(2), "vec_id bigint, label bigint, width int, codes array<double>, key binary"), "keyed")
    blocks = H.in_blocks(keyed, 25, space, "blocks")
    groups = H.in_blocks(keyed.where("vec_id = 100"), 25, space, "anchors").selectExpr("*", "200000D as from", "1e18D as to")
    near = H.chosen(groups, blocks, True)
    held = {v for r in near.join(blocks, "block").collect() for v in r["vec_ids"]}
    assert held and all(v % 2 == 0 for v in held) and near.count() < blocks.count()
    space.close()
