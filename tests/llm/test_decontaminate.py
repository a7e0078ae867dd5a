import random

import numpy as np
from fixtures import hostile_rows, prose, statements

from ledgerloom.llm import decontaminate as D

ITEMS = "item_id bigint, text string, score double"


def smith_waterman(a, b):
    best = 0
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for k, x in enumerate(a):
            new.append(max(0, row[k] + (2 if x == y else -1), row[k + 1] - 1, new[k] - 1))
        row = new
        best = max(best, *row)
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(2)
    pairs = [([rng.randint(0, 5) for _ in range(rng.randint(1, 30))], [rng.randint(0, 5) for _ in range(rng.randint(1, 20))])
             for _ in range(60)]
    best, _ = D.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert best.tolist() == [smith_waterman(a, b) for a, b in pairs]


def world():
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(20, 40))) for k in range(12)] + [(90, "too short"), (91, None), (None, prose(rng, 20)), (92, " ?! "),
        (93, "one two three four five six seven"), (94, "quux"), (95, "three four five six seven")]
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(200)]
    planted = set()
    for i in range(0, 120, 3):
        k = rng.randrange(12)
        words = items[k][1].split(" ")
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = "edited"
        if i % 2:
            del words[rng.randrange(len(words))]
        rows[i] = (i, prose(rng, 30) + " " + " ".join(words).upper() + ", " + prose(rng, 30))
        planted.add((i, k))
    for i, k in ((1, 90), (2, 90), (4, 93), (5, 93), (7, 94), (8, 95)):
        rows[i] = (i, f"{prose(rng, 20)} {'-' if i % 2 else ''}{dict(items)[k].title()}! {prose(rng, 20)} {dict(items)[k]}")
        planted.add((i, k))
    rows[10] = (10, "one two three four five six eight")
    return items, rows, planted


def test_matches_alignment_of_all_pairs(spark):
    items, rows, planted = world()
    got = {(r["stmt_id"], r["item_id"]): r["score"] for r in
           D.contaminated_statements(statements(spark, rows), spark.createDataFrame([(*i, 0.1) for i in items], ITEMS)).collect()}
    words = lambda t: D.word_hashes([(t or "").encode()])[0].tolist()
    want = {}
    for i, text in rows:
        for k, item in items:
            w = words(item)
            if k is not None and 0 < len(w) < D.LEAST_WORDS:
                t = words(text)
                if any(t[p:p + len(w)] == w for p in range(len(t))):
                    want[i, k] = 1.0
            elif k is not None and w:
                score = smith_waterman(words(text), w) / (2 * len(w))
                if score >= D.THRESHOLD:
                    want[i, k] = score
    assert planted <= set(want)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_give_the_same(spark, monkeypatch):
    items, rows, _ = world()
    frame, tests = statements(spark, rows), spark.createDataFrame([(*i, 0.1) for i in items], ITEMS)
    whole = sorted(map(tuple, D.contaminated_statements(frame, tests).collect()))
    monkeypatch.setattr(D, "GRAMS_PER_BLOCK", 100)
    assert sorted(map(tuple, D.contaminated_statements(frame, tests).collect())) == whole


def test_frequent_items_are_found_and_rows_stay_whole(spark):
    items, _, _ = world()
    rows = [(i, items[0][1]) for i in range(60)] + hostile_rows()
    frame, tests = statements(spark, rows), spark.createDataFrame([(*i, 0.1) for i in items], ITEMS)
    hit = {r["stmt_id"] for r in D.contaminated_statements(frame, tests).where("item_id = 0").collect()}
    assert set(range(60)) - {4, 5, 9, 10, 11, 12, 13, 14, *range(20, 60)} <= hit
    left = D.without_contaminated(frame, tests)
    assert left.columns == frame.columns
    assert left.where("stmt_id is null").count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    frame = statements(spark, [(1, "words")])
    assert D.contaminated_statements(frame, none).count() == 0
    assert D.without_contaminated(frame, none).count() == 1
    assert D.contaminated_statements(statements(spark, []), spark.createDataFrame([(1, "a b c d e f g h i", 0.0)], ITEMS)).count() == 0
