import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import catalog
from ledgerloom.llm import phrases as P

SHAPE = "description string, account string, id bigint, chunk bigint, words string, ids array<bigint>, per string"


def brute(rows, least, top=2000, longest=4):
    """Phrases of (description, account) rows by counting every n-gram of every piece."""
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    count, words = defaultdict(Counter), Counter()
    for text, account in rows:
        account = "und" if account is None else account
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            tokens = [w for w in re.split("[ \t]+", piece) if w]
            words[account] += len(tokens)
            for m in range(1, longest + 1):
                count[account].update(tuple(tokens[i:i + m]) for i in range(len(tokens) - m + 1))
    out = []
    for account, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i:i + m]] = max(covered[p[i:i + m]], a)
        rows_of = []
        for p, a in candidates.items():
            if 100 * covered[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_of)[:top], 1):  # noqa: E741
            out.append((account, rank, phrase.decode(), -a, l, r, words[account], -score))
    return sorted(out)


def rows_of(frame, per="account"):
    return sorted((r[per], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect())


def descriptions(seed=4, n=400):
    rng = random.Random(seed)
    names = ["Card", "PURCHASE", "blue", "lantern", "cafe", "pos", "Ätna", "x", "wire", "fee"]
    body = lambda k: "".join(rng.choice(names) + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "; ", "\x0b", "\r"])
                             for _ in range(k))
    rows = [(body(rng.randint(0, 30)), rng.choice(["checking", "credit", None])) for _ in range(n)]
    rows += [("recurring transfer to savings", "checking")] * 40 + [("a a a a a a", "credit")] * 8
    rows += [(None, "checking"), ("", None), (" \t\n", "credit"), (".,;", "other"), (body(30_000), "checking"),
             ("nul\0byte nul\0byte", "credit"), ("    é", None)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(d, a, 1, 2, "w", [3], "p") for d, a in rows], SHAPE)


@pytest.mark.parametrize("least, top", [(30, 2000), (2, 7), (1, 10_000)])
def test_matches_brute_force(spark, least, top):
    rows = descriptions()
    assert rows_of(P.mine_phrases(frame_of(spark, rows), least=least, top=top)) == brute(rows, least, top)


def test_chunks_add_up(spark, monkeypatch):
    rows = descriptions(9)
    monkeypatch.setattr(P, "text_chunks", lambda *a, **k: chunks(*a, **k, limit=2000))
    from ledgerloom.llm.chunks import text_chunks as chunks
    assert rows_of(P.mine_phrases(frame_of(spark, rows), least=5)) == brute(rows, 5)


def test_longer_phrases_and_other_columns(spark):
    rows = [("one two three four five six", "a")] * 5 + [("two three four", "b")] * 3
    frame = frame_of(spark, rows).withColumnRenamed("account", "region").withColumnRenamed("description", "memo")
    got = rows_of(P.mine_phrases(frame, "memo", "region", least=3, longest=6), "region")
    assert got == brute(rows, 3, longest=6)
    assert got[0][2] == "one two three four five six"


def test_empty_table(spark):
    assert P.mine_phrases(frame_of(spark, [])).collect() == []
    assert P.mine_phrases(frame_of(spark, [(None, None), ("one", "a")]), least=1).collect() == []


def test_products_beyond_64_bits(spark):
    big = 2 ** 62
    row = spark.createDataFrame([(big, [big], [big + 1])], "a bigint, heads array<bigint>, tails array<bigint>")
    assert row.select(P.weakest_cut(2)).first()[0]["score"] == 2_000_000 * big // (2 * big + 1)


def test_query_is_brute_force_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()]
    expected = brute(rows, 30)
    assert expected and rows_of(catalog.QUERIES["op12_phrase_mining"](spark, folder), "lang") == expected


def test_lists_survive_their_coding():
    import numpy as np

    from ledgerloom.llm.chunks import from_gaps, from_planes, gaps, planes
    for values in ([], [0], [255, 256, 0], [2 ** 40, 3], [2 ** 62]):
        assert from_planes(planes(np.array(values, np.int64))).tolist() == values
        assert from_gaps(gaps(np.array(sorted(values), np.int64))).tolist() == sorted(values)
    assert len(planes(np.arange(200))) == 201
