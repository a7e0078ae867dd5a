import random

import corpus_pipeline
import numpy as np
from fixtures import prose, statements

from ledgerloom.llm import catalog, paragraphs, simhash


def test_measured_recall_at_the_similarity():
    """Pairs of random texts with Jaccard 0.8 (8 of 10 five-word shingles) that share a band."""
    rng = np.random.default_rng(6)
    pairs, bands = 30_000, paragraphs.tune_bands()
    texts = []
    for words in rng.integers(0, 1 << 40, (pairs, 14)):
        line = [f"w{w}" for w in words]
        texts += [" ".join(line[:13]).encode(), " ".join(line[1:]).encode()]
    keys, known = paragraphs.signatures(texts, *bands)
    assert known.all() and paragraphs.jaccard(*texts[:2]) == 0.8
    missed = 1 - (keys[::2] == keys[1::2]).any(axis=1).mean()
    assert missed <= 0.0012


def one_edit(rng, text):
    words = text.split(" ")
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def brute_first(rows):
    """Rows that stay: the first of each component of equal normal texts or Jaccard 0.8 and more."""
    texts = [paragraphs.normal(t.encode()) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if texts[a] == texts[b] or paragraphs.jaccard(texts[a], texts[b]) >= 0.8:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sorted({min(r for k, r in enumerate(rows) if root[k] == g) for g in set(root)})


def test_pipeline_stage_matches_brute_jaccard(spark):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (60, 80, 150, 300, 300, 40)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, one_edit(rng, base[k % 6])) for k in range(24)]
    rows += [(50 + k, one_edit(rng, one_edit(rng, base[k % 6]))) for k in range(24)]
    rows += [(90, "two words"), (91, "two  Words"), (92, "other"), (93, base[0].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute_first(rows)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_pairs_that_simhash_finds_need_no_band(spark):
    """The stage had no SimHash step: with bands that find next to nothing, only equal texts went."""
    rng = random.Random(8)
    rows = []
    for k in range(12):
        text = prose(rng, 500)
        rows += [(2 * k, text), (2 * k + 1, one_edit(rng, text))]
    assert paragraphs.tune_bands(recall=0.01) == (1, 16)
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    close = {2 * k + 1 for k in range(12) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 4}
    keys, _ = paragraphs.signatures([t.encode() for _, t in rows], 1, 16)
    banded = {2 * k + 1 for k in range(12) if keys[2 * k, 0] == keys[2 * k + 1, 0]}
    assert close - banded
    kept = paragraphs.first_of_each_class(statements(spark, rows), recall=0.01)
    assert {i for i, _ in rows} - {r["stmt_id"] for r in kept.collect()} == close | banded


def test_groups_that_simhash_finds_go_whatever_their_similarity(spark):
    """The stage took SimHash groups as candidates only, so a text that SimHash alone holds close stayed."""
    rng = random.Random(11)
    chorus = prose(rng, 9)
    rows = [(k, " ".join([chorus] * 60 + [prose(rng, 12)])) for k in (4, 2, 9)] + [(1, prose(rng, 90)), (6, None), (7, " \n"), (8, "")]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows[:3]]
    texts = [paragraphs.normal(t.encode()) for _, t in rows[:3]]
    assert all((prints[0] ^ p).bit_count() <= 4 for p in prints[1:])
    assert all(paragraphs.jaccard(a, b) < paragraphs.SIMILARITY for k, a in enumerate(texts) for b in texts[:k])
    kept = paragraphs.first_of_each_class(statements(spark, rows)).collect()
    assert sorted(r["stmt_id"] for r in kept) == [1, 2, 6]


def shared_runs(a, b, least):
    """(start in a, start in b) of all runs of ``least`` equal words."""
    at = {}
    for j in range(len(b) - least + 1):
        at.setdefault(tuple(b[j:j + least]), []).append(j)
    return [(i, j) for i in range(len(a) - least + 1) for j in at.get(tuple(a[i:i + least]), [])]


def test_passages_in_different_lines_are_found(spark):
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (50, 51, 70, 120)]
    rows = [(10 * k + i, i % 2, f"{prose(rng, rng.randint(0, 90))} {p} {prose(rng, rng.randint(0, 90))}".strip())
            for k, p in enumerate(shared) for i in range(5)]
    rows += [(100, 0, shared[2].upper().replace(" ", "  ")), (101, 0, prose(rng, 300)), (102, 0, None), (103, 0, ""),
             (104, 0, prose(rng, 49)), (105, 0, f"{shared[3]} x {shared[3]}"), (None, 0, shared[0]), (107, 0, "one two three " * 200), (106, None, shared[0])]
    frame = spark.createDataFrame(rows, "stmt_id bigint, line_no int, text string")
    found = paragraphs.repeated_passages(frame).collect()
    words = {(i, k): paragraphs.normal((t or "").encode()).split() for i, k, t in rows if i is not None and k is not None}
    covered = {}
    for r in found:
        own, other = words[r["stmt_id"], r["line_no"]], words[r["class_stmt_id"], r["class_line_no"]]
        first, n, there = r["first_word"], r["n_words"], r["class_first_word"]
        assert n >= paragraphs.WINDOW and len(own[first:first + n]) == n
        assert own[first:first + paragraphs.WINDOW] == other[there:there + paragraphs.WINDOW]
        assert (r["class_stmt_id"], r["class_line_no"], there) < (r["stmt_id"], r["line_no"], first)
        covered.setdefault((r["stmt_id"], r["line_no"]), []).append((first, n))
    names = sorted(words)
    for a in names:
        for b in names:
            if b < a:
                for i, _ in shared_runs(words[a], words[b], paragraphs.PASSAGE):
                    assert any(min(i + 50, f + n) - max(i, f) >= paragraphs.WINDOW for f, n in covered.get(a, [])), (a, b, i)
    periodic = [r for r in found if r["stmt_id"] == 107]
    assert len(periodic) == 1 and periodic[0]["first_word"] <= 41 and periodic[0]["n_words"] >= 555
    assert len(found) >= 17 and not {101, 104} & {r["stmt_id"] for r in found}
    assert paragraphs.repeated_passages(frame.limit(0)).count() == 0


def test_query_gives_passages_of_foreign_documents(spark, folder):
    rng = random.Random(10)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, 80)} {passage} {prose(rng, 80)}", f"{passage} {prose(rng, 120)}", prose(rng, 200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    rows = catalog.QUERIES["op7_substring_dedup"](spark, folder).collect()
    assert [(r["doc_id"], r["paragraph"], r["class_doc_id"], r["removed"]) for r in rows] == [(1, 0, 0, True)]
    assert rows[0]["class_first_word"] == 80 + rows[0]["first_word"] and rows[0]["first_word"] + rows[0]["n_words"] <= 60


def test_query_gives_equal_short_lines(spark, folder):
    texts = ["All rights reserved.\nfour words are here", "all  Rights reserved.\n\n ", "All rights\nfour words are there\n\n", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    rows = catalog.QUERIES["op7_substring_dedup"](spark, folder).collect()
    got = sorted((r["doc_id"], r["paragraph"], r["class_doc_id"], r["class_paragraph"], r["removed"]) for r in rows)
    assert got == [(0, 0, 0, 0, False), (1, 0, 0, 0, True)]


def test_pipeline_stage_keeps_unrelated_rows_of_one_id(spark):
    rng = random.Random(5)
    one, other = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (1, other, "en", "s", 1), (1, one, "en", "s", 1), (2, other, "en", "s", 1)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, other)])
