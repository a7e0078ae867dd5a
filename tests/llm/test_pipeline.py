import random

import corpus_pipeline
import pytest
import test_decontaminate as DC
import test_factors as FA
import test_paragraphs as PA
from fixtures import hostile_rows, prose

from ledgerloom.llm import decontaminate as D

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, shared passages and test items, and the stages' results over them."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randint(20, 40))) for k in range(8)]
    rows = [(i, t) for i, t in hostile_rows() if i is not None and len(t or "") < 50_000]
    rows = list({i: (i, t) for i, t in rows}.values())
    passage = prose(rng, 70)
    rows += [(200 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}") for i in range(10)]
    rows += [(300 + i, f"{prose(rng, 40)} {items[i][1]} {prose(rng, 40)}") for i in range(6)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows], SHAPE)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, results = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        results.append(docs)
    return folder, rows, items, results


def rows_of(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.collect())


def test_each_stage_matches_brute_force(spark, corpus):
    _, rows, items, results = corpus
    assert all(r.columns == corpus_pipeline.COLUMNS for r in results[:-1])
    kept = sorted((i, t) for i, t in rows if any(c.isalpha() for c in t or ""))
    assert rows_of(results[0]) == kept
    kept = PA.brute_first(kept)
    assert rows_of(results[1]) == kept
    cut = FA.brute(kept)
    kept = sorted((i, text) for i, _, gone, _, _, text in cut if not gone or text.strip())
    assert rows_of(results[2]) == kept
    assert all(r["n_chars"] == len(r["text"]) for r in results[2].collect())
    words = lambda t: D.word_hashes([t.encode()])[0].tolist()
    leaks = {i for i, t in kept for _, item in items
             if DC.smith_waterman(words(t), words(item)) >= D.THRESHOLD * 2 * len(words(item))}
    assert {300 + k for k in range(6)} <= leaks
    kept = [r for r in kept if r[0] not in leaks]
    assert rows_of(results[3]) == kept
    assert {r["doc_id"] for r in results[4].collect()} == {i for i, _ in kept}


def test_run_gives_the_last_stage(spark, corpus):
    folder, _, _, results = corpus
    place = lambda frame: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in frame.collect())
    assert place(corpus_pipeline.run(spark, folder)) == place(results[-1])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(result.columns)
