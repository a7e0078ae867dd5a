import zlib
from collections import defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
import test_simhash as SH
from tokenizers import Tokenizer

from ledgerloom.llm import catalog

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"], "op3": ["doc_id", "fingerprint", "component_id"],
    "op4": ["doc_id", "held_out", "lang_pred", "score"], "op5": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10": ["vec_id", "n_links", "component_id", "kept"],
    "op11": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    folder = "/root/testdata/sf0.01" if name in catalog.SQL else FOLDER
    frame = catalog.QUERIES[name](spark, folder)
    assert set(COLUMNS.get(name.split("_")[0], [])) <= set(frame.columns)
    if name in catalog.SQL:
        assert oracle.compare(frame, oracle.duck(folder), catalog.SQL[name]) == ""
    elif name[2:4] not in ("6_", "7_", "12"):
        table, key = ("embeddings", "vec_id") if name.startswith("op10") else ("documents", "doc_id")
        ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
        assert {r[0] for r in frame.select(key).collect()} == ids


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def test_fingerprints_of_the_whole_table(spark, texts):
    got = catalog.QUERIES["op3_simhash"](spark, FOLDER).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == SH.brute_components([(i, SH.brute_fingerprint(t)) for i, t in texts])


def test_token_counts_of_the_whole_table(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in texts)
    for _ in range(2):  # the second run finds all contents in the cache
        got = catalog.QUERIES["op5_token_counts"](spark, FOLDER).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert sorted(map(tuple, got)) == want


def test_pieces_of_the_whole_table(spark, texts):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in catalog.QUERIES["op8_packing"](spark, FOLDER).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, _ in texts}
    total = 0
    for i, text in texts:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted(pieces[i]), 0
        for k, (piece, start, length, crc) in enumerate(own):
            assert (piece, start) == (k, at) and (length == 2048 or k == 0 < length <= 2048)
            assert crc == zlib.crc32(ids[at:at + length].tobytes())
            at += length
        assert at == len(ids) and (len(own) == 1 or at > 2048)
        total += at
    for some in places.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= 1.1 * total / 2048 + 2
