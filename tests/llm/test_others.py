import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import hostile_rows, prose, statements

from ledgerloom.llm import paragraphs, quality, token_counts, url_filters, vectors

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- URL filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "", "allow"), (None, "/", "block"), ("net", "/es/", "block")]
URLS = ["https://a.example.com/en/1?x#y", "HTTP://WWW.Example.COM/en/2", "http://example.com", "x.com/en/", None, "", "://", "http://",
        "http://notexample.com/en/", "https://b.net/es/#f", "https://net/es/q", "https://b.net?es/", "http://é.ORG/É", "http://com/",
        "a://b://c.net/es/", "http://x.www.example.com/en/", "http://example.com/EN/"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "block", "h") for i, u in enumerate(URLS + URLS)], "page_id bigint, url string, verdict string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filters.judge_urls(pages, rules).collect()))
    assert got == [(i, *brute_url(u)) for i, u in enumerate(URLS + URLS)]


def test_many_rules_and_a_full_filter(spark, monkeypatch):
    rules = [(f"h{i}.org", f"/p{i % 7}/", "block") for i in range(500)]
    pages = [(i, f"http://x.h{i}.org/p{i % 5}/") for i in range(900)] + [(None, "http://h1.org/p1/")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted((str(i), "block" if int(u.split("h")[2].split(".")[0]) < 500 and (u.split("//")[1].split("/")[1])[1:] ==
                   str(int(u.split("h")[2].split(".")[0]) % 7) else "allow") for i, u in pages)
    for most in (1 << 15, 1):
        monkeypatch.setattr(url_filters, "MOST_BLOCKS", most)
        got = sorted((str(r["page_id"]), r["verdict"]) for r in url_filters.judge_urls(frame, listed).collect())
        assert got == want
    assert {r["verdict"] for r in url_filters.judge_urls(frame, listed.limit(0)).collect()} == {"allow"}
    assert url_filters.judge_urls(frame.limit(0), listed).count() == 0


# --- token counts

def test_tokens_match_the_library_and_the_cache_is_used(spark, folder, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = hostile_rows() + [(71, "a\u2581b <s> x </s>")]
    want = sorted(((i, len((t or "").encode()), n, n > 100) for i, t in rows for n in [len(model.encode(t or ""))]), key=str)
    cache = f"{folder}/cache"
    for _ in range(2):
        got = token_counts.count_tokens(statements(spark, rows), MODEL, cache, limit=100).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({t or "" for _, t in rows})
    word = public_tokenizers.path("word_bpe_49k.json")
    token_counts.count_tokens(statements(spark, rows[:5]), word, cache)
    assert token_counts.read_cache(spark, cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(statements(spark, []), MODEL, cache).count() == 0


# --- paragraphs

def test_tuned_bands_reach_the_recall():
    bands, rows = paragraphs.tune_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def brute_lines(rows):
    lines = [(i, k, paragraphs.normal((t or "").encode())) for i, k, t in rows if i is not None and k is not None]
    lines = [x for x in lines if len(x[2].split()) >= 5]
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if paragraphs.jaccard(lines[a][2], lines[b][2]) >= 0.8:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for a, (i, k, _) in enumerate(lines):
        own = [lines[b][:2] for b in range(len(lines)) if group[b] == group[a]]
        if len(own) > 1:
            out.append((i, k, *min(own), (i, k) != min(own)))
    return sorted(out)


@pytest.mark.parametrize("few,tile", [(8, 1024), (2, 3), (1, 1024)])
def test_lines_match_brute_force(spark, monkeypatch, few, tile):
    monkeypatch.setattr(paragraphs, "FEW", few)
    monkeypatch.setattr(paragraphs, "TILE", tile)
    monkeypatch.setattr(paragraphs, "COLUMNS", 64)
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 80)) for _ in range(25)]
    rows = []
    for i in range(60):
        for k in range(rng.randint(1, 4)):
            words = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(["one", "two", "Three"])
            rows.append((i, k, rng.choice([" ", "  ", "\t"]).join(words)))
    rows += [(100, 0, None), (101, 0, ""), (None, 0, base[0]), (102, None, base[0]), (103, 0, "one two three four")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "stmt_id bigint, line_no int, text string, content string, node int")
    got = sorted(map(tuple, paragraphs.duplicate_lines(frame).collect()))
    assert got == brute_lines(rows)
    assert paragraphs.duplicate_lines(frame.limit(0)).count() == 0


# --- vectors

def brute_vectors(rows):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.95:
                    link[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((rows[b][0] for b in seen), default=None) if i is not None else None
        out.append((i, len(link[k]), low, i is not None and i == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [2048, 7])
def test_vectors_match_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + rng.normal(size=16) * 0.2]) for k in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, [x * 3 for x in rows[0][1]]), (103, None), (104, []),
             (105, [0.0] * 16), (106, [None] + [1.0] * 15), (107, [float("nan")] * 16), (108, [float("inf")] + [0.0] * 15),
             (109, [1.0, 2.0]), (110, [1.0, 2.1]), (None, rows[0][1]), (111, [-x for x in rows[0][1]])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, content string")
    got = sorted((tuple(r) for r in vectors.near_duplicate_vectors(frame, tile=tile).collect()), key=str)
    assert got == brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert vectors.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_blocks_of_vectors_meet_without_copies_on_disk(spark, monkeypatch):
    """Every vector was shuffled once for every block of the table: bytes written grew with the square of the vectors."""
    rng = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    plans, cut = {}, vectors.Workspace.cut

    def seen(space, df, name="cut"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(space, df, name)

    monkeypatch.setattr(vectors.Workspace, "cut", seen)
    found = vectors.near_duplicate_vectors(frame, tile=10)
    assert "Exchange" not in plans["found"] and "CartesianProduct" in plans["found"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_vectors(rows)


def test_links_of_many_tiles_fold_to_one_entry_a_node(monkeypatch):
    monkeypatch.setattr(vectors, "FOLD", 4)
    found = vectors._Found()
    for node, root in (((1, 2), (1, 1)), ((2, 3), (2, 2)), ((7, 9), (7, 7)), ((1, 9), (1, 1))):
        found.add((np.array(node), np.array([1, 2]), np.array(root)))
    assert [x.tolist() for x in found.fold()] == [[1, 2, 3, 7, 9], [2, 3, 2, 1, 4], [1, 1, 1, 1, 1]]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(50, 64))
    ux, cx, sx, lx = vectors.quantised(x)
    uy, cy, sy, ly = vectors.quantised(y)
    off = np.abs(ux @ uy.T - (cx.astype(float) @ cy.T.astype(float)) * sx[:, None] * sy)
    assert (off <= lx[:, None] + (1 + lx[:, None]) * ly + 1e-12).all()


# --- quality

def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.7, 0.85])
    right = rng.random((20_000, 4)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1)
    votes[rng.random((20_000, 4)) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - accuracy).max() < 0.03 and abs(model.prior - 0.8) < 0.03


def brute_posteriors(rows, rounds):
    """Expectation-maximisation over all rows, one by one; ``rows``: votes of each text."""
    good = [0.9 if sum(r) >= 0 else 0.1 for r in rows]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(rows) + 2)
        chance = []
        for k in range(len(rows[0])):
            for c in (0, 1):
                weight = {v: 1 + sum(g if c else 1 - g for r, g in zip(rows, good) if r[k] == v) for v in (-1, 0, 1)}
                chance.append({v: w / sum(weight.values()) for v, w in weight.items()})
        after = []
        for r in rows:
            bad = (1 - prior) * math.prod(chance[2 * k][v] for k, v in enumerate(r))
            fine = prior * math.prod(chance[2 * k + 1][v] for k, v in enumerate(r))
            after.append(fine / (fine + bad))
        change = max(abs(a - b) for a, b in zip(after, good))
        if change < 1e-9:
            return after
        good = after
    return after


def test_quality_matches_row_by_row(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, ". ".join(prose(rng, rng.randint(1, 9)).capitalize() for _ in range(rng.randint(1, 9))) + ".") for i in range(70)]
    rows += [(100 + i, prose(rng, 40).upper().replace(" ", "!! ")) for i in range(12)]
    rows += [(200 + i, "same line of words\n" * 9) for i in range(5)] + [(300 + i, "a | b | c %%% $$$ " * 8) for i in range(6)]
    rows += [(400 + k, t) for k, (_, t) in enumerate(hostile_rows()) if len(t or "") < 50_000]
    taught, learn = [], quality.train_scorer
    monkeypatch.setattr(quality, "train_scorer", lambda *a: taught.append((a, learn(*a))) or taught[-1][1])
    got = {r["stmt_id"]: r for r in quality.score_quality(statements(spark, rows)).collect()}
    texts = [(t or "").encode() for _, t in rows]
    votes = [tuple(v) for v in quality.votes(quality.measures(texts)).tolist()]
    chance = brute_posteriors(votes, quality.ROUNDS)
    of_vote = dict(zip(votes, chance))
    ((passages, labels), (weight, offset)), = taught
    assert all(any(p in t for t in texts) for p in passages)
    for p, label in zip(passages, labels):
        own = tuple(quality.votes(quality.measures([p]))[0].tolist())
        assert own not in of_vote or abs(label - of_vote[own]) < 1e-6
    for (i, _), text, label in zip(rows, texts, chance):
        same = bytes(48 if 48 <= b < 58 else b for b in text)
        cells = [int(quality.mixed(np.array([int.from_bytes(same[k:k + quality.GRAM], "big")], np.uint64))[0]) % quality.FEATURES
                 for k in range(len(same) - quality.GRAM + 1)]
        z = offset + sum(float(weight[c]) for c in cells) / (len(cells) + quality.PRIOR_COUNT)
        z += sum(float(weight[c]) for c in quality.bins(quality.measures([text]))[0])
        assert abs(got[i]["weak_label"] - label) < 1e-6
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-4
        assert got[i]["keep"] == (got[i]["score"] >= 0.35)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    sentence = lambda: (prose(rng, 12).capitalize() + ".")
    good = [(i, "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(4))) for i in range(150)]
    symbols = [(200 + i, " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in prose(rng, 100).split())) for i in range(20)]
    shouts = [(300 + i, prose(rng, 100).upper().replace(" ", "!! ")) for i in range(20)]
    rows = good + symbols + shouts + [(400, None), (400, None), (None, good[0][1])]
    got = {r["stmt_id"]: r for r in quality.score_quality(statements(spark, rows)).collect()}
    assert sum(got[i]["keep"] for i, _ in good) >= 148
    assert sum(got[i]["keep"] for i, _ in symbols + shouts) <= 2
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.score_quality(statements(spark, rows)).count() == len(rows)
    assert quality.score_quality(statements(spark, [])).count() == 0


def test_agrees_with_held_back_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("doc_id", "stmt_id")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["stmt_id"]: r["keep"] for r in quality.score_quality(docs).collect()}
    good = [got[i] for i, q in labels.items() if q]
    bad = [got[i] for i, q in labels.items() if not q]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_query_cache_holds_from_run_to_run(spark):
    """The second run of the query finds every content in the cache and appends none."""
    from ledgerloom.llm import catalog
    from ledgerloom.storage import checkpoint_root
    run = lambda: sorted(map(tuple, catalog.QUERIES["op5_token_counts"](spark, "/root/testdata/sf0.001").collect()))
    first = run()
    stored = token_counts.read_cache(spark, f"{checkpoint_root(spark)}/token-cache")
    rows = sorted(map(tuple, stored.collect()))
    assert run() == first and len(first) > 100
    again = token_counts.read_cache(spark, f"{checkpoint_root(spark)}/token-cache")
    assert sorted(map(tuple, again.collect())) == rows and len({r[0] for r in rows}) == len(rows)
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert {r[0]: r[2] for r in first} == {d["doc_id"]: len(model.encode(d["text"] or "")) for d in docs}


def test_very_large_and_very_small_components_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1e308, -1e308]), (5, [5e-324, 5e-324]), (6, [-1.0, 1.0])]
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {
        1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_near_duplicate_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", 7, "a"), (2, "one two three four five six", 8, "b"), (3, "other words here", 9, "c"), (None, "x", 1, "d")]
    frame = spark.createDataFrame(rows, "stmt_id bigint, text string, line_no int, removed string")
    got = sorted(map(tuple, paragraphs.first_of_each_class(frame).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3]], key=repr)
