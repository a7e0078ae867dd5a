import random
import zlib

import numpy as np
from fixtures import hostile_rows, prose, statements

from ledgerloom.llm import language_id
from ledgerloom.llm import language_id as L

TONGUES = {"en": ("the", "ing", "and", "wh", "th"), "fr": ("eau", "é", "que", "oi", "ent"),
           "xx": ("ß", "ung", "sch", "ei", "der")}


def labelled(n=240):
    rng = random.Random(5)
    return [(i, prose(rng, rng.randint(10, 300), TONGUES[lang]), lang)
            for i in range(n) for lang in [rng.choice(sorted(TONGUES))]]


def test_held_out_accuracy(spark):
    rows = labelled()
    truth = {i: lang for i, _, lang in rows}
    got = language_id.identify_languages(statements(spark, rows)).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r["held_out"]]
    assert out and all(r["held_out"] == (zlib.crc32(str(r["stmt_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["stmt_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_hidden_columns_are_no_input(spark):
    rows = labelled(120)
    first = language_id.identify_languages(statements(spark, rows)).collect()
    hidden = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    again = language_id.identify_languages(statements(spark, hidden)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_hostile_rows(spark):
    rows = [(i, t, "en") for i, t in hostile_rows()]
    got = language_id.identify_languages(statements(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["stmt_id"] in (1, 2, 3, 12):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    kept = language_id.with_known_language(statements(spark, rows))
    assert kept.columns == statements(spark, []).columns
    assert {1, 2, 3, 12}.isdisjoint({r["stmt_id"] for r in kept.collect()})
    assert kept.count() == len([1 for _, t, _ in rows if any(c.isalpha() for c in t or "")])


def test_long_text_equals_its_windows(spark, monkeypatch):
    rows = labelled(60)
    net = language_id.train([t.encode() for _, t, _ in rows], [x for _, _, x in rows])
    frame = statements(spark, [(1, "the and " * 5000), (2, "eau que é " * 20)])
    monkeypatch.setattr(language_id, "WINDOWS_AT_ONCE", 1 << 20)
    whole = [tuple(r) for r in language_id.predict(frame, net).collect()]
    monkeypatch.setattr(language_id, "WINDOWS_AT_ONCE", 16)
    parts = [tuple(r) for r in language_id.predict(frame, net).collect()]
    assert [(a[0], a[1], round(a[2], 5)) for a in whole] == [(a[0], a[1], round(a[2], 5)) for a in parts]


def brute_language(net, text):
    """One text, window by window and tap by tap."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    body, table = text.encode(), L.byte_classes()
    code = lambda at: int(table[body[at]]) if at < len(body) else 0
    total = np.zeros(len(net.languages))
    for begin in range(0, len(body), L.WINDOW):
        places = range(begin, begin + L.WINDOW)
        pooled = []
        for w in L.WIDTHS:
            sums = [sum(net.taps[w][j][code(p + j)].astype(float) for j in range(w)) for p in places]
            pooled.append(np.maximum(np.max(sums, axis=0) + net.bias[w], 0))
        z = np.concatenate(pooled) @ net.dense + net.offset
        chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        total += chance * sum(2 <= code(p) < 28 or code(p) >= 32 for p in places)
    return net.languages[int(total.argmax())], total.max() / total.sum()


def test_every_text_matches_a_network_run_by_hand(spark, monkeypatch):
    nets = []
    fit = L.train
    monkeypatch.setattr(L, "train", lambda *a: nets.append((a, fit(*a))) or nets[-1][1])
    taught = [r for r in labelled(80)]
    odd = [(1000 + k, t, None) for k, (_, t) in enumerate(hostile_rows()) if len(t or "") < 3_000]
    got = L.identify_languages(statements(spark, taught + odd)).collect()
    ((passages, names), net), = nets
    learned = [(t, x) for i, t, x in taught if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(passages) == len(names) and set(names) == {x for _, x in learned}
    for passage, lang in zip(passages, names):
        assert any(x == lang and passage.decode() in t for t, x in learned)
    texts = {i: t for i, t, _ in taught + odd}
    assert len(got) == len(texts)
    for r in got:
        lang, score = brute_language(net, texts[r["stmt_id"]])
        assert abs(r["score"] - score) < 1e-4 and (r["lang_pred"] == lang or score < 0.51)


def test_nothing_to_learn_from(spark):
    got = language_id.identify_languages(statements(spark, [(1, "words", None)])).collect()
    assert [tuple(r)[2:] for r in got] == [("und", 0.0)]
    assert language_id.identify_languages(statements(spark, [])).count() == 0


def test_stage_without_labels_keeps_texts_and_bounds_languages(spark):
    rows = [(i, f"some words {i}") for i in range(20)] + [(30, None), (31, "12 %"), (32, "")]
    kept = L.with_known_language(statements(spark, rows))
    assert sorted(r["stmt_id"] for r in kept.collect()) == list(range(20)) and kept.columns == statements(spark, rows).columns
    assert L.with_known_language(statements(spark, [])).count() == 0
    dirty = statements(spark, [(i, f"text {i}", f"l{i % 7}" if i % 2 else "main") for i in range(60)])
    assert L.common_languages(dirty, 3) == ["main", "l1", "l3"]
