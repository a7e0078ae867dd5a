"""Scans, medians and matching against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import suggest as G
from ledgerloom.operators.scan import ordered_scan, weighted_median


def test_ordered_scan_equals_a_walk(spark):
    rng = random.Random(7)
    rows = [(k, i // 4, i, rng.randint(-9, 9), rng.choice([None, i])) for k in "ab" for i in range(23)]
    df = spark.createDataFrame(rows, "k string, seg int, i int, v int, mark int")
    got = ordered_scan(df, ["k"], ["seg"], ["i"], sums={"total": F.col("v")}, previous={"prior": F.col("v")},
                       last_seen={"seen": F.col("mark")}, seen_before={"before": F.col("mark")}).orderBy("k", "i").collect()
    plain = ordered_scan(df, ["k", "seg"], [], ["i"], sums={"total": F.col("v")}).count()
    assert plain == len(rows)
    state = {}
    for r in got:
        total, prior, seen = state.get(r["k"], (0, None, None))
        assert (r["prior"], r["before"]) == (prior, seen)
        total, seen = total + r["v"], r["mark"] if r["mark"] is not None else seen
        assert (r["total"], r["seen"]) == (total, seen)
        state[r["k"]] = (total, r["v"], seen)


def test_weighted_median(spark):
    rng = random.Random(3)
    data = {k: [rng.randint(0, 5000) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 7), ("d", 40))}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v int")
    counted = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: r["median"] for r in weighted_median(counted, ["k"], "v", "n").collect()}
    assert got == {k: float(statistics.median(v)) for k, v in data.items()}


def brute_common(strings):
    shortest = min(strings, key=lambda s: (len(s), s))
    for size in range(len(shortest), 3, -1):
        for start in range(len(shortest) - size + 1):
            if all(shortest[start:start + size] in s for s in strings):
                return shortest[start:start + size]
    return ""


def test_longest_common_substring(spark):
    rng = random.Random(5)
    groups = {"core": ["AAPLUM SHOPXX", "ZPLUM SHOPY", "PLUM SHOP"], "none": ["ABCDEF", "UVWXYZ"], "one": ["ONLY"], "short": ["ABC", "ABCD"]}
    for g in range(20):
        core = "".join(rng.choice("AB") for _ in range(rng.randint(0, 8)))
        groups[f"r{g}"] = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 6))) + core
                           + "".join(rng.choice("ABC") for _ in range(rng.randint(0, 6))) for _ in range(4)]
    df = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g string, t string")
    got = {r["g"]: r["common"] for r in G.longest_common_substring(df, "g", "t").collect()}
    assert got == {g: brute_common(ts) for g, ts in groups.items()}


def test_candidate_matches_is_exact(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ABC ") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    candidates = sorted({"".join(rng.choice("ABC") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    got = G.candidate_matches(spark.createDataFrame([(c, c) for c in candidates], "target string, candidate string"),
                              spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    assert sorted((r["candidate"], r["i"]) for r in got.collect()) == sorted(
        (c, i) for c in candidates for i, t in enumerate(texts) if c in t)


def test_suggest_rules(spark):
    rows = [(1, "Plum Homes", "uncategorized", "PLUM HOMES DES:X ID:1 CO ID:77"), (2, "Plum Homes", "uncategorized", "PLUM HOMES DES:X ID:2 CO ID:77"),
            (3, "Pear", "uncategorized", "XX-77 PEARL RIVER 1"), (4, "Pear", "uncategorized", "YY-77 PEARL RIVER 2"),
            (5, "Pearl Diner", "Dining & Delivery", "PEAR DINER"),
            (6, "Fig", "uncategorized", "SOME FIG"), (7, "Figaro", "Shopping", "SOME FIG SHOP")]
    df = spark.createDataFrame([(i, m, c, t, "", "credit", "purchase", -10.0, "2024-01-01") for i, m, c, t in rows],
                               "txn_id int, merchant string, category string, description string, descriptor string, account string, kind string, signed double, date string")
    got = {r["merchant"]: r for r in G.suggest_rules(df).collect()}
    assert (got["Plum Homes"]["pattern_text"], got["Plum Homes"]["originator"], got["Plum Homes"]["matches"]) == ("PLUM HOMES", "77", 2)
    assert got["Pear"]["ok"] and got["Pear"]["pattern_text"] == "-77 PEARL RIVER"
    assert not got["Fig"]["ok"] and got["Fig"]["pattern_text"] is None
    assert G.rule_pattern("A.B*(C)") == r"A\.B\*\(C\)"


def test_a_null_key_is_refused(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 2)], "k string, s int, o int")
    with pytest.raises(Exception, match="null in 'k'"):
        ordered_scan(df, ["k"], ["s"], ["o"], sums={"n": F.lit(1)}).collect()


def test_numbered_candidates_meet_few_texts(spark):
    def tested(n):
        texts = spark.range(n).selectExpr("'MERCHANT SHOP ' || lpad(cast(id as string), 6, '0') || ' TX' as text")
        candidates = texts.selectExpr("text as target", "text as candidate")
        own = G.candidate_matches(candidates, texts)
        assert own.count() == n
        size = G.gram_size(F.col("candidate"))
        grams = candidates.select("candidate", F.explode(F.transform(F.sequence(F.lit(1), F.length("candidate") - size + 1),
                                                                      lambda i: F.substr("candidate", i, size))).alias("gram"))
        holders = grams.groupBy("gram").agg(F.countDistinct("candidate").alias("n"))
        return grams.join(holders, "gram").groupBy("candidate").agg(F.min("n").alias("n")).agg(F.sum("n")).first()[0]

    assert tested(1600) <= 4.5 * tested(400)
