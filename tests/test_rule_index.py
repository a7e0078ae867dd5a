"""Rules as a table against rules as expressions, and the memory of outcomes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import classify as K
from ledgerloom.operators import memory as M
from ledgerloom.operators.rule_index import anchored, required_literals
from ledgerloom.sources.rules import Rules, load_rules

CASES = [("BLUE LANTERN", ["blue lantern"]), (r"SHELL\b|CHEVRON", ["chevron", "shell"]), (r"UBER\s*EATS", ["uber"]), (r"\bAB\b", None),
         (r"(FOO|BAR) ?PAYMENT", ["payment"]), (r"colou?r SHOP", ["r shop"]), (r"AMZN\*?MKTP", ["amzn"]), (r"[A-Z]{3} \d+", None),
         (r"^RENT$", ["rent"]), (r"A.B.C", None), (r"LUX{2,}E", ["lux"]), (r"LUX{0,2}ELLES", ["elles"]), (r"(?i)Rosé bar", ["rosé bar"]),
         (r"(?=X)XYZ", None), (r"\x41BCDEF", None), (r"\QABC\E", None), ("", None), (None, None), (r"ab|[|]cde", None), (r"[]x]abcd", None), (r"[^]|]abcd", None), (r"[a[b]|c]defg", None), (r"abcd[", None), (r"[|]abc", ["abc"])]


@pytest.mark.parametrize("pattern, literals", CASES)
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_every_match_holds_a_required_literal():
    rng = random.Random(3)
    atoms = ["abc", "shop", r"\d", "x?", "y+", r"\.", "[ab]", "(?:abc|shop)", "(q)", " ", r"\s*", "z{0,2}", "w{2}", "|", "^", "$", "o*?"]
    tried = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        literals = required_literals(pattern)
        if literals is None:
            continue
        for _ in range(10):
            text = "".join(rng.choice(["abc", "shop", "1", "x", "y", ".", "a", "q", " ", "z", "ww", "O"]) for _ in range(rng.randint(0, 8)))
            if re.search(pattern, text, re.I):
                tried += 1
                assert any(x in text.lower() for x in literals), (pattern, text)
    assert tried > 100


def test_table_equals_expressions(spark):
    rng = random.Random(5)
    words = ["BLUE", "LANTERN", "CAFE", "ring", "BOLT", "#12", "ab", "É", "x.y", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(300)] + [None, "", "AB"]
    rules = [(r"blue +lantern", "m1", "c"), (r"\bab\b", "m2", "c"), (r"x\.y", "m3", "c"), (r"cafe|ring", "m4", None), (r"É ", "m5", "c"),
             (r"never in any text", "m6", "c"), (r"#\d+ bolt$", "m7", "c"), (r"bolt", "m8", "c"), (r"^$", "m9", "c"), (r"[bc]\w+", "m10", "c")]
    rng.shuffle(rules)
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "subject string, ord int")
    table = spark.createDataFrame([(10 * i, *r) for i, r in enumerate(rules)], "ord int, pattern string, merchant string, category string")
    for flags in ("(?i)", ""):
        got = K.with_rule_table(df, "subject", table, "hit", flags).select("ord", "hit").collect()
        want = K.with_rule_match(df, "subject", rules, "hit", flags).select("ord", "hit").collect()
        assert sorted(got) == sorted(want) and any(r["hit"] for r in got)
    none = K.with_rule_table(df, "subject", table.limit(0), "hit")
    assert none.where("hit is not null").count() == 0 and none.count() == len(texts)
    again = table.union(table.withColumns({"pattern": F.concat(F.lit("\ufffd"), "pattern")}))
    assert sorted(K.with_rule_table(df, "subject", again, "hit").select("ord", "hit").collect()) == sorted(
        K.with_rule_match(df, "subject", rules, "hit", "(?i)").select("ord", "hit").collect())


def ledger(spark, texts):
    return spark.createDataFrame([(i, t, "", "checking", "withdrawal" if i % 3 else "deposit") for i, t in enumerate(texts)],
                                 "txn_id int, description string, descriptor string, account string, kind string")


TEXTS = ["PLUM CAFE #1", "PLUM CAFE #2", "PEAR SHOP", "OAK FUEL 12", "ZELLE PAYMENT TO ALEX", "ACH DES:PAY CO ID:77 PPD", "UNKNOWN ONE", "01/02 PLUM CAFE #3"]


def outcome(frame):
    return sorted((r["txn_id"], r["merchant"], r["category"]) for r in frame.collect())


def test_many_rules_stay_a_table(spark, folder):
    path = f"{folder}/rules.json"
    listed = [{"pattern": f"PLUM CAFE #{i}$", "merchant": f"Plum {i}", "category": "Dining"} for i in range(30)]
    import json
    json.dump({"merchants": listed}, open(path, "w"))
    few, many = load_rules(spark, path), load_rules(spark, path, most=10)
    assert few.table is None and len(few.merchants) == 30 and many.table is not None and not many.merchants
    frame = ledger(spark, TEXTS)
    assert outcome(K.with_classification(frame, many)) == outcome(K.with_classification(frame, few))


def test_memory_classifies_only_what_a_change_can_touch(spark, folder):
    base = [("PLUM CAFE", "Plum", "Dining"), ("PEAR", "Pear", "Shopping")]
    steps = [
        (Rules(merchants=base), TEXTS, (len(TEXTS), 0)),
        (Rules(merchants=base), TEXTS, (0, 0)),
        (Rules(merchants=base), [*TEXTS, "NEW PLUM CAFE"], (1, 0)),
        (Rules(merchants=[("OAK FUEL", "Oak", "Fuel"), *base]), TEXTS, (0, 1)),
        (Rules(merchants=[("OAK FUEL", "Oak", "Fuel"), base[1], base[0]]), TEXTS, (0, 5)),
        (Rules(merchants=[("OAK FUEL", "Oak", "Fuel"), base[1]]), TEXTS, (0, 4)),
        (Rules(merchants=[("OAK FUEL", "Oak", "Fuel"), base[1]], payees=[("Alex", "Rent", "Housing")]), TEXTS, (0, 1)),
        (Rules(merchants=[("OAK FUEL", "Oak", "Fuel"), base[1]], payees=[("Alex", "Rent", "Housing")], ach=[("77", "Work", "Income")]), TEXTS, (0, 1)),
        (Rules(), TEXTS, (0, None)),
    ]
    memory = M.ClassificationMemory(spark, f"{folder}/memory")
    for k, (rules, texts, (new, touched)) in enumerate(steps):
        frame = ledger(spark, texts)
        assert outcome(memory.classify(frame, rules)) == outcome(K.with_classification(frame, rules)), k
        assert memory.counts["new"] == new and (touched is None or memory.counts["touched"] == touched), (k, memory.counts)
    assert outcome(M.ClassificationMemory(spark, f"{folder}/memory").classify(ledger(spark, TEXTS))) == outcome(
        K.with_classification(ledger(spark, TEXTS)))


def test_an_unfinished_version_is_done_again(spark, folder):
    memory = M.ClassificationMemory(spark, f"{folder}/memory")
    memory.update(ledger(spark, TEXTS), Rules())
    wrong = memory.outcomes().withColumn("merchant", F.lit("half a run"))
    wrong.write.parquet(f"{folder}/memory/outcomes/version=2")
    rules = Rules(merchants=[("PLUM", "Plum", "Dining")])
    assert outcome(memory.classify(ledger(spark, TEXTS), rules)) == outcome(K.with_classification(ledger(spark, TEXTS), rules))
    assert memory.outcomes().where("merchant = 'half a run'").count() == 0


def test_shipped_rules_all_have_literals_or_are_tried():
    known = [required_literals(p) for p, _, _ in V.DESCRIPTOR_RULES]
    assert sum(k is not None for k in known) > len(known) * 0.8


def test_texts_meet_whole_literals_not_shared_grams(spark):
    rules = spark.range(300).selectExpr("id as ord", "'#' || (1000000 + id * 2) || ' +LAS\\\\b' as pattern", "'m' || id as merchant", "'c' as category")
    texts = [f"ANVIL #{1000000 + 3 * i} LAS VEGAS" for i in range(300)] + ["", "#", "#1000000", "#1000000 #1000002  LAS", "1000004 LAS"]
    frame = spark.createDataFrame([(t,) for t in texts], "subject string")
    found = {r["subject"]: r["hit"] and r["hit"]["merchant"] for r in K.with_rule_table(frame, "subject", rules, "hit").collect()}
    assert found == {t: f"m{3 * i // 2}" if 3 * i % 2 == 0 and 3 * i < 600 else None for i, t in enumerate(texts[:300])} | {
        "": None, "#": None, "#1000000": None, "#1000000 #1000002  LAS": "m1", "1000004 LAS": None}
    literals = spark.createDataFrame([("#1000000 ",), ("absent one",), ("000 la",)], "literal string")
    low = spark.createDataFrame([(t.lower(),) for t in texts], "low string")
    places = {(r["gram"], p["skipped"], p["size"]) for r in anchored(literals, low).collect() for p in r["places"]}
    assert {size for _, _, size in places} == {9, 6} and len(places) == 2
