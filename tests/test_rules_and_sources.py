"""Rule files, case files, file discovery, line numbering, the gate."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import cases as CS
from ledgerloom.sources import lines as LN
from ledgerloom.sources import rules as RU
from ledgerloom.sources import tables as TB


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_load_rules(spark, folder):
    path = write(folder, "rules.json", json.dumps({
        "_comment": ["x"], "future": {"a": 1},
        "payees": {"some name": {"category": "Housing"}, "B": {"label": "Rent", "category": "Housing"}, "C": {"label": "no category"}, "D": "text"},
        "ach": {" 98a ": {"merchant": "Old", "category": "Housing"}, "98A": {"merchant": "Rent", "category": "Housing"}, "2": {"category": "no merchant"}},
        "merchants": [{"pattern": "PLUM", "merchant": "Plum", "category": "Auto"}, {"pattern": "x"}, "text"]}))
    rules = RU.load_rules(spark, path)
    assert rules.payees == [("some name", "Some Name", "Housing"), ("B", "Rent", "Housing")]
    assert rules.ach == [("98A", "Rent", "Housing")]
    assert rules.merchants == [("PLUM", "Plum", "Auto")]


def test_missing_file_is_no_rules_and_broken_ones_are_errors(spark, folder):
    assert RU.load_rules(spark, os.path.join(folder, "none.json")) == RU.Rules()
    with pytest.raises(RU.RulesError, match="broken.json"):
        RU.load_rules(spark, write(folder, "broken.json", '{"payees": '))
    bad = write(folder, "bad.json", json.dumps({"merchants": [{"pattern": "(", "merchant": "m", "category": "c"}]}))
    with pytest.raises(RU.RulesError, match="bad.json"):
        RU.load_rules(spark, bad)


def test_save_rule_replaces_appends_and_keeps_unknown_sections(spark, folder):
    path = write(folder, "rules.json", json.dumps({"_comment": ["mine"], "future": [1], "merchants": [
        {"pattern": "A", "merchant": "a", "category": "Auto"}, {"pattern": "B", "merchant": "b", "category": "Auto"}]}))
    RU.save_rule(spark, path, "merchants", "A", "new", "Travel")
    RU.save_rule(spark, path, "ach", " 12x ", "Rent", "Housing")
    doc = json.load(open(path))
    assert doc["_comment"] == ["mine"] and doc["future"] == [1]
    assert [m["merchant"] for m in doc["merchants"]] == ["b", "new"] and list(doc["ach"]) == ["12X"]
    RU.save_rule(spark, path, "merchants", "B", "", "", remove=True)
    assert [m["pattern"] for m in json.load(open(path))["merchants"]] == ["A"]
    with pytest.raises(RU.RulesError):
        RU.save_rule(spark, path, "merchants", "(", "x", "Travel")
    assert [m["pattern"] for m in json.load(open(path))["merchants"]] == ["A"]


def test_upsert_frame_and_override_order(spark):
    shipped = RU.shipped_rules(spark)
    user = RU.upsert_rule(spark.createDataFrame([], RU.RULE_SCHEMA), "merchant", "SHELL", "My Shell", "Travel")
    both = RU.prepend_rules(user, shipped)
    first = both.where("pattern = 'SHELL'").orderBy("ord").first()
    assert first["merchant"] == "My Shell" and both.count() == 155
    assert RU.remove_rule(user, "merchant", "SHELL").count() == 0


def test_cases(spark, folder):
    good = '{"description": "d", "account": "credit", "kind": "purchase", "expected_merchant": "m", "expected_category": "c"}'
    path = write(folder, "cases.jsonl", f"# note\n\n{good}\n  {good}\n")
    assert [r["line_no"] for r in CS.load_eval_cases(spark, path).collect()] == [3, 4]
    broken = write(folder, "broken.jsonl", f"{good}\nnot json\n")
    with pytest.raises(Exception, match="broken.jsonl:2"):
        CS.load_eval_cases(spark, broken).collect()


def test_discover(spark, folder):
    for name in ("b/two.TXT", "a/one.txt", "a/.hidden.txt", ".git/three.txt", "a/other.csv"):
        write(folder, name, "x")
    assert [r["name"] for r in LN.discover(spark, folder).collect()] == ["one.txt", "two.TXT"]


def test_lines_are_numbered_over_pages_and_blank_lines(spark):
    pages = spark.createDataFrame([("d", 1, "a  b\n\n \t c  d"), ("d", 2, ""), ("d", 3, "x\n\ny"), ("e", 1, "z")],
                                  "stmt_id string, page_no int, text string")
    got = [(r["stmt_id"], r["line_no"], r["text"]) for r in LN.explode_lines(pages).orderBy("stmt_id", "line_no").collect()]
    assert got == [("d", 1, "a b"), ("d", 3, "c d"), ("d", 5, "x"), ("d", 7, "y"), ("e", 1, "z")]


def test_gate(spark, folder):
    def totals(failed):
        return spark.createDataFrame([(failed, 0, 0)], "failed_checks long, unparsed long, problems long")

    table = {"transactions": spark.range(3)}
    root = os.path.join(folder, "out")
    assert TB.gated_write(table, totals(1), root) is False and not os.path.exists(root)
    with pytest.raises(RuntimeError):
        TB.gated_write(table, totals(1), root, strict=True)
    assert TB.gated_write(table, totals(1), root, force=True, fmt="parquet") is True
    first = TB.current_version(spark, root)
    assert TB.gated_write(table, totals(0), root, fmt="parquet") is True
    second = TB.current_version(spark, root)
    assert first != second and spark.read.parquet(f"{second}/transactions").count() == 3


def test_months_are_folders(spark, folder):
    rows = spark.createDataFrame([("2025-01", 1), ("2025-02", 2)], "month string, n int")
    clean = spark.createDataFrame([(0, 0, 0)], "failed_checks int, unparsed int, problems int")
    assert TB.gated_write({"transactions": rows}, clean, folder, fmt="parquet", partition_by={"transactions": ["month"]})
    ledger = TB.read_ledger(spark, TB.current_version(spark, folder), "parquet").where("month = '2025-02'")
    assert ledger.count() == 1
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_case_without_a_field_is_refused(spark, folder):
    lacks = write(folder, "lacks.jsonl", '# x\n{"description": "d", "account": "credit", "kind": "purchase", "expected_merchant": "m"}\n')
    with pytest.raises(Exception, match="lacks.jsonl:2: no expected_category"):
        CS.load_eval_cases(spark, lacks).collect()


def test_a_bad_pattern_is_refused(spark):
    with pytest.raises(RU.RulesError, match="invalid regex"):
        RU.check_patterns(spark, ["fine", "("], "here")
