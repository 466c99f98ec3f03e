import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark.operators import rules, scenario
from quillmark.plans import catalog, literals

ITEM = "array<struct<score:double,snippet:string,text:string,block_text:string>>"


@pytest.mark.parametrize("name", sorted(literals.queries()))
def test_literal_cases(spark, name):
    want = duckdb.connect().execute(literals.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, literals.queries()[name](spark, "").select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_negative_terms_only_when_named(spark):
    rows = spark.createDataFrame([("a", "high", [(1.0, "Есть Брак", None, None)], ["брак"]), ("b", "low", [(0.0, "брак", None, None)], ["брак"]), ("c", "low", None, None)], f"id string, priority string, evidence {ITEM}, neg array<string>")
    assert [r["status"] for r in rules.evaluate(rows, "neg").orderBy("id").collect()] == ["conflict", "fail", "unknown"]
    assert [r["status"] for r in rules.evaluate(rows).orderBy("id").collect()] == ["pass", "unknown", "unknown"]


def test_synonyms(spark):
    df = spark.createDataFrame([("Критичный",), ("LOW",), ("",), (None,), ("низкое ",)], "p string")
    assert [r[0] for r in df.select(rules.normalize_priority(F.col("p"))).collect()] == ["high", "low", "medium", "medium", "low"]


def test_every_gate(spark):
    rows = [(str(g), i, r[0], r[0], *r[1:4], r[4], "c", r[5]) for g, (rs, _, _) in literals.GATES.items() for i, r in enumerate(rs, 1)]
    df = spark.createDataFrame(rows, "folder string, rule_index int, id string, criterion string, status string, risk string, priority string, human_review_required boolean, comment string, explicit_dealer_indicator boolean")
    every = spark.createDataFrame([(str(g),) for g in literals.GATES], "folder string")
    got = {int(r["folder"]): r for r in scenario.classify(df, folders=every).collect()}
    for g, (_, name, confidence) in literals.GATES.items():
        assert (got[g]["gate"], got[g]["scenario"], got[g]["confidence"]) == (g, name, confidence)
        assert got[g]["human_review_required"] == (g <= 11 and g != 4)
    assert [b["rule_id"] for b in got[8]["blocking_criteria"]] == ["x"]
    assert len(got[13]["reasons"]) == 2


def test_blank_ids_and_repeated_blockers(spark):
    rows = [("f", 1, "subject_okpd2_oil", "", "pass", "low", "high", None, None, None), ("f", 2, " ", None, "weird", None, "high", None, "", None), ("f", 3, "x", "X", "unknown", "low", "high", True, "", None), ("f", 4, "x", "X", "unknown", "low", "high", True, "", None)]
    df = spark.createDataFrame(rows, "folder string, rule_index int, id string, criterion string, status string, risk string, priority string, human_review_required boolean, comment string, explicit_dealer_indicator boolean")
    got = scenario.classify(df).first()
    assert [b["rule_id"] for b in got["blocking_criteria"]] == ["unknown:2", "x"] and len(got["reasons"]) == 3


@pytest.mark.parametrize("name", ["rule_literal"])
def test_registered(name):
    assert name in catalog.queries()
