import pytest
from pyspark.sql import functions as F

from quillmark.operators import blocks, search
from quillmark.sources.criteria import build_terms, criteria_of, normalize_criterion


def _blocks(spark, rows):
    return spark.createDataFrame(rows, "folder string, doc_id long, position long, global_block_index long, document_index long, file_name string, block_id string, section string, text string")


def test_terms_order_kinds_and_weights():
    terms = build_terms("Поставка масла для ИП", ["масла", "способ закупки", "договор", "масла"])
    assert [(t.normalized, t.kind) for t in terms] == [("поставка масла для ип", "phrase"), ("поставка", "token"), ("масла", "token"), ("ип", "token"), ("способ закупки", "phrase"), ("договор", "token")]
    assert [t.phrase_weight for t in terms if t.kind == "phrase"] == [10000, 3000]
    assert [t.token_weight for t in terms if t.kind == "token"] == [1200, 1200, 1200, 400]
    assert build_terms(None, ["5%"])[0].kind == "token"
    assert build_terms("") == []


def test_scores_reasons_and_bonus(spark):
    rows = [("f", 1, 1, 1, 1, "договор.docx", "p1", "Масла моторные", "Поставка: масла моторные, договор"), ("f", 1, 2, 2, 1, "x", "p2", None, "маслами"), ("f", 1, 3, 3, 1, "x", "p3", None, "ничего")]
    found = {r["block_id"]: r for r in search.search_blocks(_blocks(spark, rows), None, ["масла моторные", "масла", "договор"], min_score=0.0).matches.collect()}
    one = found["p1"]
    assert one["match_reasons"] == ["phrase:text", "phrase:section", "token:text", "token:section", "token:text", "token:file_name"] or one["match_reasons"] == ["phrase:text", "phrase:section", "token:text", "token:section", "token:text"]
    assert found["p2"]["match_reasons"] == ["substring:text"] and float(found["p2"]["score"]) == 0.5
    assert float(one["score"]) == pytest.approx(8 + 1 + 1.2 + 0.5 + 0.4 + (0.125 if "token:file_name" in one["match_reasons"] else 0))
    assert "p3" not in found


def test_ties_break_by_place_then_missing_last(spark):
    rows = [("f", 1, 1, None, None, None, "z", None, "слово"), ("f", 2, 1, 5, 2, "b", "y", None, "слово"), ("f", 3, 1, 4, 2, "b", "x", None, "слово"), ("f", 4, 1, None, None, "a", "w", None, "слово")]
    got = search.search_blocks(_blocks(spark, rows), None, ["слово"], top_k=3).matches.orderBy("rank").collect()
    assert [r["block_id"] for r in got] == ["x", "y", "z"]


def test_arguments_and_counts(spark):
    rows = [("f", 1, 1, 1, 1, "a", "x", None, "слово")]
    for bad in ({"top_k": 0}, {"min_score": -1}):
        with pytest.raises(ValueError):
            search.search_blocks(_blocks(spark, rows), None, ["слово"], **bad)
    with pytest.raises(ValueError):
        search.search_blocks(_blocks(spark, rows), None, [" "])
    found = search.search_by_criteria(_blocks(spark, rows), criteria_of([{"id": "a", "keywords": "слово"}, {"id": "b", "keywords": ["нет"]}]))
    assert {r["criterion_id"]: (r["matches_total"], r["matches_returned"]) for r in found.stats.collect()} == {"a": (1, 1), "b": (0, 0)}
    assert {r["criterion_id"]: len(r["evidence"]) for r in search.evidence(found).collect()} == {"a": 1, "b": 0}


def test_criteria_records():
    c = normalize_criterion({"title": " T ", "terms": "a, b,", "search_terms": ["c"], "negative_terms": "x; y,x"}, 7)
    assert (c.criterion_id, c.criterion, c.query, c.keywords, c.negative_terms) == ("criterion_007", "T", "T", ("a", "b"), ("x", "y"))
    assert normalize_criterion({"id": "i", "keywords": None, "terms": ["z"]}, 1).keywords == ()
    with pytest.raises(ValueError):
        criteria_of([{"id": "a"}, {"id": "a"}])
    with pytest.raises(ValueError):
        normalize_criterion({"keywords": [["x"]]}, 1)


def test_numbers_over_ranges(spark):
    docs = spark.createDataFrame([("s", i * 3000, "a\n\nb" if i % 2 else "c") for i in range(6)] + [("t", 1, "x")], "source string, doc_id long, text string")
    got = blocks.number_blocks(blocks.blocks_of_documents(docs)).where("folder = 's'").orderBy("doc_id", "position").collect()
    assert [r["global_block_index"] for r in got] == list(range(1, len(got) + 1))
    assert [r["document_id"] for r in got] == ["d000001", "d000002", "d000002", "d000003", "d000004", "d000004", "d000005", "d000006", "d000006"]


def test_sections_carry(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "H"), (1, 3, "y"), (2, 1, "z")], "d int, p int, text string")
    got = blocks.carry_section(rows, F.col("text") == "H", ["d"], "p").orderBy("d", "p").collect()
    assert [r["section"] for r in got] == [None, "H", "H", None]
