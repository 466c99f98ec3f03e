"""Plans of the registered queries: what they read and shuffle."""

import re

import pytest

from quillmark.plans import catalog

DDL = {"documents": "doc_id long, text string, lang string, source string, n_chars long"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, f"of the way\n\nthat {i} and it", "en", f"s{i % 3}", 20) for i in range(30)]
    spark.createDataFrame(rows, DDL["documents"]).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("blocks_split", 1, 0), ("criteria_topk", 1, 1), ("criteria_stats", 2, 2), ("rule_status", 2, 2), ("scenario_by_folder", 2, 2), ("llm_payload", 2, 2), ("blocks_numbered", 3, 5)])
def test_scans_and_exchanges(spark, tables, name, scans, exchanges):
    plan = catalog.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans and len(re.findall(r"\bExchange ", plan)) <= exchanges


def test_folders_are_read_without_texts(spark, tables):
    plan = catalog.queries()["criteria_stats"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan


def test_counts(spark, tables):
    found = {(r["folder"], r["criterion_id"]): r["matches_total"] for r in catalog.queries()["criteria_stats"](spark, tables).collect()}
    assert len(found) == 24 and found["s0", "subject_okpd2_oil"] == 20 and found["s1", "oil_purpose"] == 0
