"""From a folder of files to a scored result and its reports, in one call.

The tables stay distributed up to one row for each criterion; what reaches the driver is as large as the criteria and
top_k.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import rules, scenario, search
from quillmark.sinks import docx_report, reports
from quillmark.sources.criteria import Criterion, criteria_of, load_criteria
from quillmark.sources.folder import read_folder

#: Names of the written files.
SCORE, QUESTIONS, SUMMARY, DOCX = "tender_score.json", "questions_for_customer.md", "tender_summary.md", "tender_summary.docx"
_RULE = ("id", "block", "criterion", "priority", "evidence", "status", "risk", "human_review_required", "comment", "evidence_concerns", "explicit_dealer_indicator")


def rules_of(spark: SparkSession, found: search.Search, criteria: list[Criterion]) -> DataFrame:
    """The evaluated rules of every folder, with rule_index in the order of the criteria."""
    rows = [(i, c.criterion_id, c.block, c.criterion, c.priority) for i, c in enumerate(criteria, 1)]
    told = F.broadcast(spark.createDataFrame(rows, "rule_index int, id string, block string, criterion string, priority string"))
    held = search.evidence(found)
    return rules.evaluate(held.join(told, held["criterion_id"] == told["id"]).drop("criterion_id"))


def evaluate_folder(spark: SparkSession, path: str, criteria: list[Criterion], top_k: int = 5, min_score: float = 0.0, verdicts: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """The result of one file or folder: its rules in the order of the criteria, counters, scenario, and what was read.
    verdicts adds the advisory column llm_verdict to rules; it feeds nothing else. A folder without blocks or no
    criteria at all give a result too."""
    if not Path(path).exists() and "://" not in path:
        raise FileNotFoundError(f"no such file or folder: {path}")
    read = read_folder(spark, path, strict=Path(path).is_file())
    here = spark.createDataFrame([(path,)], "folder string")
    found: list[dict] = []
    told: dict = {}
    if criteria:
        done = rules_of(spark, search.search_by_criteria(read.blocks, criteria, top_k, min_score, folders=here), criteria)
        done = verdicts(done) if verdicts else done
        found = [r.asDict(recursive=True) for r in done.orderBy("rule_index").collect()]
    scored = spark.createDataFrame([(path, i, *(r[k] for k in _SCENARIO)) for i, r in enumerate(found, 1)], _SCENARIO_TYPES)
    told = scenario.classify(scored, folders=here).first().asDict(recursive=True)
    kept = [{k: r[k] for k in (*_RULE, *(["llm_verdict"] if "llm_verdict" in r else []))} for r in found]
    types = {r["source_type"]: r["documents"] for r in read.by_type.collect()}
    source = {"documents": sum(types.values()), "by_type": types, "blocks": read.blocks.count(), "skipped": read.skipped.count(), "failed": read.failed.count()}
    return {
        "criteria_count": len(criteria), "rules_count": len(kept), "rules": kept, "stats": reports.recount({}, kept), "input_path": path, "document_count": source["documents"], "source_stats": source,
        "scenario_result": {k: v for k, v in told.items() if k not in ("folder", "gate")},
    }


_SCENARIO = ("id", "criterion", "status", "risk", "priority", "human_review_required", "comment", "explicit_dealer_indicator")
_SCENARIO_TYPES = "folder string, rule_index int, id string, criterion string, status string, risk string, priority string, human_review_required boolean, comment string, explicit_dealer_indicator boolean"


def write_reports(result: dict, out: str, template: bytes | None = None) -> list[Path]:
    """Score, questions and summary, and the DOCX report where there is a template: the files written."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    texts = {SCORE: reports.render_json(result).encode(), QUESTIONS: reports.render_questions(result).encode(), SUMMARY: reports.render_summary(result).encode()}
    if template is not None:
        texts[DOCX] = docx_report.render_docx(result, template)[0]
    for name, data in texts.items():
        (folder / name).write_bytes(data)
    return [folder / name for name in texts]


def score_folder(spark: SparkSession, path: str, criteria: str, out: str, top_k: int = 5, min_score: float = 0.0, template: str | None = None, verdicts: Callable[[DataFrame], DataFrame] | None = None) -> list[Path]:
    """From a folder and a file of criteria to the written reports."""
    result = evaluate_folder(spark, path, criteria_of(load_criteria(criteria)), top_k, min_score, verdicts)
    return write_reports(result, out, Path(template).read_bytes() if template else None)
