"""Queries over literal cases in the language of the patterns, which the driver's tables never reach, and the results
that they must give, as SQL values: every rule status, every gate, negative terms, text scores, guardrails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import rules, scenario, shadow

_ITEM = "array<struct<score:{},snippet:string,text:string,block_text:string>>"

#: (rule, priority, evidence as (score, text)) and (status, risk, review, concerns, dealer).
RULES = [
    (("procurement_method", "medium", [(1.0, "Закупка проводится как электронный аукцион.")]), ("pass", "low", False, "", False)),
    (("procurement_method", "medium", [(1.0, "открытый запрос предложений")]), ("fail", "high", True, "procurement_method_non_auction_evidence", False)),
    (("procurement_method", "medium", [(1.0, "Электронный аукцион"), (1.0, "запрос котировок")]), ("conflict", "high", True, "procurement_method_non_auction_evidence|procurement_method_conflicting_evidence", False)),
    (("procurement_method", "medium", [(1.0, "конкурсная документация")]), ("unknown", "medium", True, "", False)),
    (("procurement_method", "medium", [(1.0, "указать один из следующих вариантов: открытый конкурс")]), ("unknown", "medium", True, "", False)),
    (("procurement_method", "medium", [(1.0, "электронный документ, подписанный КЭП")]), ("unknown", "medium", True, "procurement_method_weak_evidence", False)),
    (("security_requirement", "high", [(1.0, "обеспечение заявки на участие в закупке | не требуется")]), ("pass", "low", False, "", False)),
    (("security_requirement", "high", [(1.0, "обеспечение исполнения\n\tдоговора не требуется")]), ("pass", "low", False, "", False)),
    (("security_requirement", "high", [(1.0, "обеспечение договора не требуется"), (1.0, "обеспечение заявки составляет 5%")]), ("conflict", "high", True, "security_requirement_conflicting_evidence", False)),
    (("security_requirement", "high", [(0.0, "не предусмотрено обеспечение")]), ("pass", "low", False, "", False)),
    (("security_requirement", "high", [(2.0, "обеспечение заявки составляет 5%")]), ("pass", "low", False, "", False)),
    (("msp_restriction", "high", [(1.0, "участниками могут быть только субъекты малого и среднего предпринимательства")]), ("pass", "low", False, "", True)),
    (("msp_restriction", "high", [(1.0, "ограничений нет")]), ("pass", "medium", True, "msp_indicator_not_explicit", False)),
    (("msp_restriction", "low", []), ("unknown", "low", False, "", False)),
    (("delivery", "high", [(0.0, "срок поставки")]), ("unknown", "medium", True, "", False)),
    (("delivery", "low", [(None, "срок поставки")]), ("pass", "low", False, "", False)),
    (("procurement_method", "low", []), ("unknown", "medium", True, "", False)),
    (("msp_restriction", "medium", [(1.0, "дилер")]), ("pass", "low", False, "", True)),
    ((" ", "HIGH", [(1.0, "x")]), ("pass", "low", False, "", False)),
]

#: (rule, priority, evidence, negative terms) and (status, risk, review).
NEGATIVES = [
    (("a", "high", [(1.0, "Есть Брак")], ["брак"]), ("conflict", "high", True)),
    (("b", "low", [(0.0, "брак")], ["брак"]), ("fail", "high", True)),
    (("c", "low", [(0.0, "брак")], ["другое"]), ("unknown", "low", False)),
    (("d", "medium", [(1.0, "всё ёлки")], ["елки"]), ("conflict", "high", True)),
    (("e", "medium", [(1.0, "товар")], None), ("pass", "low", False)),
    (("f", "high", None, ["брак"]), ("unknown", "medium", True)),
]

#: Scores as text, and whether the one item confirms.
SCORES = [("2.5", True), ("0", False), ("-1", False), ("abc", True), ("", True), (" 3 ", True), (None, True), ("1e-3", True)]

_CORE = [("subject_okpd2_oil", "pass", "low", "high", False, False), ("subject_title_oil", "pass", "low", "high", False, False)]
#: Rules of a folder for each gate as (id, status, risk, priority, review, dealer), and (scenario, confidence).
GATES = {
    1: ([], "need_human_review", "low"),
    2: ([("x", "pass", "low", "high", False, False)], "need_human_review", "low"),
    3: ([("subject_okpd2_oil", "fail", "high", "high", True, False)], "need_human_review", "medium"),
    4: ([("subject_okpd2_oil", "fail", "high", "high", False, False)], "not_relevant", "medium"),
    5: ([*_CORE, ("msp_restriction", "pass", "high", "high", False, True)], "need_human_review", "medium"),
    6: ([*_CORE, ("msp_restriction", "conflict", "low", "high", False, False)], "need_human_review", "medium"),
    7: ([*_CORE, ("x", "conflict", "low", "high", False, False)], "need_human_review", "medium"),
    8: ([*_CORE, ("x", "fail", "low", "medium", False, False)], "need_human_review", "medium"),
    9: ([*_CORE, ("x", "unknown", "low", "high", False, False)], "need_human_review", "medium"),
    10: ([*_CORE, ("x", "pass", "low", "low", True, False)], "need_human_review", "medium"),
    11: ([("subject_okpd2_oil", "unknown", "low", "low", False, False)], "need_human_review", "medium"),
    12: ([*_CORE, ("msp_restriction", "pass", "low", "high", False, True)], "relevant_dealer", "high"),
    13: ([*_CORE, ("msp_restriction", "pass", "medium", "high", True, False)], "relevant_direct", "medium"),
}

#: Texts, and what they say of a restriction to small firms and of security.
GUARDRAILS = [
    ("закупка только для смп", "positive", None), ("ограничение участия не установлено", "negative", None), ("участниками могут быть любые лица", "negative", None), ("только товары. участники смп", None, None),
    ("смп", None, None), ("", None, None), ("обеспечение заявки не требуется", None, "negative"), ("обеспечение исполнения контракта составляет 5%", None, "positive"),
    ("обеспечение договора: предоставить взамен", None, None), ("обеспечение заявки вносится", None, "positive"), ("срок поставки", None, None),
    ("закупка только для смп; ограничение участия не установлено", "conflict", None), ("обеспечение заявки не требуется. обеспечение договора составляет 5%", None, "conflict"),
]


def _items(found: list | None) -> list | None:
    return None if found is None else [(score, None, text, None) for score, text in found]


def rule_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, rule, priority, _items(found)) for i, ((rule, priority, found), _) in enumerate(RULES, 1)]
    held = spark.createDataFrame(rows, f"case int, id string, priority string, evidence {_ITEM.format('double')}").withColumn("criterion", F.col("id"))
    return rules.evaluate(held).select("case", "id", "status", "risk", "human_review_required", F.array_join("evidence_concerns", "|").alias("evidence_concerns"), "explicit_dealer_indicator")


def rule_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(rule, priority, _items(found), terms) for (rule, priority, found, terms), _ in NEGATIVES]
    held = spark.createDataFrame(rows, f"id string, priority string, evidence {_ITEM.format('double')}, negative array<string>")
    return rules.evaluate(held, "negative").select("id", "status", "risk", "human_review_required")


def rule_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, "delivery", "high", [(score, None, "срок", None)]) for i, (score, _) in enumerate(SCORES, 1)]
    return rules.evaluate(spark.createDataFrame(rows, f"case int, id string, priority string, evidence {_ITEM.format('string')}")).select("case", "status")


def scenario_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(str(g), i, r[0], r[0], *r[1:5], "c", r[5]) for g, (own, _, _) in GATES.items() for i, r in enumerate(own, 1)]
    held = spark.createDataFrame(rows, "folder string, rule_index int, id string, criterion string, status string, risk string, priority string, human_review_required boolean, comment string, explicit_dealer_indicator boolean")
    every = spark.createDataFrame([(str(g),) for g in GATES], "folder string")
    return scenario.classify(held, folders=every).select(F.col("folder").cast("int").alias("case"), "gate", "scenario", "confidence", "human_review_required")


def guardrail_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, [(None, None, text, None)]) for i, (text, _, _) in enumerate(GUARDRAILS)]
    held = spark.createDataFrame(rows, f"case int, evidence {_ITEM.format('double')}")
    return held.select("case", shadow.overall(F.transform("evidence", shadow.msp_verdict)).alias("msp"), shadow.overall(F.transform("evidence", shadow.security_verdict)).alias("security"))


def _value(x: object) -> str:
    return {None: "NULL", True: "TRUE", False: "FALSE"}[x] if x is None or isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({columns})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rule_literal, rule_negative, rule_text_scores, scenario_gates, guardrail_verdict)}


def oracle_sql() -> dict[str, str]:
    return {
        "rule_literal": _values("\"case\", id, status, risk, human_review_required, evidence_concerns, explicit_dealer_indicator", [(i, rule.strip() or "criterion_unknown", *want) for i, ((rule, _, _), want) in enumerate(RULES, 1)]),
        "rule_negative": _values("id, status, risk, human_review_required", [(case[0], *want) for case, want in NEGATIVES]),
        "rule_text_scores": _values('"case", status', [(i, "pass" if yes else "unknown") for i, (_, yes) in enumerate(SCORES, 1)]),
        "scenario_gates": _values('"case", gate, scenario, confidence, human_review_required', [(g, g, name, sure, g <= 11 and g != 4) for g, (_, name, sure) in GATES.items()]),
        "guardrail_verdict": _values('"case", msp, security', [(i, msp, security) for i, (_, msp, security) in enumerate(GUARDRAILS)]),
    }
