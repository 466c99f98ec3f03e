"""The DOCX report's contract: every place that a template may hold, its text where a result has none, and its value.

A result is the record that sinks.reports knows. Values are plain text; reports.fill_docx puts them into the template.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from quillmark.functions import fixed
from quillmark.sinks.reports import PLACE, fill_docx, placeholders

# --- fixed values: places, the texts where nothing is known, labels ---
RULE_PLACES = {
    "subject_okpd2_oil": "ОКПД2", "procurement_method": "способу закупки", "price_nmc": "НМЦК", "delivery_location": "месту поставки", "delivery_period": "сроку поставки",
    "msp_restriction": "ограничению МСП", "national_regime": "национальному режиму", "security_requirement": "обеспечению", "contract_terms": "условиям контракта",
}
RULE_FALLBACKS = {"status": "unknown", "comment": "Комментарий по {} не сформирован.", "evidence": "Evidence по {} не найдено."}
COUNTERS = ("pass", "fail", "unknown", "conflict", "risk_low", "risk_medium", "risk_high")
REQUIRED = {
    "input.path": "Путь к входным данным не указан.", "stats.document_count": "0", "stats.criteria_count": "0", "stats.rules_count": "0", **{f"stats.{k}": "0" for k in COUNTERS}, "stats.human_review_required": "0",
    "scenario.scenario": "Итоговый сценарий не рассчитан.", "scenario.recommendation": "Рекомендация не сформирована.", "scenario.confidence": "-", "scenario.human_review_required": "не указано",
    "scenario.blocking_criteria": "Блокирующие критерии не выявлены.", "scenario.reasons": "Причины не сформированы.",
    **{f"rules.{rule}.{part}": text.format(name) for rule, name in RULE_PLACES.items() for part, text in RULE_FALLBACKS.items()},
}
OPTIONAL = {
    "summary.general_conclusion": "Общий вывод не сформирован.", "summary.attention_criteria": "Критерии, требующие внимания, не выявлены.", "summary.confirmed_criteria": "Подтвержденные критерии не выявлены.",
    "summary.low_priority_unknown_criteria": "Низкоприоритетные неподтвержденные критерии не выявлены.", "questions.count": "0", "questions.items": "Вопросы не выявлены.", "evidence.appendix": "Evidence не найдено.",
}
NO_CRITERION, NO_COMMENT, NO_REASON = "Критерий не указан", "Комментарий не сформирован.", "Причина не указана"
YES, NO = "да", "нет"
LINES = {
    "header": "[{}] {} — {} / {}", "comment": "  Комментарий: {}", "question": "- Уточнить критерий: {} ([{}], status={}, risk={})", "appendix": "- [{}] {}", "ground": "  Основание: {}",
}
#: Characters of a fragment, fragments of a rule, rules of the appendix.
FRAGMENT, FRAGMENTS, APPENDIX = 500, 2, 3


def _clean(value: object) -> str:
    return "" if value is None else " ".join(str(value).split())


def _shown(value: object, fallback: str) -> str:
    """Text on one line; truth as yes and no."""
    return {True: YES, False: NO}[value] if isinstance(value, bool) else _clean(value) or fallback


def cut_at_word(text: object, most: int = FRAGMENT) -> str:
    """At most so many characters on one line; a longer text ends with its last whole words and three dots."""
    line = _clean(text)
    if len(line) <= most:
        return line
    head = line[: most - 3].rstrip()
    return ((head.rpartition(" ")[0].rstrip() or head) + "...")[:most]


def evidence_lines(rule: dict) -> list[str]:
    """The first fragments with text of a rule's evidence, which may be one text."""
    found = rule.get("evidence")
    if isinstance(found, str):
        found = [{"text": found}]
    items = [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []
    block = lambda e: e["block"].get("text") if isinstance(e.get("block"), dict) else e.get("block_text")
    texts = (_clean(e.get("snippet")) or _clean(e.get("text")) or _clean(block(e)) for e in items)
    return [cut_at_word(t) for t in texts if t][:FRAGMENTS]


def rules_by_id(result: dict) -> tuple[dict[str, dict], list[str]]:
    """Rules by their id, the last of an id, from a list or a mapping; and warnings of those that are left out or have
    no place of their own."""
    given = result.get("rules")
    pairs = [(_clean(r.get("rule_id")) or _clean(r.get("id")), r) for r in given if isinstance(r, dict)] if isinstance(given, list) else [(_clean(k), r) for k, r in given.items()] if isinstance(given, dict) else []
    warnings = ["skipped rule without identifiable rule_id/id" for k, _ in pairs if not k]
    warnings += [f"skipped non-dict rule for {k}" for k, r in pairs if k and not isinstance(r, dict)]
    out = {k: r for k, r in pairs if k and isinstance(r, dict)}
    return out, warnings + [f"extra rule without direct placeholder: {k}" for k in out if k not in RULE_PLACES]


def confidence(value: object, fallback: str) -> str:
    """Numbers from 0 to 1 as a percentage of one decimal at most."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value * 100:.1f}".rstrip("0").rstrip(".") + "%" if 0 <= value <= 1 else str(value)
    return _shown(value, fallback)


def report_values(result: dict) -> tuple[dict[str, str], list[str]]:
    """(value of every place, warnings)."""
    if not isinstance(result, dict):
        raise ValueError("a result is a record")
    fallback = REQUIRED | OPTIONAL
    rules, warnings = rules_by_id(result)
    part = lambda key: result[key] if isinstance(result.get(key), dict) else {}
    stats, scenario = part("stats"), part("scenario_result")
    status = {k: _clean(r.get("status")).lower() or "unknown" for k, r in rules.items()}
    warnings += [f"unexpected rule status: {s} for {k}" for k, s in status.items() if s not in fixed.STATUSES]
    risk = {k: _clean(r.get("risk")).lower() or "unknown" for k, r in rules.items()}
    name = {k: _clean(r.get("criterion")) or NO_CRITERION for k, r in rules.items()}
    review = {k for k, r in rules.items() if r.get("human_review_required") is True}
    head = lambda k: LINES["header"].format(k, name[k], status[k], risk[k])
    open_ones = [k for k in rules if status[k] in ("fail", "unknown", "conflict") or k in review]
    records = lambda key: [x for x in scenario[key] if isinstance(x, dict)] if isinstance(scenario.get(key), list) else []

    def blocking() -> list[str]:
        out = []
        for x in records("blocking_criteria"):
            fields = (_clean(x.get("rule_id")) or "unknown", _clean(x.get("criterion")) or NO_CRITERION, _clean(x.get("status")) or "unknown", _clean(x.get("risk")) or "unknown")
            out += ["- " + LINES["header"].format(*fields), *([f"  {_clean(x['message'])}"] if _clean(x.get("message")) else [])]
        return out

    def reasons() -> list[str]:
        return [f"- {_clean(x.get('message')) or NO_REASON}" + (f" ({_clean(x['rule_id'])})" if _clean(x.get("rule_id")) else "") for x in records("reasons")]

    def appendix() -> list[str]:
        first = [(k, evidence_lines(r)) for k, r in list(rules.items())[:APPENDIX]]
        return [line for k, found in first if found for line in (LINES["appendix"].format(k, name[k]), LINES["ground"].format("\n".join(found)))]

    def conclusion() -> str:
        told = (source.get(k) for source in (part("summary"), result, scenario) for k in ("general_conclusion", "conclusion"))
        return next((t for x in told if (t := _clean(x))), "")

    wanted = stats.get("human_review_required")
    low = [k for k, r in rules.items() if status[k] == "unknown" and _clean(r.get("priority")).lower() == "low"]
    lines: dict[str, Callable[[], list[str]]] = {
        "scenario.blocking_criteria": blocking, "scenario.reasons": reasons, "evidence.appendix": appendix,
        "summary.attention_criteria": lambda: [x for k in open_ones for x in (f"- {head(k)}", LINES["comment"].format(_clean(rules[k].get("comment")) or NO_COMMENT))],
        "summary.confirmed_criteria": lambda: [f"- {head(k)}" for k in rules if status[k] == "pass"], "summary.low_priority_unknown_criteria": lambda: [f"- {head(k)}" for k in low],
        "questions.items": lambda: [LINES["question"].format(name[k], k, status[k], risk[k]) for k in open_ones],
    }
    values = {
        "input.path": _shown(result.get("input_path"), fallback["input.path"]), **{f"stats.{k}": _shown(result.get(k), "0") for k in ("document_count", "criteria_count", "rules_count")},
        **{f"stats.{k}": _shown(stats.get(k), "0") for k in COUNTERS}, "stats.human_review_required": str(len(review)) if wanted is None else str(int(wanted)) if isinstance(wanted, bool) else _clean(wanted) or "0",
        **{f"scenario.{k}": _shown(scenario.get(k), fallback[f"scenario.{k}"]) for k in ("scenario", "recommendation")}, "scenario.confidence": confidence(scenario.get("confidence"), fallback["scenario.confidence"]),
        "scenario.human_review_required": {True: YES, False: NO}.get(scenario.get("human_review_required") if isinstance(scenario.get("human_review_required"), bool) else None, fallback["scenario.human_review_required"]),
        "summary.general_conclusion": conclusion(), "questions.count": str(len(open_ones)),
    }
    for rule in RULE_PLACES:
        own = rules.get(rule, {})
        values |= {f"rules.{rule}.status": status.get(rule, "unknown"), f"rules.{rule}.comment": _clean(own.get("comment")), f"rules.{rule}.evidence": "\n".join(evidence_lines(own))}
    values |= {k: "\n".join(f()) for k, f in lines.items()}
    return {k: values.get(k) or text for k, text in fallback.items()}, list(dict.fromkeys(warnings))


def template_faults(found: set[str]) -> list[str]:
    """What is wrong with a template's places: unknown ones, required ones that lack, fewer than half of all."""
    known = REQUIRED | OPTIONAL
    out = [f"unknown place: {x}" for x in sorted(found - known.keys())] + [f"required place is missing (perhaps split into several runs): {x}" for x in sorted(REQUIRED.keys() - found)]
    return out + ([f"only {len(found)} of {len(known)} places"] if 2 * len(found) < len(known) else [])


def check_docx(data: bytes) -> None:
    """Raise where the bytes aren't a package with its parts, or hold a place that wasn't filled."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        if lacking := {"[Content_Types].xml", "word/document.xml"} - set(package.namelist()):
            raise ValueError("not in the document: " + ", ".join(sorted(lacking)))
        if left := sorted(set(PLACE.findall(package.read("word/document.xml").decode("utf-8")))):
            raise ValueError("not filled: " + ", ".join(left))


def render_docx(result: dict, template: bytes) -> tuple[bytes, list[str]]:
    """(the filled template, warnings). A template that breaks the contract is an error; optional places may lack."""
    found = placeholders(template)
    if faults := template_faults(found):
        raise ValueError("; ".join(faults))
    values, warnings = report_values(result)
    done = fill_docx(template, values)
    check_docx(done)
    return done, warnings + [f"optional placeholder missing in DOCX template: {{{{{k}}}}}" for k in sorted(OPTIONAL.keys() - found)]
