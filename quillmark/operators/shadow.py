"""The advisory verdict of a language model beside each rule: when it is skipped, what the model is shown, how its
answer is checked. It is a column of its own and never feeds the scenario.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import fixed
from quillmark.functions.text import WS, blank_to_null, collapse

#: Items and characters of evidence that a model is shown, and what a caller may raise them to.
ITEMS, MOST_ITEMS, CHARS, MOST_CHARS = 3, 10, 1200, 4000
VERDICT_TYPE = (
    "struct<invocation_status:string,rule_id:string,verdict:string,confidence:string,human_review_required:boolean,reason:string,supporting_evidence_ids:array<bigint>,warnings:array<string>,"
    "conflicts_with_rule:boolean,deterministic_status:string,provider:string,model:string,error_type:string,error_message:string,raw_response_saved:boolean>"
)


# --- guardrails, as expressions over evidence ---
def shown_text(item: Column) -> Column:
    """Text, else snippet, else block text: the first that isn't blank."""
    return F.coalesce(*(F.when(blank_to_null(item[k]).isNotNull(), item[k]) for k in ("text", "snippet", "block_text")), F.lit(""))


def _either(markers: tuple[str, ...]) -> str:
    return "(?:" + "|".join(rf"\Q{m}\E" for m in markers) + ")"


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit(_either(markers)))


def any_near(text: Column, left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    """Whether a marker of either side stand near each other: in one sentence where the text has sentence marks,
    else with starts at most NEAR_CHARS apart."""
    in_sentence = F.exists(F.split(text, "[.!?;]+"), lambda s: _has(s, left) & _has(s, right))
    pair = lambda x, y: rf"(?s)(?={_either(x)}).{{0,{fixed.NEAR_CHARS}}}(?={_either(y)})"
    apart = F.rlike(text, F.lit(pair(left, right))) | F.rlike(text, F.lit(pair(right, left)))
    return F.when(F.rlike(text, F.lit("[.!?;]")), in_sentence).otherwise(apart)


def near(text: Column, a: str, b: str) -> Column:
    return any_near(text, (a,), (b,))


def _of(text: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text that is computed once."""
    return F.element_at(F.transform(F.array(text), f), 1)


def _verdict(positive: Column, negative: Column) -> Column:
    return F.when(positive & negative, "conflict").when(positive, "positive").when(negative, "negative")


def msp_verdict(item: Column) -> Column:
    def of(text: Column) -> Column:
        absent = _has(text, fixed.MSP_ABSENCE) | any_near(text, fixed.MSP_PARTICIPATION, fixed.MSP_NEGATIVE)
        return _verdict(any_near(text, fixed.MSP_MARKERS, fixed.MSP_POSITIVE), absent)

    return _of(collapse(F.lower(shown_text(item))), of)


def security_verdict(item: Column) -> Column:
    def of(text: Column) -> Column:
        blanked = text
        for m in fixed.SECURITY_ABSENT:
            blanked = F.replace(blanked, F.lit(m), F.lit(" " * len(m)))
        asked = _of(blanked, lambda t: any_near(t, fixed.SECURITY_TYPES, fixed.SECURITY_POSITIVE) | (any_near(t, fixed.SECURITY_TYPES, fixed.SECURITY_ACTION) & ~_has(text, fixed.SECURITY_REPLACEMENT)))
        return _verdict(asked, any_near(text, fixed.SECURITY_TYPES, fixed.SECURITY_ABSENT))

    return _of(collapse(F.lower(shown_text(item))), of)


def overall(verdicts: Column) -> Column:
    """One verdict of an array of them: a conflict, or both sides, make a conflict."""
    has = lambda v: F.array_contains(verdicts, v)
    return F.when(has("conflict") | (has("positive") & has("negative")), "conflict").when(has("positive"), "positive").when(has("negative"), "negative")


def _any_item(patterns: tuple[str, ...]) -> Column:
    return F.exists("evidence", lambda e: F.rlike(F.lower(shown_text(e)), F.lit("(?U)" + "|".join(f"(?:{p})" for p in patterns))))


def skip_reason(selective: bool = False, run_on_pass: bool = False) -> Column:
    """Why the model isn't asked about a rule (id, status, risk, human_review_required, evidence); null where it is.
    Rules that are never shown to it have no reason either; see is_target."""
    calm = (F.col("status") == "pass") & (F.lower("risk") == "low") & ~F.col("human_review_required")
    out = F.when(calm & F.lit(selective and not run_on_pass), fixed.SKIP_SELECTIVE)
    out = out.when((F.col("id") == fixed.PROCUREMENT) & ~_any_item(fixed.METHOD_ALLOWED), fixed.SKIP_METHOD)
    work, goods = _any_item(fixed.WORK_ALLOWED), _any_item(fixed.GOODS_ALLOWED)
    out = out.when((F.col("id") == fixed.GOODS) & ~work, F.when(goods, fixed.SKIP_GOODS_REDUNDANT).otherwise(fixed.SKIP_GOODS_WEAK))
    out = out.when((F.col("id") == fixed.MSP) & overall(F.transform("evidence", msp_verdict)).isNull(), fixed.SKIP_MSP)
    return out.when((F.col("id") == fixed.SECURITY) & overall(F.transform("evidence", security_verdict)).isNull(), fixed.SKIP_SECURITY)


def is_target() -> Column:
    return F.col("id").isin(*fixed.SHADOW_IDS)


def shortened(text: Column, most: int) -> Column:
    """The text, or its beginning and a mark, of at most so many characters together."""
    room = most - len(fixed.LLM_CUT)
    if room < 0:
        return F.when(F.length(text) <= most, text).otherwise(F.lit(fixed.LLM_CUT[:most]))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, room), f"[{WS}]+$", ""), F.lit(fixed.LLM_CUT)))


def payload(evidence: Column, items: int = ITEMS, chars: int = CHARS) -> Column:
    """The first items with text, as (llm_evidence_id: place in the evidence from 0, text of at most chars characters,
    score). Null evidence is empty."""
    items, chars = min(items, MOST_ITEMS), min(chars, MOST_CHARS)
    text = lambda e: F.coalesce(*(F.when(blank_to_null(e[k]).isNotNull(), e[k]) for k in ("snippet", "text", "block_text")), F.lit(""))
    shown = F.transform(evidence, lambda e, i: F.struct(i.alias("llm_evidence_id"), shortened(text(e), chars).alias("text"), e["score"].alias("score")))
    return F.coalesce(F.slice(F.filter(shown, lambda x: x["text"] != ""), 1, items), F.array())


def payload_of(evidence: object, items: int = ITEMS, chars: int = CHARS) -> list[dict]:
    """The same for one rule's evidence as a record, whose items may hold their block's text as block.text."""
    out: list[dict] = []
    for i, e in enumerate(evidence if isinstance(evidence, list) else []):
        if isinstance(e, dict) and len(out) < min(items, MOST_ITEMS):
            block = e["block"].get("text") if isinstance(e.get("block"), dict) else e.get("block_text")
            text = next((t for t in (e.get("snippet"), e.get("text"), block) if isinstance(t, str) and t.strip()), "")
            most = min(chars, MOST_CHARS)
            if len(text) > most:
                room = most - len(fixed.LLM_CUT)
                text = fixed.LLM_CUT[:most] if room < 0 else text[:room].rstrip() + fixed.LLM_CUT
            score = {"score": e["score"]} if type(e.get("score")) in (int, float) else {}
            out += [{"llm_evidence_id": i, "text": text} | score] if text else []
    return out


# --- prompts and answers ---
def render_prompt(template: str, values: dict[str, str]) -> str:
    """Fill {{name}} places in one pass, so that values aren't searched for places again; unknown names stay."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values.get(m[1], m[0]), template)


class ChatClient(Protocol):
    """Whatever answers a prompt: text, or (None, error type, message)."""

    def chat(self, prompt: str) -> tuple[str | None, str | None, str | None]: ...


def _all(kind: type) -> Callable[[object], bool]:
    return lambda x: isinstance(x, list) and all(type(y) is kind for y in x)


#: What a field of an answer must be, and how that is said; fields by the order in which they are looked at.
_KINDS: dict[str, tuple[Callable[[object], bool], str]] = {
    "text": (lambda x: isinstance(x, str), "a string"),
    "flag": (lambda x: isinstance(x, bool), "a boolean"),
    "ids": (_all(int), "list[int]"),
    "texts": (_all(str), "list[str]"),
}


def broken_contract(told: object) -> str | None:
    """What an answer lacks of the contract, the first thing; null where it keeps it."""
    if not isinstance(told, dict):
        return fixed.CONTRACT_OBJECT
    if lacking := sorted(fixed.CONTRACT_FIELDS.keys() - told.keys()):
        return fixed.CONTRACT_MISSING + ", ".join(lacking)
    wrong = (f"Field '{k}' must be {_KINDS[kind][1]}" for k, kind in fixed.CONTRACT_FIELDS.items() if not _KINDS[kind][0](told[k]))
    unknown = (f"Invalid {k} value" for k, allowed in fixed.CONTRACT_VALUES.items() if told[k] not in allowed)
    return next(wrong, None) or next(unknown, None)


def parse_verdict(answer: str, rule_id: str, status: str, provider: str, model: str) -> dict:
    """A model's answer as a verdict, conflict marked; what isn't JSON or breaks the contract becomes one of
    invocation_status invalid_json. The rule's own id, status, provider and model count, not the answer's."""
    own = {"rule_id": rule_id, "deterministic_status": status, "provider": provider, "model": model}
    fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", answer, re.DOTALL | re.IGNORECASE)
    try:
        told = json.loads(fenced[1] if fenced else answer)
    except ValueError as e:
        return verdict_of(own, "invalid_json", fixed.LLM_NOT_JSON, warnings=[f"Invalid JSON response: {getattr(e, 'msg', e)}"], error=("json_decode_error", str(e))) | {"raw_response_saved": False}
    if isinstance(told, dict):
        told = {"provider": provider, "model": model} | told
    if wrong := broken_contract(told):
        return verdict_of(own, "invalid_json", fixed.LLM_BROKEN, warnings=[f"Contract violation: {wrong}"], error=("contract_validation_error", wrong)) | {"raw_response_saved": False}
    return mark_conflict(verdict_of(own, "ok", told["reason"], told["verdict"], told["confidence"], told["human_review_required"], told["warnings"], ids=told["supporting_evidence_ids"]))


def verdict_of(own: dict, invocation: str, reason: str, verdict: str = "unknown", confidence: str = "low", review: bool = True, warnings: list[str] | None = None, ids: list[int] | None = None, error: tuple[str, str] | None = None) -> dict:
    """A whole verdict; own has rule_id, deterministic_status, provider and model. Values that aren't allowed become
    unknown and low, blank warnings go."""
    status = str(own["deterministic_status"] or "").strip().lower()
    return {
        "invocation_status": invocation, "rule_id": str(own["rule_id"] or "").strip() or "criterion_unknown",
        "verdict": verdict if verdict in fixed.STATUSES else "unknown", "confidence": confidence if confidence in fixed.CONFIDENCES else "low", "human_review_required": review, "reason": reason,
        "supporting_evidence_ids": list(ids or ()), "warnings": [x for x in warnings or () if x.strip()], "conflicts_with_rule": False, "deterministic_status": status if status in fixed.STATUSES else "unknown",
        "provider": own["provider"], "model": own["model"],
    } | ({"error_type": error[0], "error_message": error[1]} if error else {})


def mark_conflict(verdict: dict) -> dict:
    """conflicts_with_rule wherever verdict and status differ, unknown ones included, with a warning that says so."""
    if verdict["verdict"] == verdict["deterministic_status"]:
        return verdict | {"conflicts_with_rule": False}
    says = fixed.LLM_CONFLICT.format(verdict["verdict"], verdict["deterministic_status"])
    return verdict | {"conflicts_with_rule": True, "warnings": list(dict.fromkeys([*verdict["warnings"], says]))}


def failed(own: dict, kind: str | None, message: str | None) -> dict:
    """The verdict where a model didn't answer: unavailable if it couldn't be reached or refused, else error."""
    kind, message = kind or "llm_error", message or "LLM call failed."
    away = kind in fixed.UNAVAILABLE
    return verdict_of(own, "unavailable" if away else "error", fixed.LLM_UNAVAILABLE if away else fixed.LLM_FAILED, warnings=[f"LLM call failed: {message}"], error=(kind, message))


def classify(rule: dict, client: ChatClient, template: str, provider: str, model: str, enabled: bool = True) -> dict:
    """The verdict on one rule: id, criterion, status and evidence_json, the payload as JSON."""
    own = {"rule_id": rule["id"], "deterministic_status": rule["status"], "provider": provider, "model": model}
    if not enabled:
        return verdict_of(own, "skipped", fixed.LLM_DISABLED, review=False)
    shown = rule.get("evidence_json") or "[]"
    if json.loads(shown) == []:
        return verdict_of(own, "skipped", fixed.LLM_NO_EVIDENCE, warnings=[fixed.LLM_NO_EVIDENCE_WARNING])
    values = own | {"criterion": rule.get("criterion") or "", "evidence_json": json.dumps(json.loads(shown), ensure_ascii=False, indent=2), "rule_instructions": fixed.RULE_INSTRUCTIONS.get(rule["id"], "")}
    answer, kind, message = client.chat(render_prompt(template, {k: str(v) for k, v in values.items()}))
    return failed(own, kind, message) if answer is None else parse_verdict(answer, rule["id"], rule["status"], provider, model)


def shadow_verdicts(rules: DataFrame, client: Callable[[], ChatClient], template: str, provider: str, model: str, selective: bool = False, run_on_pass: bool = False, items: int = ITEMS, chars: int = CHARS, enabled: bool = True) -> DataFrame:
    """rules with llm_verdict: null for rules that aren't targets. client makes a task's own client.

    Skipped rules never reach Python. A crash of the client becomes an error verdict. Tasks may run again, so a
    client should be safe to ask twice. Every row has its own verdict, repeated rules and null folders included: the
    rows themselves go through the worker, so nothing is joined.
    """
    names = [f"c{i}" for i in range(len(rules.columns))]
    easy = F.col("skip").isin(fixed.SKIP_SELECTIVE, fixed.SKIP_GOODS_REDUNDANT)
    told = rules.select(
        F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(rules.columns, names, strict=True))).alias("row"),
        is_target().alias("target"), skip_reason(selective, run_on_pass).alias("skip"), F.col("id").alias("id"), F.col("criterion").alias("criterion"), F.col("status").alias("status"),
        F.to_json(payload(F.col("evidence"), items, chars)).alias("evidence_json"),
    ).withColumn("ask", F.coalesce(F.col("target"), F.lit(False)) & F.col("skip").isNull())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out: list[str | None] = []
            for r in batch.drop_columns(["row"]).to_pylist():
                if not r["ask"]:
                    out.append(None)
                    continue
                try:
                    own = own or client()
                    verdict = classify(r, own, template, provider, model, enabled)
                except Exception as e:
                    base = {"rule_id": r["id"], "deterministic_status": r["status"], "provider": provider, "model": model}
                    verdict = verdict_of(base, "error", fixed.LLM_SHADOW_FAILED, warnings=[str(e)], error=(type(e).__name__, str(e)))
                out.append(json.dumps(verdict, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "target", "skip", "id", "status")), pa.array(out, pa.string())], ["row", "target", "skip", "id", "status", "told"])

    row = told.schema["row"].dataType.simpleString()
    asked = told.mapInArrow(ask, f"row {row}, target boolean, skip string, id string, status string, told string")
    skipped = F.struct(
        F.lit("skipped").alias("invocation_status"), F.col("id").alias("rule_id"), F.when(easy, "pass").otherwise("unknown").alias("verdict"), F.when(easy, "high").otherwise("low").alias("confidence"),
        (~easy).alias("human_review_required"), F.col("skip").alias("reason"), F.array().cast("array<bigint>").alias("supporting_evidence_ids"), F.array().cast("array<string>").alias("warnings"),
        F.lit(False).alias("conflicts_with_rule"), F.col("status").alias("deterministic_status"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("error_type", "string"), ("error_message", "string"), ("raw_response_saved", "boolean"))),
    )
    verdict = F.when(F.col("target") & F.col("skip").isNotNull(), skipped).otherwise(F.from_json("told", VERDICT_TYPE))
    return asked.select(*(F.col(f"row.{n}") for n in names), verdict.alias("llm_verdict")).toDF(*rules.columns, "llm_verdict")
