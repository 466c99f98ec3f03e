"""The scenario of a folder: an ordered list of gates over all its rules, of which the first that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import fixed
from quillmark.functions.text import strip


def _choice(col: Column, allowed: tuple[str, ...], default: str) -> Column:
    text = F.lower(strip(col))
    return F.when(text.isin(*allowed), text).otherwise(default)


def is_neutral(r: Column) -> Column:
    """Whether a rule's wish for review doesn't count."""
    msp = r["rule_id"] == fixed.MSP
    calm = (msp & r["status"].isin("fail", "unknown")) | (msp & (r["status"] == "pass") & ~r["dealer"]) | ((r["priority"] == "low") & (r["status"] == "unknown"))
    return (r["risk"] != "high") & calm


def _core(r: Column) -> Column:
    return r["rule_id"].isin(*fixed.CORE_IDS)


#: (which rules offend, message, scenario, confidence, review) in order; a gate applies where a rule offends.
_MSP = lambda r: r["rule_id"] == fixed.MSP
_STATUS = lambda r, s: r["status"] == s
_HIGH = lambda r: r["priority"] == "high"
GATES = [
    (lambda r: _core(r) & _STATUS(r, "fail") & r["review"], fixed.REASON_CORE_FAIL_REVIEW, "need_human_review", True),
    (lambda r: _core(r) & _STATUS(r, "fail") & ~r["review"], fixed.REASON_CORE_FAIL, "not_relevant", False),
    (lambda r: _MSP(r) & (r["risk"] == "high"), fixed.REASON_MSP_RISK, "need_human_review", True),
    (lambda r: _MSP(r) & _STATUS(r, "conflict"), fixed.REASON_MSP_CONFLICT, "need_human_review", True),
    (lambda r: ~_MSP(r) & _HIGH(r) & _STATUS(r, "conflict"), fixed.REASON_HIGH_CONFLICT, "need_human_review", True),
    (lambda r: ~_core(r) & ~_MSP(r) & _STATUS(r, "fail") & r["priority"].isin("high", "medium"), fixed.REASON_SIGNIFICANT_FAIL, "need_human_review", True),
    (lambda r: ~_MSP(r) & _HIGH(r) & _STATUS(r, "unknown"), fixed.REASON_HIGH_UNKNOWN, "need_human_review", True),
    (lambda r: r["review"] & ~is_neutral(r), fixed.REASON_REVIEW, "need_human_review", True),
    (lambda r: _core(r) & ~_STATUS(r, "pass"), fixed.REASON_CORE_NOT_PASS, "need_human_review", True),
]


def _reasons(rules: Column, which, message: str) -> Column:
    return F.transform(F.filter(rules, which), lambda r: F.struct(r["out_id"].alias("rule_id"), F.lit(message).alias("message"), r["status"].alias("status"), r["risk"].alias("risk"), r["priority"].alias("priority")))


def _general(message: str) -> Column:
    nothing = F.lit(None).cast("string")
    return F.array(F.struct(nothing.alias("rule_id"), F.lit(message).alias("message"), nothing.alias("status"), nothing.alias("risk"), nothing.alias("priority")))


def classify(rules: DataFrame, key: str = "folder", order: str = "rule_index", folders: DataFrame | None = None) -> DataFrame:
    """(key, scenario, recommendation, confidence, human_review_required, gate, reasons, blocking_criteria, stats).

    rules have key, order, id, criterion, status, risk, priority, human_review_required, comment and
    explicit_dealer_indicator; a folder's rules are as many as there are criteria. Blank ids become unknown:N by
    order; null flags count as false; statuses, risks and priorities that aren't known get their defaults. folders
    adds the keys that have no rules at all.
    """
    own_id = F.nullif(strip(F.coalesce(F.col("id"), F.lit(""))), F.lit(""))
    out_id = F.coalesce(own_id, F.concat(F.lit("unknown:"), F.col(order).cast("string")))
    text = lambda c, default: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), default)
    rule = F.struct(
        F.col(order).alias("at"), F.coalesce(own_id, F.lit("")).alias("rule_id"), out_id.alias("out_id"), text("criterion", out_id).alias("criterion"),
        _choice(F.col("status"), fixed.STATUSES, "unknown").alias("status"), _choice(F.col("risk"), fixed.RISKS, "medium").alias("risk"),
        _choice(F.col("priority"), ("high", "medium", "low"), "medium").alias("priority"), F.coalesce("human_review_required", F.lit(False)).alias("review"),
        text("comment", F.lit("")).alias("comment"), F.coalesce("explicit_dealer_indicator", F.lit(False)).alias("dealer"),
    )
    listed = rules.groupBy(key).agg(F.array_sort(F.collect_list(rule)).alias("r"))
    if folders is not None:
        empty = F.array().cast(listed.schema["r"].dataType)
        listed = folders.select(key).distinct().join(listed, key, "left").withColumn("r", F.coalesce("r", empty))
    r = F.col("r")
    n = lambda f: F.size(F.filter(r, f)).cast("long")
    msp_pass = lambda x: _MSP(x) & _STATUS(x, "pass") & x["dealer"]
    msp_vague = lambda x: _MSP(x) & _STATUS(x, "pass") & ~x["dealer"]
    stats = {
        "rules_total": F.size(r).cast("long"), "core_passed": n(lambda x: _core(x) & _STATUS(x, "pass")), "core_total": n(_core), "core_fails": n(lambda x: _core(x) & _STATUS(x, "fail")),
        "core_unknown_or_not_pass": n(lambda x: _core(x) & ~_STATUS(x, "pass")), "high_conflicts": n(lambda x: _HIGH(x) & _STATUS(x, "conflict")),
        "high_unknowns": n(GATES[6][0]), "significant_fails": n(GATES[5][0]), "human_review_rules": n(GATES[7][0]), "neutral_human_review_rules": n(lambda x: x["review"] & is_neutral(x)),
        "msp_indicator_pass": F.exists(r, msp_pass), "msp_unconfirmed_pass": F.exists(r, msp_vague), "msp_high_risk": F.exists(r, GATES[2][0]), "msp_conflict": F.exists(r, GATES[3][0]),
    }
    held = listed.withColumn("stats", F.struct(*(v.alias(k) for k, v in stats.items())))
    s = F.col("stats")
    gate = F.when(s["rules_total"] == 0, 1).when(s["core_total"] == 0, 2)
    for i, g in enumerate(GATES, 3):
        gate = gate.when(F.exists(r, g[0]), i)
    held = held.withColumn("gate", gate.when(s["msp_indicator_pass"], 12).otherwise(13))
    at = F.col("gate")
    sure = (s["core_passed"] == s["core_total"]) & (s["significant_fails"] == 0) & (s["high_conflicts"] == 0) & (s["high_unknowns"] == 0) & ~s["msp_high_risk"] & ~s["msp_conflict"] & ~s["msp_unconfirmed_pass"] & (s["human_review_rules"] == 0)
    scenario, reasons, blockers = F.when(at <= 2, "need_human_review"), F.when(at == 1, _general(fixed.REASON_NO_RULES)).when(at == 2, _general(fixed.REASON_NO_CORE)), None
    for i, (which, message, name, _) in enumerate(GATES, 3):
        scenario = scenario.when(at == i, name)
        reasons = reasons.when(at == i, _reasons(r, which, message))
        offending = F.filter(r, which)
        blockers = F.when(at == i, offending) if blockers is None else blockers.when(at == i, offending)
    scenario = scenario.when(at == 12, "relevant_dealer").otherwise("relevant_direct")
    vague = _reasons(r, msp_vague, fixed.REASON_MSP_UNCONFIRMED)
    reasons = reasons.when(at == 12, F.concat(vague, _reasons(r, msp_pass, fixed.REASON_MSP_PASS))).otherwise(F.concat(vague, _general(fixed.REASON_DIRECT)))
    blockers = blockers.otherwise(F.filter(r, lambda x: F.lit(False)))
    ids = F.transform(blockers, lambda x: x["out_id"])
    blockers = F.filter(blockers, lambda x, i: F.array_position(ids, x["out_id"]) == i + 1)  # the first of each id
    blocking = F.transform(blockers, lambda x: F.struct(x["out_id"].alias("rule_id"), x["criterion"].alias("criterion"), x["status"].alias("status"), x["risk"].alias("risk"), x["priority"].alias("priority"), x["comment"].alias("comment")))
    advice = F.create_map(*(F.lit(x) for k, v in fixed.RECOMMENDATIONS.items() for x in (k, v)))
    held = held.withColumn("scenario", scenario)
    confidence = F.when(at <= 2, "low").when(at <= 11, "medium").when(sure, "high").otherwise("medium")
    return held.select(key, "scenario", F.element_at(advice, F.col("scenario")).alias("recommendation"), confidence.alias("confidence"), ((at <= 11) & (at != 4)).alias("human_review_required"), "gate", reasons.alias("reasons"), blocking.alias("blocking_criteria"), "stats")
