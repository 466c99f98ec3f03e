"""Rules: the status and risk of each criterion from its evidence.

Input rows hold id, priority and evidence, an array of (score, snippet, text, block_text); everything is an
expression over that array, so rules need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import fixed
from quillmark.functions.text import WS, blank_to_null, normalize_content, normalize_security, rx


def evidence_text(item: Column) -> Column:
    """Snippet, text and block text, those that aren't blank, joined."""
    return F.concat_ws(" ", *(blank_to_null(item[k]) for k in ("snippet", "text", "block_text")))


def is_confirming(item: Column) -> Column:
    """A score above zero, or, where there is none, any text. A score may be text; what isn't a number is none."""
    return F.coalesce(item["score"].cast("string").try_cast("double") > 0, evidence_text(item) != "")


def _spaced(col: Column) -> Column:
    """Every white space character as a space, so that patterns see them alike."""
    return F.regexp_replace(col, f"[{WS}]", " ")


def _not_auction(item: Column) -> Column:
    text = normalize_content(evidence_text(item))
    cleaned = text
    for p in fixed.NOT_A_METHOD:
        cleaned = F.regexp_replace(cleaned, rx(p), " ")
    cleaned = F.trim(F.regexp_replace(cleaned, " +", " "))
    return ~F.rlike(text, F.lit(rx(*fixed.TEMPLATE_TEXT))) & F.rlike(cleaned, F.lit(rx(*fixed.NON_AUCTION)))


def normalize_priority(col: Column) -> Column:
    text = F.coalesce(normalize_content(col), F.lit(""))
    out = F.when(text.isin(*fixed.PRIORITY_SYNONYMS["high"]), "high").when(text.isin(*fixed.PRIORITY_SYNONYMS["low"]), "low")
    return out.otherwise("medium")


def normalize_status(col: Column) -> Column:
    text = normalize_content(col)
    return F.when(text.isin(*fixed.STATUSES), text).otherwise("unknown")


def normalize_risk(col: Column) -> Column:
    text = normalize_content(col)
    return F.when(text.isin(*fixed.RISKS), text).otherwise("medium")


def _outcome(status: Column | str, risk: Column | str, review: Column | bool, comment: Column | str, concerns: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(status).alias("status"), lit(risk).alias("risk"), lit(review).alias("human_review_required"), lit(comment).alias("comment"), concerns.cast("array<string>").alias("evidence_concerns"))


def evaluate(rows: DataFrame, negative: str | None = None) -> DataFrame:
    """rows with priority normalised, and status, risk, human_review_required, comment, evidence_concerns and
    explicit_dealer_indicator.

    negative names an array column of normalised negative terms; without it no rule has any, as when only search
    results are at hand. A null id is criterion_unknown; null evidence counts as none.
    """
    items = F.coalesce(F.col("evidence"), F.array().cast(rows.schema["evidence"].dataType))
    some = lambda f: F.exists(items, f)
    none = F.array()
    rows = rows.withColumns({"id": F.coalesce(blank_to_null(F.col("id")), F.lit("criterion_unknown")), "priority": normalize_priority(F.col("priority"))})
    confirming = F.size(F.filter(items, is_confirming))
    dealer = some(lambda e: F.rlike(normalize_content(evidence_text(e)), F.lit("|".join(fixed.DEALER_TERMS))))
    against = F.lit(False)
    if negative:
        terms = F.coalesce(F.col(negative), F.array().cast("array<string>"))
        against = F.exists(terms, lambda t: F.exists(items, lambda e: F.contains(normalize_content(evidence_text(e)), t)))
    rows = rows.withColumns(
        {
            "__yes": confirming,
            "__no": against,
            "explicit_dealer_indicator": (F.col("id") == fixed.MSP) & (confirming > 0) & dealer,
            "__auctions": F.size(F.filter(items, lambda e: F.rlike(_spaced(evidence_text(e)), F.lit(rx(*fixed.AUCTION))))),
            "__other": some(_not_auction),
            "__weak": some(lambda e: F.rlike(normalize_content(evidence_text(e)), F.lit(rx(*fixed.WEAK_METHOD)))),
            "__free": some(lambda e: F.rlike(normalize_security(evidence_text(e)), F.lit(rx(*fixed.SECURITY_NEGATIVE)))),
            "__strong": some(lambda e: F.rlike(normalize_security(evidence_text(e)), F.lit(rx(*fixed.SECURITY_STRONG)))),
        }
    )
    yes, no, high, low = F.col("__yes") > 0, F.col("__no"), F.col("priority") == "high", F.col("priority") == "low"
    auction, other = F.col("__auctions") > 0, F.col("__other")
    passed = lambda n: F.format_string(fixed.COMMENT_PASS, n)
    method = (
        F.when(auction & other, _outcome("conflict", "high", True, fixed.COMMENT_METHOD_CONFLICT, F.array(F.lit("procurement_method_non_auction_evidence"), F.lit("procurement_method_conflicting_evidence"))))
        .when(other, _outcome("fail", "high", True, fixed.COMMENT_METHOD_FAIL, F.array(F.lit("procurement_method_non_auction_evidence"))))
        .when(auction, _outcome("pass", "low", False, passed(F.col("__auctions")), none))
        .otherwise(_outcome("unknown", "medium", True, fixed.COMMENT_METHOD_UNKNOWN, F.when(F.col("__weak"), F.array(F.lit("procurement_method_weak_evidence"))).otherwise(none.cast("array<string>"))))
    )
    vague = (F.col("id") == fixed.MSP) & yes & ~F.col("explicit_dealer_indicator")
    concerns = F.when(vague, F.array(F.lit("msp_indicator_not_explicit"))).otherwise(none.cast("array<string>"))
    says = lambda text: F.when(vague, F.lit(fixed.COMMENT_MSP)).otherwise(text)
    generic = (
        F.when(yes & no, _outcome("conflict", "high", True, says(F.lit(fixed.COMMENT_CONFLICT)), concerns))
        .when(no, _outcome("fail", "high", True, says(F.lit(fixed.COMMENT_FAIL)), concerns))
        .when(yes, _outcome("pass", F.when(vague & high, "medium").otherwise("low"), vague & high, says(passed(F.col("__yes"))), concerns))
        .otherwise(_outcome("unknown", F.when(low, "low").otherwise("medium"), ~low, says(F.lit(fixed.COMMENT_UNKNOWN)), concerns))
    )
    security = F.when(F.col("__strong"), _outcome("conflict", "high", True, fixed.COMMENT_SECURITY_CONFLICT, F.array(F.lit("security_requirement_conflicting_evidence")))).otherwise(_outcome("pass", "low", False, fixed.COMMENT_SECURITY_PASS, none))
    rows = rows.withColumn("__out", F.when(F.col("id") == fixed.PROCUREMENT, method).when((F.col("id") == fixed.SECURITY) & F.col("__free"), security).otherwise(generic))
    fields = ("status", "risk", "human_review_required", "comment", "evidence_concerns")
    return rows.withColumns({f: F.col(f"__out.{f}") for f in fields}).drop(*(c for c in rows.columns if c.startswith("__")))


def rule_stats(rules: DataFrame, *keys: str) -> DataFrame:
    """Counters of each key in one pass."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in fixed.STATUSES]
    counts += [F.count_if(F.col("risk") == r).alias(f"risk_{r}") for r in fixed.RISKS]
    return rules.groupBy(*keys).agg(F.count("*").alias("rules_count"), *counts, F.count_if("human_review_required").alias("human_review_required"))
