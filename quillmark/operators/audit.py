"""Audit of marking codes: code comparison, business flags, last-wins results, the review queue, summaries, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import fixed
from quillmark.functions.text import WS, strip


def normalize_code(col: Column, ignore_case: bool = False) -> Column:
    """A code without symbology identifier, group separators (as characters or spelled out) and white space."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"\A\][A-Za-z]\d", "")
    out = F.translate(out, fixed.GS_CONTROLS, "")
    for text in fixed.GS_TEXTS:
        out = F.replace(out, F.lit(text), F.lit(""))
    out = F.regexp_replace(out, f"[{WS}]+", "")
    return F.upper(out) if ignore_case else out


def codes_match(reference: Column, decoded: Column, ignore_case: bool = False) -> Column:
    """Whether both are equal when normalised; a code that is empty then never matches."""
    own = normalize_code(decoded, ignore_case)
    return (own != "") & (normalize_code(reference, ignore_case) == own)


def looks_like_reference(col: Column) -> Column:
    own = normalize_code(col)
    return (F.length(own) == fixed.REFERENCE_LENGTH) & F.startswith(own, F.lit(fixed.REFERENCE_PREFIX))


def _present(col: Column) -> Column:
    return F.coalesce(strip(col) != "", F.lit(False))


def evaluate(facts: DataFrame, foil_unknown: str = "problem") -> DataFrame:
    """facts with flags ai, aj, ak, an ("1", "0" or ""), dmc_found, foil_status, ae_present, reasons, an_reasons and
    review_needed.

    facts have dmc_ref, decoded, code_matches, foil_removed, foil_checked, foil_error, foil_review_needed and
    af_present; the three-valued ones may be null, which means unknown.
    """
    if foil_unknown not in ("problem", "ok"):
        raise ValueError("foil_unknown must be problem or ok")
    flag = lambda cond: F.when(cond, "1").otherwise("")
    error = F.coalesce("foil_error", F.lit(""))
    unknown = (
        F.when(~F.coalesce("foil_checked", F.lit(False)), fixed.FOIL_SKIPPED)
        .when(F.startswith(error, F.lit("empty_url")), fixed.FOIL_NO_PHOTO)
        .when(F.startswith(error, F.lit("download_error")), fixed.FOIL_LOAD)
        .when(F.startswith(error, F.lit("litellm_error")) | (error == "bad_schema"), fixed.FOIL_MODEL)
        .otherwise(fixed.FOIL_UNSURE)
    )
    found = _present(F.col("decoded"))
    reference = _present(F.col("dmc_ref")) & (normalize_code(F.col("dmc_ref")) != "")
    out = facts.withColumns(
        {
            "dmc_found": found, "ae_present": reference, "af_present": F.coalesce("af_present", F.lit(False)),
            "foil_status": F.when(F.col("foil_removed"), fixed.FOIL_OFF).when(~F.col("foil_removed"), fixed.FOIL_ON).otherwise(unknown),
        }
    )
    mismatch = F.col("dmc_found") & F.col("ae_present") & F.coalesce(~F.col("code_matches"), F.lit(False))
    bad_foil = F.coalesce(~F.col("foil_removed"), F.lit(foil_unknown == "problem"))
    out = out.withColumns({"ai": flag(bad_foil), "aj": flag(~F.col("dmc_found")), "ak": flag(mismatch)})
    any_flag = F.concat("ai", "aj", "ak") != ""
    listed = lambda *pairs: F.array_compact(F.array(*(F.when(c, t) for c, t in pairs)))
    foil_reason = F.when(F.col("foil_removed").isNull(), F.concat(F.lit("фольга: "), F.col("foil_status"))).otherwise(fixed.REASON_AI)
    return out.withColumns(
        {
            "an": F.when(~F.col("af_present") | ~F.col("ae_present") | any_flag, "0").otherwise("1"),
            "reasons": listed((F.col("aj") == "1", F.lit(fixed.REASON_AJ)), (F.col("ak") == "1", F.lit(fixed.REASON_AK)), (F.col("ai") == "1", foil_reason)),
            "an_reasons": listed((~F.col("af_present"), F.lit(fixed.AN_NO_AF)), (~F.col("ae_present"), F.lit(fixed.AN_NO_AE)), (any_flag, F.lit(fixed.AN_FLAG))),
            "review_needed": F.coalesce("foil_review_needed", F.lit(False)) | (F.col("ak") == "1") | (F.col("aj") == "1"),
        }
    )


def last_wins(records: DataFrame, key: str = "row", order: str = "seq") -> DataFrame:
    """The record with the highest order of each key; a partial aggregate, so repeated keys shrink before they move."""
    rest = [c for c in records.columns if c not in (key, order)]
    best = records.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("r"))
    return best.select(*(F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in records.columns))


def review_queue(evaluated: DataFrame) -> DataFrame:
    """Rows that need human eyes, with the reason."""
    reason = F.when(F.col("ak") == "1", fixed.REVIEW_AK).when(F.col("aj") == "1", fixed.REVIEW_AJ).otherwise(fixed.REVIEW_FOIL)
    return evaluated.where("review_needed").withColumn("review_reason", reason)


def summary(evaluated: DataFrame) -> DataFrame:
    """One row of counts, integer percents and warnings about runs that look broken."""
    error = F.coalesce("decode_error", F.lit(""))
    counts = {
        "an1": F.col("an") == "1", "an0": F.col("an") == "0", "decoded": F.col("dmc_found"), "download_errors": F.contains(error, F.lit("download_error")),
        "empty_urls": error == "empty_url", "af_absent": ~F.col("af_present"), "foil_unknown": F.col("foil_removed").isNull() & F.coalesce("foil_checked", F.lit(False)),
    }
    one = evaluated.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    percent = {f"{k}_pct": F.when(F.col("n") > 0, F.expr(f"100 * {k} div n")) for k in counts}
    most = lambda k: (F.col(k) * 10 >= F.col("n") * 9) & (F.col("n") > 0)
    return one.withColumns(percent).withColumns({"warn_none_decoded": (F.col("decoded") == 0) & (F.col("n") > 0), "warn_downloads": most("download_errors"), "warn_empty_urls": most("empty_urls")})


def fill_rate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, total, sparse): sparse where a tenth of the rows or less has a value."""
    counts = rows.agg(F.count("*").alias("total"), *(F.count(F.nullif(strip(F.col(c).cast("string")), F.lit(""))).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns)))
    return counts.select("total", each.alias("x")).select("x.column", "x.filled", "total", (F.col("x.filled") * 10 <= F.col("total")).alias("sparse"))


def pending(rows: DataFrame, done: DataFrame, key: str = "row", foil_run: bool = False) -> DataFrame:
    """Rows not yet done. In a foil run, what was done without checking the foil counts as not done."""
    finished = done.where(F.coalesce("foil_checked", F.lit(False))) if foil_run else done
    return rows.join(finished.select(key).distinct(), key, "left_anti")


def within_budget(rows: DataFrame, budget: int, key: str = "row") -> DataFrame:
    """rows with in_budget: whether the row is among the first so many of all rows by key."""
    first = rows.select(key).orderBy(key).limit(budget).withColumn("in_budget", F.lit(True))
    return rows.join(first, key, "left").withColumn("in_budget", F.coalesce("in_budget", F.lit(False)))


def fallback_decode(primary: Column, primary_error: Column, second: Column, second_error: Column) -> tuple[Column, Column, Column]:
    """(decoded, source, error): the first photo's code, else the second's; the error keeps both causes."""
    source = F.when(primary.isNotNull(), "AG").when(second.isNotNull(), "AF")
    both = F.concat(F.lit("AG:"), F.coalesce(primary_error, F.lit("no_barcode_found")), F.lit("; AF:"), F.coalesce(second_error, F.lit("")))
    return F.coalesce(primary, second), source, F.when(source.isNull(), both)
