"""Keyword search over blocks: term matches, weighted scores, ranked evidence for each criterion.

Terms are a bounded array that every block is held against in one pass, without join or shuffle: a term can only
match where it is a substring of the normalised text, so that test comes first, and the boundary pattern runs on what
is left. Scores are exact decimals. Only ranking shuffles, after each partition's own best rows are picked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import normalize_search, phrase_position, snippet_at, tokens
from quillmark.sources.criteria import Criterion, build_terms

#: Terms that one search may have.
MOST_TERMS = 20_000
SNIPPET = 320
#: Columns that scoring and ranking add.
RESULTS = frozenset({"criterion_id", "score", "matched_terms", "match_reasons", "snippet", "rank"})


@dataclass(frozen=True)
class Search:
    """Ranked matches, counts for each key (folder and criterion), and all keys."""

    matches: DataFrame
    stats: DataFrame
    every: DataFrame


def _terms(criteria: list[Criterion]) -> Column:
    rows = [(c.criterion_id, t) for c in criteria for t in c.terms()]
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} search terms")
    one = lambda c, t: F.struct(
        F.lit(c).alias("c"), F.lit(t.position).alias("at"), F.lit(t.raw).alias("raw"), F.lit(t.normalized).alias("t"), F.lit(t.kind == "phrase").alias("phrase"),
        F.lit(t.phrase_weight).alias("pw"), F.lit(t.token_weight).alias("tw"), F.lit(t.substring_weight).alias("sw"), F.lit(t.generic).alias("generic"),
    )
    return F.array(*(one(c, t) for c, t in rows))


def score_blocks(blocks: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """(columns of blocks, criterion_id, score, matched_terms, match_reasons, snippet) for each block and criterion
    with a match in the text. blocks need text; section and file_name add their bonuses where they exist. A column of
    blocks that has the name of a result, or one that begins with two underscores, is an error."""
    keep = blocks.columns
    if taken := sorted(c for c in keep if c.lower() in RESULTS or c.startswith("__")):
        raise ValueError("rename these columns of blocks: " + ", ".join(taken))
    if not any(c.terms() for c in criteria):
        raise ValueError("Provide query or keywords")
    extra = {}
    for name in ("section", "file_name"):
        col = F.coalesce(F.col(name), F.lit("")) if name in keep else F.lit("")
        extra |= {f"__{name}": normalize_search(col), f"__{name}_tokens": tokens(normalize_search(col))}
    # no filter on what is computed here: pushed down, it would compute it again (so would explode's own filter)
    held = blocks.withColumn("__text", normalize_search(F.col("text"))).withColumns({"__tokens": tokens(F.col("__text")), **extra})
    held = held.withColumn("__hits", F.filter(_terms(criteria), lambda t: F.instr(F.col("__text"), t["t"]) > 0))

    bonus = lambda t, thousandths: F.when(t["generic"], F.lit(thousandths // 4)).otherwise(F.lit(thousandths))

    def scored(t: Column) -> Column:
        place = phrase_position(F.col("__text"), t["t"])
        token = F.array_contains("__tokens", t["t"])
        kind = F.when(t["phrase"], F.when(place >= 0, F.lit("phrase"))).when(token, F.lit("token")).when(F.length(t["t"]) >= 3, F.lit("substring"))
        base = F.when(t["phrase"], t["pw"]).when(token, t["tw"]).otherwise(t["sw"])
        in_section = F.when(t["phrase"], phrase_position(F.col("__section"), t["t"]) >= 0).otherwise(F.array_contains("__section_tokens", t["t"]))
        in_file = F.when(t["phrase"], phrase_position(F.col("__file_name"), t["t"]) >= 0).otherwise(F.array_contains("__file_name_tokens", t["t"]))
        meta = F.when(t["phrase"], F.lit("phrase")).otherwise(F.lit("token"))
        weight = base + F.when(in_section, F.when(t["phrase"], bonus(t, 1000)).otherwise(bonus(t, 500))).otherwise(0) + F.when(in_file, bonus(t, 500)).otherwise(0)
        reasons = F.concat(
            F.array(F.concat(kind, F.lit(":text"))),
            F.when(in_section, F.array(F.concat(meta, F.lit(":section")))).otherwise(F.array().cast("array<string>")),
            F.when(in_file, F.array(F.concat(meta, F.lit(":file_name")))).otherwise(F.array().cast("array<string>")),
        )
        seen = F.when(t["phrase"] | (place >= 0), place).otherwise(F.instr(F.col("__text"), t["t"]) - 1)
        return F.struct(t["c"].alias("c"), t["at"].alias("at"), t["raw"].alias("raw"), t["phrase"].alias("phrase"), kind.alias("kind"), weight.alias("weight"), reasons.alias("reasons"), seen.alias("seen"), F.length(t["t"]).alias("length"))

    held = held.withColumn("__hits", F.transform("__hits", scored))
    held = held.withColumn("criterion_id", F.explode_outer(F.array_distinct(F.transform(F.filter("__hits", lambda h: h["kind"].isNotNull()), lambda h: h["c"])))).where("criterion_id IS NOT NULL")
    held = held.withColumn("__own", F.filter("__hits", lambda h: h["c"] == F.col("criterion_id")))
    held = held.withColumn("__matched", F.filter("__own", lambda h: h["kind"].isNotNull()))
    shown = F.array_min(F.transform(F.filter("__own", lambda h: h["seen"] >= 0), lambda h: F.struct((~h["phrase"]).alias("token"), h["at"].alias("at"), h["seen"].alias("seen"), h["length"].alias("length"))))
    held = held.withColumn("__shown", shown)
    total = F.aggregate("__matched", F.lit(0), lambda s, h: s + h["weight"])
    return held.select(
        *keep, "criterion_id", (total.cast("decimal(12,3)") / F.lit(1000)).cast("decimal(12,3)").alias("score"),
        F.array_distinct(F.transform("__matched", lambda h: h["raw"])).alias("matched_terms"),
        F.flatten(F.transform("__matched", lambda h: h["reasons"])).alias("match_reasons"),
        snippet_at(F.col("__text"), F.col("__shown.seen"), F.col("__shown.length"), SNIPPET).alias("snippet"),
    )


def _order(columns: list[str]) -> list[Column]:
    """Blocks that aren't numbered stand in order of document and position, as their numbers would."""
    places = ("global_block_index", "document_index") if "global_block_index" in columns else ("doc_id", "position")
    names = ("file_name", "block_id")
    return [F.desc("score"), *(F.asc_nulls_last(c) for c in places if c in columns), *(F.coalesce(F.col(c), F.lit("")) for c in names if c in columns)]


def search_by_criteria(blocks: DataFrame, criteria: list[Criterion], top_k: int = 10, min_score: float = 1.0, key: str = "folder", folders: DataFrame | None = None) -> Search:
    """The best top_k blocks of each criterion and folder, with rank from 1, and (folder, criterion_id, matches_total,
    matches_returned) of every folder and criterion, those without a match included. Matches are ordered by score,
    then place in the folder, document, file name and block id. folders: a table whose key tells the folders without
    reading the blocks. Matches and counts are plans of their own, so whoever needs one doesn't pay for the other."""
    if top_k < 1:
        raise ValueError("top_k must be >= 1")
    if min_score < 0:
        raise ValueError("min_score must be >= 0")
    scored = score_blocks(blocks, criteria).where(F.col("score") >= F.lit(min_score))
    w = Window.partitionBy(key, "criterion_id").orderBy(*_order(scored.columns))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    counts = scored.groupBy(key, "criterion_id").agg(F.count("*").alias("n"))
    every = (folders or blocks).select(key).distinct().withColumn("criterion_id", F.explode(F.array(*(F.lit(c.criterion_id) for c in criteria))))
    total = F.coalesce("n", F.lit(0))
    stats = every.join(counts, [key, "criterion_id"], "left").select(key, "criterion_id", total.alias("matches_total"), F.least(total, F.lit(top_k).cast("long")).alias("matches_returned"))
    return Search(ranked, stats, every)


def search_blocks(blocks: DataFrame, query: str | None = None, keywords: list[str] | None = None, top_k: int = 20, min_score: float = 1.0, key: str = "folder", folders: DataFrame | None = None) -> Search:
    """The best top_k blocks of each folder for one query and its keywords."""
    if not build_terms(query, keywords):
        raise ValueError("Provide query or keywords")
    return search_by_criteria(blocks, [Criterion("query", "", query, tuple(keywords or ()), None, None)], top_k, min_score, key, folders)


def evidence(search: Search, key: str = "folder") -> DataFrame:
    """(folder, criterion_id, evidence): the ranked matches of every folder and criterion as an array, perhaps empty.
    An array holds top_k items at most."""
    item = F.struct("rank", F.col("score").cast("double").alias("score"), "snippet", F.lit(None).cast("string").alias("text"), F.col("text").alias("block_text"))
    listed = search.matches.groupBy(key, "criterion_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    empty = F.array().cast("array<struct<rank:int,score:double,snippet:string,text:string,block_text:string>>")
    return search.every.join(listed, [key, "criterion_id"], "left").withColumn("evidence", F.coalesce("evidence", empty))
