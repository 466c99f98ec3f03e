"""The queries over the driver's tables and their DuckDB SQL.

A folder is a source of documents, a block is a line of a text. The criteria are words of the tables' own language;
their ids are those that rules and gates know.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import audit, blocks, rules, scenario, search, shadow
from quillmark.plans import literals, oracles
from quillmark.run import rules_of
from quillmark.sources.criteria import Criterion, criteria_of
from quillmark.sources.html import html_blocks

CRITERIA = criteria_of(
    [
        {"id": "subject_okpd2_oil", "criterion": "of the", "priority": "high", "query": "of the", "keywords": ["that"]},
        {"id": "subject_title_oil", "criterion": "in the", "priority": "критичный", "query": "in the", "keywords": ["it"]},
        {"id": "purchase_type_goods", "criterion": "and", "priority": "high", "keywords": ["and", "to"]},
        {"id": "procurement_method", "criterion": "way", "priority": "medium", "query": "on the"},
        {"id": "msp_restriction", "criterion": "de la", "priority": "high", "query": "de la", "keywords": ["que", "les"]},
        {"id": "security_requirement", "criterion": "von der", "priority": "high", "query": "von der", "keywords": ["mit"]},
        {"id": "oil_purpose", "criterion": "zzz never there", "priority": "low", "query": "zzz never there"},
        {"criterion": "the and", "priority": "средний", "query": "the and", "keywords": "stupid, idiot"},
    ]
)
TOP_K, MIN_SCORE = 5, 1.0
QUERY, KEYWORDS = "of the with", ["that", "thing", "st"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks_of_documents(_table(spark, sf_dir, "documents")).withColumn("file_name", F.col("folder"))


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("folder"))


def blocks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks_of_documents(_table(spark, sf_dir, "documents")).select("folder", "doc_id", "position", "block_id", "text")


def blocks_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return blocks.number_blocks(blocks.blocks_of_documents(docs), docs).select("folder", "doc_id", "position", "document_index", "document_id", "global_block_index", "global_block_id")


def documents_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = blocks.blocks_of_documents(_table(spark, sf_dir, "documents"))
    return blocks.full_text(split, ["doc_id"], "position").select("doc_id", F.length("full_text").cast("long").alias("n_chars"), F.md5("full_text").alias("full_text_md5"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(tx.normalize_search(F.col("text"))).alias("search_md5"), F.md5(tx.normalize_content(F.col("text"))).alias("content_md5"), F.md5(tx.normalize_security(F.col("text"))).alias("security_md5"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.explode(tx.tokens(tx.normalize_search(F.col("text")))).alias("token"))
    return docs.groupBy("token").agg(F.count("*").alias("n"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c.criterion_id, t.position, t.raw, t.normalized, t.kind, t.phrase_weight, t.token_weight, t.substring_weight) for c in CRITERIA for t in c.terms()]
    return spark.createDataFrame(rows, "criterion_id string, term_pos int, raw string, normalized string, kind string, phrase_weight int, token_weight int, substring_weight int")


def _shown(matches: DataFrame) -> DataFrame:
    return matches.select("folder", "criterion_id", F.col("rank").cast("long").alias("rank"), "doc_id", "block_id", F.col("score").cast("double").alias("score"), F.array_join("matched_terms", "|").alias("matched_terms"), F.array_join("match_reasons", "|").alias("match_reasons"), "snippet")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search_blocks(_blocks(spark, sf_dir), QUERY, KEYWORDS, top_k=20, min_score=1.0, folders=_folders(spark, sf_dir)).matches).drop("criterion_id")


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_blocks(_blocks(spark, sf_dir), QUERY, KEYWORDS, top_k=20, min_score=3.0, folders=_folders(spark, sf_dir)).stats.drop("criterion_id")


def _search(spark: SparkSession, sf_dir: str) -> search.Search:
    return search.search_by_criteria(_blocks(spark, sf_dir), CRITERIA, TOP_K, MIN_SCORE, folders=_folders(spark, sf_dir))


def criteria_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_search(spark, sf_dir).matches)


def criteria_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).stats


def criteria_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).stats.groupBy("folder").agg(F.count_if(F.col("matches_total") > 0).alias("criteria_with_matches"), F.sum("matches_returned").alias("matches_returned"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_of(spark, _search(spark, sf_dir), CRITERIA)


def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("folder", "id", "priority", "status", "risk", "human_review_required", "comment", F.array_join("evidence_concerns", "|").alias("evidence_concerns"), "explicit_dealer_indicator")


def rule_stats_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_stats(_rules(spark, sf_dir), "folder")


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.classify(_rules(spark, sf_dir))


def scenario_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _scenarios(spark, sf_dir)
    return held.select("folder", "scenario", "confidence", "human_review_required", F.size("blocking_criteria").cast("long").alias("n_blocking"), "stats.rules_total", "stats.core_passed", "stats.core_total", "stats.high_unknowns", "stats.human_review_rules", "stats.msp_unconfirmed_pass")


def scenario_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenarios(spark, sf_dir).select("folder", F.explode("reasons").alias("r")).select("folder", "r.rule_id", "r.message", "r.status")


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = blocks.blocks_of_documents(_table(spark, sf_dir, "documents")).drop("section")
    carried = blocks.carry_section(split, F.length("text") <= 120, ["folder", "doc_id"], "position")
    return carried.select("doc_id", "position", F.md5("section").alias("section_md5"))


def docs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "docx").when(F.col("lang") == "fr", "html").when(F.col("lang") == "de", "xlsx").otherwise("txt").alias("source_type"))
    return blocks.count_by_type(kinds, ("docx", "html", "xlsx", "pdf", "txt"))


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "source")
    done = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"), (F.col("quality") == 1).alias("foil_checked"))
    return audit.pending(todo, done, "row", foil_run=True)


def foil_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.within_budget(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row")), 100)


#: Audit facts from orders, in SQL that both engines read.
FACTS_SQL = """
SELECT o_orderkey AS row,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat('00000046', o_custkey, 'l_?hz=', o_orderkey) END AS dmc_ref,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat(']d200000046', o_custkey, '<GS>l_? hz=', o_orderkey) WHEN o_orderkey % 3 = 0 THEN 'other' ELSE concat('00000046', o_custkey, 'l_?hz=', o_orderkey) END AS decoded,
       CASE WHEN o_orderkey % 4 = 0 THEN TRUE WHEN o_orderkey % 4 = 1 THEN FALSE ELSE NULL END AS foil_removed,
       o_orderkey % 6 <> 0 AS foil_checked,
       CASE o_orderkey % 9 WHEN 0 THEN 'empty_url' WHEN 1 THEN 'download_error: 404' WHEN 2 THEN 'bad_schema' ELSE NULL END AS foil_error,
       o_orderkey % 17 = 0 AS foil_review_needed,
       o_orderkey % 10 <> 0 AS af_present,
       CASE o_orderkey % 8 WHEN 0 THEN 'download_error: timeout' WHEN 1 THEN 'empty_url' ELSE NULL END AS decode_error
FROM orders
"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.sql(FACTS_SQL.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))
    match = F.when(F.col("decoded").isNotNull() & F.col("dmc_ref").isNotNull(), audit.codes_match(F.col("dmc_ref"), F.col("decoded")))
    return facts.withColumn("code_matches", match)


def audit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("row", audit.normalize_code(F.col("decoded")).alias("code"), audit.looks_like_reference(F.col("dmc_ref")).alias("looks_right"), "code_matches")


def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = audit.evaluate(_facts(spark, sf_dir))
    return done.select("row", "ai", "aj", "ak", "an", "foil_status", F.array_join("reasons", "|").alias("reasons"), F.array_join("an_reasons", "|").alias("an_reasons"), "review_needed")


def audit_flags_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.evaluate(_facts(spark, sf_dir), "ok").groupBy("ai", "aj", "ak", "an").agg(F.count("*").alias("n"))


def audit_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_id").alias("seq"), "event_type", "value")
    return audit.last_wins(records)


def audit_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.review_queue(audit.evaluate(_facts(spark, sf_dir))).select("row", "review_reason")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.evaluate(_facts(spark, sf_dir)))


def audit_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fill_rate(_facts(spark, sf_dir), ["dmc_ref", "decoded", "foil_error"])


def guardrail_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = blocks.blocks_of_documents(_table(spark, sf_dir, "documents"))
    return split.select("doc_id", "position", shadow.near(F.lower("text"), "the", "that").alias("near"))


def llm_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.evidence(_search(spark, sf_dir))
    held = found.select("folder", "criterion_id", F.posexplode(shadow.payload(F.col("evidence"))).alias("place", "p"))
    return held.select("folder", "criterion_id", "place", "p.llm_evidence_id", "p.text", "p.score")


def pages_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    return html_blocks(pages).select("doc_id", "position", "block_id", "block_type", "section", F.md5("text").alias("text_md5"))


_QUERIES = (
    blocks_split, blocks_numbered, documents_full_text, normalize_text, tokenize, search_terms, search_topk, search_stats, criteria_topk, criteria_stats, criteria_summary, rule_status,
    rule_stats_by_folder, scenario_by_folder, scenario_reasons, section_carry_forward, docs_by_type, resume_anti_join, foil_budget, audit_normalize, audit_flags,
    audit_flags_lenient, audit_last_wins, audit_review, audit_summary, audit_fill_rate, guardrail_proximity, llm_payload, pages_blocks,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | literals.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.build(CRITERIA, QUERY, KEYWORDS, TOP_K, MIN_SCORE, FACTS_SQL) | literals.oracle_sql()


__all__ = ["CRITERIA", "Criterion", "oracle_sql", "queries"]
