"""DuckDB SQL of the catalog's queries, composed from shared parts."""

from __future__ import annotations

from quillmark.functions import fixed
from quillmark.functions.text import WS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _strip_end(x: str) -> str:
    return rf"regexp_replace({x}, '[{WS}]+$', '')"


_FROM = _quoted("ё" + fixed.DASHES + fixed.PUNCTUATION)
_TO = _quoted("е" + "-" * len(fixed.DASHES) + " " * len(fixed.PUNCTUATION))


def _search(x: str) -> str:
    return _collapse(f"translate(lower({x}), {_FROM}, {_TO})")


def _content(x: str) -> str:
    return _collapse(f"translate(lower({x}), 'ё', 'е')")


TOKEN = r"[a-zа-я0-9]+(?:[.\-/][a-zа-я0-9]+)*"

BLOCKS = f"""
lines AS (
  SELECT source AS folder, doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS line
  FROM documents),
blocks AS (
  SELECT folder, doc_id, row_number() OVER (PARTITION BY folder, doc_id ORDER BY line) AS position, text
  FROM (SELECT folder, doc_id, line, {_collapse("raw")} AS text FROM lines) WHERE text <> '')"""

NUMBERED = f"""{BLOCKS},
numbered AS (
  SELECT folder, doc_id, position, text, dense_rank() OVER (PARTITION BY folder ORDER BY doc_id) AS document_index,
         row_number() OVER (PARTITION BY folder ORDER BY doc_id, position) AS global_block_index
  FROM blocks)"""


def _terms(rows: list[tuple]) -> str:
    """criterion, term: VALUES of (c, pos, raw, t, kind, pw, tw, sw, generic)."""
    values = ", ".join(f"({_quoted(c)}, {t.position}, {_quoted(t.raw)}, {_quoted(t.normalized)}, '{t.kind}', {t.phrase_weight}, {t.token_weight}, {t.substring_weight}, {t.generic})" for c, t in rows)
    return f"terms(c, pos, raw, t, kind, pw, tw, sw, generic) AS (VALUES {values})"


def _list(words) -> str:
    return "[" + ", ".join(_quoted(w) for w in sorted(words)) + "]"


def _search_terms(criteria: list) -> str:
    """Terms and weights from the criteria's own words: a query is a phrase, then its useful tokens; then the keywords."""
    words = [(c.criterion_id, 0, 0, c.query) for c in criteria if c.query] + [(c.criterion_id, 1, i, k) for c in criteria for i, k in enumerate(c.keywords)]
    values = ", ".join(f"({_quoted(c)}, {part}, {i}, {_quoted(w)})" for c, part, i, w in words)
    generic, low = _list(fixed.GENERIC_TERMS), _list(fixed.LOW_BOOST_PHRASES)
    return f"""
WITH said(c, part, i, raw) AS (VALUES {values}),
n AS (SELECT *, {_search("raw")} AS t FROM said),
tokens AS (SELECT c, unnest(regexp_extract_all(t, '{TOKEN}')) AS t, generate_subscripts(regexp_extract_all(t, '{TOKEN}'), 1) AS i FROM n WHERE part = 0),
wanted AS (
  SELECT c, 0 AS part, 0 AS i, raw, t, 'phrase' AS kind FROM n WHERE part = 0
  UNION ALL SELECT c, 0, i, t, t, 'token' FROM tokens WHERE NOT list_contains({_list(fixed.STOPWORDS)}, t) AND NOT regexp_full_match(t, '[0-9]+') AND (length(t) >= 3 OR list_contains({_list(fixed.SHORT_TOKENS)}, t))
  UNION ALL SELECT c, 1, i, raw, t, CASE WHEN contains(t, ' ') THEN 'phrase' ELSE 'token' END FROM n WHERE part = 1),
first AS (SELECT *, row_number() OVER (PARTITION BY c, kind, t ORDER BY part, i) AS k FROM wanted WHERE t <> ''),
told AS (
  SELECT *, regexp_extract_all(t, '{TOKEN}') AS w, list_contains({generic}, t) OR (len(regexp_extract_all(t, '{TOKEN}')) = 1 AND list_contains({generic}, regexp_extract_all(t, '{TOKEN}')[1])) AS common
  FROM first WHERE k = 1)
SELECT c AS criterion_id, (row_number() OVER (PARTITION BY c ORDER BY part, i) - 1)::INTEGER AS term_pos, raw, t AS normalized, kind,
       CASE WHEN common THEN 1000 WHEN len(w) < 2 THEN 4000 WHEN list_contains({low}, t) OR len(list_filter(w, lambda x: NOT list_contains({generic}, x))) = 0 THEN 3000 ELSE 8000 + 1000 * least(len(w) - 2, 2) END::INTEGER AS phrase_weight,
       CASE WHEN common THEN 400 ELSE 1200 END AS token_weight, CASE WHEN common THEN 200 ELSE 500 END AS substring_weight
FROM told"""


def _matching(rows: list[tuple]) -> str:
    """Matches, scored and shown, of blocks against terms that hold letters, digits and spaces only."""
    edge = lambda x, t: rf"regexp_matches({x}, '(^|[^a-zа-я0-9])' || {t} || '([^a-zа-я0-9]|$)')"
    # where the phrase begins: what comes before its first whole occurrence
    place = r"length(regexp_extract(n, '^(.*?(?:^|[^a-zа-я0-9]))' || t || '(?:[^a-zа-я0-9]|$)', 1, 's'))"
    return f"""{_terms(rows)},
norm AS (SELECT *, {_search("text")} AS n, {_search("folder")} AS f FROM numbered),
toks AS (SELECT *, regexp_extract_all(n, '{TOKEN}') AS nt, regexp_extract_all(f, '{TOKEN}') AS ft FROM norm),
pairs AS (SELECT *, {edge("n", "t")} AS whole FROM toks JOIN terms ON contains(n, t)),
hits AS (
  SELECT *, CASE WHEN kind = 'phrase' THEN CASE WHEN whole THEN 'phrase' END WHEN list_contains(nt, t) THEN 'token' WHEN length(t) >= 3 THEN 'substring' END AS hit,
         CASE WHEN whole THEN {place} WHEN kind = 'token' THEN instr(n, t) - 1 END AS seen,
         CASE WHEN kind = 'phrase' THEN {edge("f", "t")} ELSE list_contains(ft, t) END AS in_file
  FROM pairs),
weighed AS (
  SELECT *, CASE hit WHEN 'phrase' THEN pw WHEN 'token' THEN tw WHEN 'substring' THEN sw ELSE 0 END + CASE WHEN hit IS NOT NULL AND in_file THEN CASE WHEN generic THEN 125 ELSE 500 END ELSE 0 END AS w
  FROM hits),
scored AS (
  SELECT folder, c AS criterion_id, doc_id, position, document_index, global_block_index, any_value(text) AS text, any_value(n) AS n, sum(w) / 1000.0 AS score,
         list(raw ORDER BY pos) FILTER (hit IS NOT NULL) AS raws,
         string_agg(hit || ':text' || CASE WHEN in_file THEN '|' || kind || ':file_name' ELSE '' END, '|' ORDER BY pos) FILTER (hit IS NOT NULL) AS match_reasons,
         arg_min(struct_pack(seen := seen, size := length(t)), CASE kind WHEN 'phrase' THEN 0 ELSE 1000000 END + pos) FILTER (seen IS NOT NULL) AS shown
  FROM weighed GROUP BY ALL HAVING count(hit) > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY folder, criterion_id ORDER BY score DESC, global_block_index) AS rank,
         {_collapse("substr(n, greatest(shown.seen - 160, 0) + 1, shown.seen + shown.size + 160 - greatest(shown.seen - 160, 0))")} AS cut
  FROM scored WHERE score >= min_score),
matches AS (
  SELECT *, CASE WHEN length(cut) <= 320 THEN cut ELSE rtrim(substr(cut, 1, 317), ' ') || '...' END AS snippet,
         list_aggregate(list_filter(raws, lambda x, i: list_position(raws, x) = i), 'string_agg', '|') AS matched_terms
  FROM ranked WHERE rank <= top_k)"""


def _with(rows: list[tuple], min_score: float, top_k: int) -> str:
    return "WITH " + NUMBERED + ",\n" + _matching(rows).replace("min_score", str(min_score)).replace("rank <= top_k", f"rank <= {top_k}")


SHOWN = "folder, criterion_id, rank, doc_id, printf('p%06d', position) AS block_id, score::DOUBLE AS score, matched_terms, match_reasons, snippet"


def _stats(rows: list[tuple], ids: list[str], min_score: float, top_k: int) -> str:
    every = ", ".join(f"({_quoted(c)})" for c in ids)
    return f"""{_with(rows, min_score, top_k)},
counted AS (SELECT folder, criterion_id, count(*) AS n FROM ranked GROUP BY ALL),
stats AS (
  SELECT f.folder, e.c AS criterion_id, coalesce(n, 0) AS matches_total, least(coalesce(n, 0), {top_k}) AS matches_returned
  FROM (SELECT DISTINCT folder FROM blocks) f CROSS JOIN (VALUES {every}) e(c) LEFT JOIN counted ON counted.folder = f.folder AND counted.criterion_id = e.c)"""


def _rules(rows: list[tuple], told: list[tuple[str, str]], min_score: float, top_k: int) -> str:
    """Rules of search results: no negatives, and no evidence in the language of the special patterns, but for the
    texts' own words; special rules look at their texts."""
    values = ", ".join(f"({i}, {_quoted(c)}, '{p}')" for i, (c, p) in enumerate(told, 1))
    dealer = " OR ".join(f"contains({_content('snippet || chr(32) || text')}, {_quoted(t)})" for t in ("мсп", "смп", "дилер", "партнер", "партнёр", "малого и среднего предпринимательства"))
    return f"""{_stats(rows, [c for c, _ in told], min_score, top_k)},
told(rule_index, id, priority) AS (VALUES {values}),
dealers AS (SELECT folder, criterion_id, bool_or({dealer}) AS dealer FROM matches GROUP BY ALL),
based AS (
  SELECT s.folder, t.rule_index, t.id, t.priority, s.matches_returned AS yes, coalesce(d.dealer, FALSE) AND t.id = 'msp_restriction' AS explicit_dealer_indicator
  FROM stats s JOIN told t ON s.criterion_id = t.id LEFT JOIN dealers d ON d.folder = s.folder AND d.criterion_id = s.criterion_id),
rules AS (
  SELECT *, CASE WHEN id = 'procurement_method' OR yes = 0 THEN 'unknown' ELSE 'pass' END AS status,
         CASE WHEN id = 'procurement_method' THEN 'medium' WHEN yes = 0 THEN CASE priority WHEN 'low' THEN 'low' ELSE 'medium' END
              WHEN id = 'msp_restriction' AND NOT explicit_dealer_indicator AND priority = 'high' THEN 'medium' ELSE 'low' END AS risk,
         CASE WHEN id = 'procurement_method' THEN TRUE WHEN yes = 0 THEN priority <> 'low' ELSE id = 'msp_restriction' AND NOT explicit_dealer_indicator AND priority = 'high' END AS human_review_required,
         CASE WHEN id = 'procurement_method' THEN {_quoted(fixed.COMMENT_METHOD_UNKNOWN)} WHEN yes = 0 THEN {_quoted(fixed.COMMENT_UNKNOWN)}
              WHEN id = 'msp_restriction' AND NOT explicit_dealer_indicator THEN {_quoted(fixed.COMMENT_MSP)} ELSE {_quoted(fixed.COMMENT_PASS)}.replace('%d', yes::VARCHAR) END AS comment,
         CASE WHEN id = 'msp_restriction' AND yes > 0 AND NOT explicit_dealer_indicator THEN 'msp_indicator_not_explicit' ELSE '' END AS evidence_concerns
  FROM based)"""


def _scenario(base: str) -> str:
    core = "id IN ('subject_okpd2_oil', 'subject_title_oil', 'purchase_type_goods')"
    neutral = "(risk <> 'high' AND ((id = 'msp_restriction' AND (status IN ('fail', 'unknown') OR (status = 'pass' AND NOT explicit_dealer_indicator))) OR (priority = 'low' AND status = 'unknown')))"
    unknown = "(id <> 'msp_restriction' AND priority = 'high' AND status = 'unknown')"
    vague = "(id = 'msp_restriction' AND status = 'pass' AND NOT explicit_dealer_indicator)"
    sure = "(id = 'msp_restriction' AND status = 'pass' AND explicit_dealer_indicator)"
    return f"""{base},
gates AS (
  SELECT folder, count(*) AS rules_total, count(*) FILTER ({core} AND status = 'pass') AS core_passed, count(*) FILTER ({core}) AS core_total,
         count(*) FILTER ({unknown}) AS high_unknowns, count(*) FILTER (human_review_required AND NOT {neutral}) AS human_review_rules,
         coalesce(bool_or({vague}), FALSE) AS msp_unconfirmed_pass, coalesce(bool_or({sure}), FALSE) AS dealer
  FROM rules GROUP BY folder),
gated AS (
  SELECT *, CASE WHEN high_unknowns > 0 THEN 9 WHEN human_review_rules > 0 THEN 10 WHEN core_passed < core_total THEN 11 WHEN dealer THEN 12 ELSE 13 END AS gate FROM gates),
offending AS (
  SELECT r.*, g.gate FROM rules r JOIN gated g USING (folder)
  WHERE (gate = 9 AND {unknown}) OR (gate = 10 AND human_review_required AND NOT {neutral}) OR (gate = 11 AND {core} AND status <> 'pass'))"""


def _pages() -> str:
    """Blocks of pages without tables, by a machine over their tags: a stack of open blocks, and text beside them."""
    pieces = "<!--.*?-->|<(?:script|style|noscript)\\b.*?</(?:script|style|noscript)\\s*>|<[!/a-zA-Z][^>]*>|[^<]+|<"
    text = "t"
    for entity, sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, {_quoted(entity)}, {_quoted(sign)})"
    blocks = "('p', 'div', 'li', 'section', 'article', 'header', 'footer', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')"
    pair = "STRUCT(tag VARCHAR, txt VARCHAR)"
    return f"""
WITH RECURSIVE toks AS (SELECT page_id, regexp_extract_all(html, {_quoted("(?s)" + pieces)}) AS ts FROM pages),
run AS (
  SELECT page_id, 1 AS k, []::{pair}[] AS open, '' AS loose, []::{pair}[] AS done FROM toks
  UNION ALL
  SELECT page_id, k + 1,
         CASE WHEN last > 0 THEN open[1:last - 1] WHEN begins THEN list_append(open, {{'tag': name, 'txt': ''}})
              WHEN said IS NOT NULL AND len(open) > 0 THEN list_append(open[1:len(open) - 1], {{'tag': open[len(open)].tag, 'txt': open[len(open)].txt || said}}) ELSE open END,
         CASE WHEN begins THEN '' WHEN said IS NOT NULL AND len(open) = 0 THEN loose || said ELSE loose END,
         CASE WHEN last > 0 THEN list_concat(done, list_reverse(open[last:len(open)])) WHEN begins THEN list_append(done, {{'tag': NULL, 'txt': loose}}) ELSE done END
  FROM (
    SELECT *, CASE WHEN t LIKE '</%' THEN coalesce(list_max(list_filter(range(1, len(open) + 1), lambda i: open[i].tag = name)), 0) ELSE 0 END AS last,
           t NOT LIKE '</%' AND name IN {blocks} AS begins, CASE WHEN t NOT LIKE '<%' OR t = '<' THEN {text} WHEN name = 'br' THEN ' ' END AS said
    FROM (SELECT run.*, toks.ts[k] AS t, lower(regexp_extract(toks.ts[k], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM run JOIN toks USING (page_id) WHERE k <= len(toks.ts)) x) y),
ended AS (SELECT page_id, list_append(list_concat(done, list_reverse(open)), {{'tag': NULL, 'txt': loose}}) AS done FROM run JOIN toks USING (page_id) WHERE k = len(ts) + 1),
listed AS (SELECT page_id, unnest(done) AS d, generate_subscripts(done, 1) AS i FROM ended),
kept AS (SELECT page_id, i, d.tag AS tag, {_collapse("d.txt")} AS text FROM listed),
numbered AS (SELECT page_id, tag, text, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position FROM kept WHERE text <> '')
SELECT page_id AS doc_id, position::INTEGER AS position, printf('p%06d', position) AS block_id, 'paragraph' AS block_type,
       last_value(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS section, md5(text) AS text_md5
FROM numbered"""


def build(criteria: list, query: str, keywords: list[str], top_k: int, min_score: float, facts: str) -> dict[str, str]:
    """SQL of every query, for these criteria."""
    from quillmark.sources.criteria import build_terms

    rows = [(c.criterion_id, t) for c in criteria for t in c.terms()]
    single = [("query", t) for t in build_terms(query, keywords)]
    priority = {"критичный": "high", "средний": "medium"}
    told = [(c.criterion_id, priority.get(c.priority, c.priority)) for c in criteria]
    ids = [c for c, _ in told]
    ruled = _rules(rows, told, min_score, top_k)
    gated = _scenario(ruled)
    code = "coalesce(decoded, '')"
    clean = lambda x: "regexp_replace(" + "replace(" * 5 + rf"translate(regexp_replace({x}, '^\][A-Za-z]\d', ''), chr(29) || chr(30) || chr(4), '')" + "".join(f", {_quoted(t)}, '')" for t in fixed.GS_TEXTS) + f", '[{WS}]+', '', 'g')"
    present = lambda x: f"coalesce({_strip(x)} <> '', FALSE)"
    facts = f"""
WITH facts AS ({facts}),
matched AS (
  SELECT *, CASE WHEN decoded IS NOT NULL AND dmc_ref IS NOT NULL THEN {clean(code)} <> '' AND {clean("coalesce(dmc_ref, '')")} = {clean(code)} END AS code_matches FROM facts),
flags AS (
  SELECT *, {present("decoded")} AS dmc_found, {present("dmc_ref")} AS ae_present,
         CASE WHEN foil_removed THEN {_quoted(fixed.FOIL_OFF)} WHEN NOT foil_removed THEN {_quoted(fixed.FOIL_ON)} WHEN NOT foil_checked THEN {_quoted(fixed.FOIL_SKIPPED)}
              WHEN foil_error LIKE 'empty_url%' THEN {_quoted(fixed.FOIL_NO_PHOTO)} WHEN foil_error LIKE 'download_error%' THEN {_quoted(fixed.FOIL_LOAD)}
              WHEN foil_error LIKE 'litellm_error%' OR foil_error = 'bad_schema' THEN {_quoted(fixed.FOIL_MODEL)} ELSE {_quoted(fixed.FOIL_UNSURE)} END AS foil_status
  FROM matched),
flagged AS (
  SELECT *, CASE WHEN foil_removed THEN '' WHEN foil_removed IS NULL AND policy = 'ok' THEN '' ELSE '1' END AS ai, CASE WHEN dmc_found THEN '' ELSE '1' END AS aj,
         CASE WHEN dmc_found AND ae_present AND code_matches = FALSE THEN '1' ELSE '' END AS ak
  FROM flags CROSS JOIN (SELECT 'problem' AS policy)),
done AS (
  SELECT *, CASE WHEN NOT af_present OR NOT ae_present OR ai || aj || ak <> '' THEN '0' ELSE '1' END AS an, foil_review_needed OR ak = '1' OR aj = '1' AS review_needed FROM flagged)"""
    pct = lambda k: f"(100 * {k} // n)::BIGINT AS {k}_pct"
    counts = ("an1", "an0", "decoded", "download_errors", "empty_urls", "af_absent", "foil_unknown")
    near = "contains(x, 'the') AND contains(x, 'that') AND CASE WHEN regexp_matches(x, '[.!?;]') THEN len(list_filter(regexp_split_to_array(x, '[.!?;]+'), lambda s: contains(s, 'the') AND contains(s, 'that'))) > 0 ELSE regexp_matches(x, 'the.{0,47}that|that.{0,46}the|thathe') END"
    return {
        "blocks_split": f"WITH {BLOCKS} SELECT folder, doc_id, position, printf('p%06d', position) AS block_id, text FROM blocks",
        "blocks_numbered": f"WITH {NUMBERED} SELECT folder, doc_id, position, document_index, printf('d%06d', document_index) AS document_id, global_block_index, printf('b%06d', global_block_index) AS global_block_id FROM numbered",
        "documents_full_text": f"WITH {BLOCKS}, t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY position) AS t FROM blocks GROUP BY doc_id) SELECT doc_id, length(t) AS n_chars, md5(t) AS full_text_md5 FROM t",
        "normalize_text": f"SELECT doc_id, md5({_search('text')}) AS search_md5, md5({_content('text')}) AS content_md5, md5({_collapse('replace(' + _content('text') + ', ' + _quoted('|') + ', ' + _quoted(' ') + ')')}) AS security_md5 FROM documents",
        "tokenize": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_search('text')}, '{TOKEN}')) AS token FROM documents) GROUP BY token",
        "search_terms": _search_terms(criteria),
        "pages_blocks": _pages(),
        "search_topk": f"{_with(single, 1.0, 20)} SELECT {SHOWN.replace('criterion_id, ', '')} FROM matches",
        "search_stats": f"{_stats(single, ['query'], 3.0, 20)} SELECT folder, matches_total, matches_returned FROM stats",
        "criteria_topk": f"{_with(rows, min_score, top_k)} SELECT {SHOWN} FROM matches",
        "criteria_stats": f"{_stats(rows, ids, min_score, top_k)} SELECT * FROM stats",
        "criteria_summary": f"{_stats(rows, ids, min_score, top_k)} SELECT folder, count(*) FILTER (matches_total > 0) AS criteria_with_matches, sum(matches_returned)::BIGINT AS matches_returned FROM stats GROUP BY folder",
        "rule_status": f"{ruled} SELECT folder, id, priority, status, risk, human_review_required, comment, evidence_concerns, explicit_dealer_indicator FROM rules",
        "rule_stats_by_folder": f"{ruled} SELECT folder, count(*) AS rules_count, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in fixed.STATUSES) + ", " + ", ".join(f"count(*) FILTER (risk = '{r}') AS risk_{r}" for r in fixed.RISKS) + ", count(*) FILTER (human_review_required) AS human_review_required FROM rules GROUP BY folder",
        "scenario_by_folder": f"{gated} SELECT g.folder, CASE WHEN gate <= 11 THEN 'need_human_review' WHEN gate = 12 THEN 'relevant_dealer' ELSE 'relevant_direct' END AS scenario, CASE WHEN gate >= 12 AND NOT msp_unconfirmed_pass THEN 'high' ELSE 'medium' END AS confidence, gate <= 11 AS human_review_required, (SELECT count(*) FROM offending o WHERE o.folder = g.folder) AS n_blocking, rules_total, core_passed, core_total, high_unknowns, human_review_rules, msp_unconfirmed_pass FROM gated g",
        "scenario_reasons": f"{gated} SELECT folder, id AS rule_id, CASE gate WHEN 9 THEN {_quoted(fixed.REASON_HIGH_UNKNOWN)} WHEN 10 THEN {_quoted(fixed.REASON_REVIEW)} ELSE {_quoted(fixed.REASON_CORE_NOT_PASS)} END AS message, status FROM offending"
        f" UNION ALL SELECT r.folder, id, {_quoted(fixed.REASON_MSP_UNCONFIRMED)}, status FROM rules r JOIN gated g USING (folder) WHERE gate >= 12 AND id = 'msp_restriction' AND status = 'pass' AND NOT explicit_dealer_indicator"
        f" UNION ALL SELECT r.folder, id, {_quoted(fixed.REASON_MSP_PASS)}, status FROM rules r JOIN gated g USING (folder) WHERE gate = 12 AND id = 'msp_restriction' AND status = 'pass' AND explicit_dealer_indicator"
        f" UNION ALL SELECT folder, NULL, {_quoted(fixed.REASON_DIRECT)}, NULL FROM gated WHERE gate = 13",
        "section_carry_forward": f"WITH {BLOCKS} SELECT doc_id, position, md5(last_value(CASE WHEN length(text) <= 120 THEN text END IGNORE NULLS) OVER (PARTITION BY folder, doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)) AS section_md5 FROM blocks",
        "docs_by_type": "SELECT t.k AS source_type, count(d.k) AS documents FROM (VALUES ('docx'), ('html'), ('xlsx'), ('pdf'), ('txt')) t(k) LEFT JOIN (SELECT CASE lang WHEN 'en' THEN 'docx' WHEN 'fr' THEN 'html' WHEN 'de' THEN 'xlsx' ELSE 'txt' END AS k FROM documents) d ON d.k = t.k GROUP BY t.k",
        "resume_anti_join": "SELECT doc_id AS row, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 1)",
        "foil_budget": "SELECT doc_id AS row, row_number() OVER (ORDER BY doc_id) <= 100 AS in_budget FROM documents",
        "audit_normalize": f"{facts} SELECT row, {clean(code)} AS code, length({clean('coalesce(dmc_ref, ' + _quoted('') + ')')}) = 29 AND starts_with({clean('coalesce(dmc_ref, ' + _quoted('') + ')')}, '00000046') AS looks_right, code_matches FROM matched",
        "audit_flags": f"{facts} SELECT row, ai, aj, ak, an, foil_status, array_to_string([x FOR x IN [CASE WHEN aj = '1' THEN {_quoted(fixed.REASON_AJ)} END, CASE WHEN ak = '1' THEN {_quoted(fixed.REASON_AK)} END, CASE WHEN ai = '1' THEN CASE WHEN foil_removed IS NULL THEN 'фольга: ' || foil_status ELSE {_quoted(fixed.REASON_AI)} END END] IF x IS NOT NULL], '|') AS reasons, array_to_string([x FOR x IN [CASE WHEN NOT af_present THEN {_quoted(fixed.AN_NO_AF)} END, CASE WHEN NOT ae_present THEN {_quoted(fixed.AN_NO_AE)} END, CASE WHEN ai || aj || ak <> '' THEN {_quoted(fixed.AN_FLAG)} END] IF x IS NOT NULL], '|') AS an_reasons, review_needed FROM done",
        "audit_flags_lenient": facts.replace("'problem' AS policy", "'ok' AS policy") + " SELECT ai, aj, ak, an, count(*) AS n FROM done GROUP BY ALL",
        "audit_last_wins": "SELECT user_id AS row, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
        "audit_review": f"{facts} SELECT row, CASE WHEN ak = '1' THEN {_quoted(fixed.REVIEW_AK)} WHEN aj = '1' THEN {_quoted(fixed.REVIEW_AJ)} ELSE {_quoted(fixed.REVIEW_FOIL)} END AS review_reason FROM done WHERE review_needed",
        "audit_summary": f"{facts}, one AS (SELECT count(*) AS n, count(*) FILTER (an = '1') AS an1, count(*) FILTER (an = '0') AS an0, count(*) FILTER (dmc_found) AS decoded, count(*) FILTER (decode_error LIKE '%download_error%') AS download_errors, count(*) FILTER (decode_error = 'empty_url') AS empty_urls, count(*) FILTER (NOT af_present) AS af_absent, count(*) FILTER (foil_removed IS NULL AND foil_checked) AS foil_unknown FROM done) SELECT *, {', '.join(pct(k) for k in counts)}, decoded = 0 AS warn_none_decoded, download_errors * 10 >= n * 9 AS warn_downloads, empty_urls * 10 >= n * 9 AS warn_empty_urls FROM one",
        "audit_fill_rate": f"{facts}, t AS (SELECT unnest(['dmc_ref', 'decoded', 'foil_error']) AS \"column\", unnest([count(nullif({_strip('dmc_ref')}, '')), count(nullif({_strip('decoded')}, '')), count(nullif({_strip('foil_error')}, ''))]) AS filled, count(*) AS total FROM facts) SELECT \"column\", filled, total, filled * 10 <= total AS sparse FROM t",
        "guardrail_proximity": f"WITH {BLOCKS} SELECT doc_id, position, {near} AS near FROM (SELECT doc_id, position, lower(text) AS x FROM blocks)",
        "llm_payload": f"{_with(rows, min_score, top_k)} SELECT folder, criterion_id, (rank - 1)::INTEGER AS place, (rank - 1)::INTEGER AS llm_evidence_id, CASE WHEN length(snippet) <= 1200 THEN snippet ELSE {_strip_end("substr(snippet, 1, " + str(1200 - len(fixed.LLM_CUT)) + ")")} || {_quoted(fixed.LLM_CUT)} END AS text, score::DOUBLE AS score FROM matches WHERE rank <= 3",
    }

