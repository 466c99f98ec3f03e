"""URL filters (operator 3), in DataFrame functions only.

A rule is (host, path, action). It fits a URL of its host or of any subdomain whose path starts with the rule's.
Each rule becomes a regular expression over host and path, indexed by its rarest literal token: host labels and
path parts, cut at "." and "/", of which the one held by the fewest rules is taken. The tokens of a URL fetch
candidate rules by an equi-join, and only those run their expressions. The longest fitting rule decides.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import ascii_lower

#: Rules up to which their index is sent to all executors; a longer list is joined by a shuffle.
BROADCAST_RULES = 100_000

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or no "://"."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL that the rule fits holds whole; a last path part that may go on isn't one."""
    parts = re.split(r"[./]", path)
    return [x for x in host.split(".") + parts[:-1] if x]


def expression(host: str, path: str) -> str:
    """The rule as a regular expression over host and path."""
    quoted = lambda x: re.sub(r"([^0-9A-Za-z/])", r"\\\1", x) if x.isascii() else rf"\Q{x}\E"
    return rf"\A([^/]*\.)?{quoted(host)}" + (quoted(path) if path else r"(/|\z)")


def rule_index(rules: list[Rule]) -> list[tuple[str, str, str, str, int, int]]:
    """(token, rule, action, expression, length, host length) of each rule; rules without a token get the empty one."""
    seen: dict[tuple[str, str], str] = {}
    for host, path, action in rules:
        if action not in ("allow", "block") or host != host.lower() or not host:
            raise ValueError(f"not a rule: {(host, path, action)}")
        if seen.setdefault((host, path), action) != action:
            raise ValueError(f"the rule {host}{path} has two actions")
    tokens = {k: literal_tokens(*k) for k in seen}
    held = Counter(t for ts in tokens.values() for t in set(ts))
    return [(min(tokens[k], key=lambda t: (held[t], -len(t), t), default=""), k[0] + k[1], action, expression(*k), len(k[0] + k[1]), len(k[0])) for k, action in seen.items()]


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row's URL.

    Returns (page_id, host, path, rule, verdict), one row for each row of pages, repeated rows and null ids
    included. A null URL or one without "://" has empty host and path, fits no rule and gets the default verdict.
    Among fitting rules of one length the one with the longer host wins, then the first by name. Other columns of
    pages are not read. Very long URLs are judged whole; an empty table gives an empty one. The URLs are judged once for each distinct host and path, so repeated URLs cost one join row.
    """
    spark = pages.sparkSession
    judged = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    index = spark.createDataFrame(rule_index(rules), "token string, rule string, action string, expression string, length int, host_length int")
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    key = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.split(key, "[./]"), F.array(F.lit(""))))
    candidates = judged.select("host", "path").distinct().withColumn("token", F.explode(tokens)).join(index, "token").where(F.rlike(key, F.col("expression")))
    best = candidates.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct("length", "host_length", F.col("rule"))).alias("best"))
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
