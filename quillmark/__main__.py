"""python -m quillmark score|search|classify: a folder's reports, a search in it, one rule's advisory verdict."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmark import run
from quillmark.operators import chat, search, shadow
from quillmark.sources.criteria import criteria_of, load_criteria
from quillmark.sources.folder import read_folder


def _spark() -> SparkSession:
    return SparkSession.builder.appName("quillmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _verdicts(settings: chat.Settings, template: str):
    def add(rules):
        return shadow.shadow_verdicts(rules, lambda: chat.HttpClient(settings), template, settings.provider, settings.model, settings.selective, settings.run_on_pass, settings.evidence_items, settings.evidence_chars)

    return add


def score(args: argparse.Namespace) -> int:
    settings = chat.settings_from(os.environ)
    if settings.enabled and not args.prompt:
        raise ValueError("--prompt names the template of the advisory verdict")
    verdicts = _verdicts(settings, Path(args.prompt).read_text("utf-8")) if settings.enabled else None
    template = None if args.no_docx else args.docx_template
    for path in run.score_folder(_spark(), args.input, args.criteria, args.out, args.top_k, args.min_score, template, verdicts):
        print(f"Wrote: {path}")
    return 0


def find(args: argparse.Namespace) -> int:
    blocks = read_folder(_spark(), args.input).blocks
    if args.criteria:
        found = search.search_by_criteria(blocks, criteria_of(load_criteria(args.criteria)), args.top_k, args.min_score)
    else:
        found = search.search_blocks(blocks, args.query, args.keyword, args.top_k, args.min_score)
    shown = found.matches.select("criterion_id", "rank", F.col("score").cast("double").alias("score"), "file_name", "global_block_id", "section", "matched_terms", "match_reasons", "snippet")
    for row in shown.orderBy("criterion_id", "rank").collect():
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


def classify(args: argparse.Namespace) -> int:
    """The advisory verdict of one rule in a JSON file: 0 with the verdict, 2 where the file isn't a rule."""
    try:
        rule = json.loads(Path(args.rule_json).read_text("utf-8"))
        if not isinstance(rule, dict):
            raise ValueError("a rule is an object")
    except (OSError, ValueError) as e:
        print(f"Input error: {e}", file=sys.stderr)
        return 2
    settings = chat.settings_from(os.environ)
    first = lambda *keys: next((t for k in keys if rule.get(k) is not None and (t := str(rule[k]).strip())), "")
    items = shadow.payload_of(rule.get("evidence"), settings.evidence_items, settings.evidence_chars)
    held = {"id": first("id", "rule_id", "criterion_id") or "criterion_unknown", "criterion": first("criterion", "description", "name"), "status": rule.get("status"), "evidence_json": json.dumps(items, ensure_ascii=False)}
    template = Path(args.prompt).read_text("utf-8") if args.prompt else "{{rule_id}}\n{{criterion}}\n{{deterministic_status}}\n{{rule_instructions}}\n{{evidence_json}}"
    verdict = shadow.classify(held, chat.HttpClient(settings), template, settings.provider, settings.model, settings.enabled)
    print(json.dumps(verdict, ensure_ascii=False, indent=2, sort_keys=True))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmark")
    tools = parser.add_subparsers(required=True)
    one = tools.add_parser("score", help="score a folder and write its reports")
    one.set_defaults(run=score)
    for name in ("--input", "--criteria", "--out"):
        one.add_argument(name, required=True)
    one.add_argument("--docx-template")
    one.add_argument("--no-docx", action="store_true")
    one.add_argument("--prompt", help="template of the advisory verdict, where it is enabled")
    two = tools.add_parser("search", help="search a folder's blocks")
    two.set_defaults(run=find)
    two.add_argument("--input", required=True)
    two.add_argument("--criteria")
    two.add_argument("--query")
    two.add_argument("--keyword", action="append")
    for tool, top_k, least in ((one, 5, 0.0), (two, 20, 1.0)):
        tool.add_argument("--top-k", type=int, default=top_k)
        tool.add_argument("--min-score", type=float, default=least)
    three = tools.add_parser("classify", help="the advisory verdict of one rule")
    three.set_defaults(run=classify)
    three.add_argument("--rule-json", required=True)
    three.add_argument("--prompt")
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
