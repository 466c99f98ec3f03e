import json

from pyspark.sql import functions as F

from quillmark.functions import fixed
from quillmark.operators import shadow

#: An answer that keeps the contract.
GOOD = {
    "invocation_status": "ok", "rule_id": "r", "verdict": "fail", "confidence": "high", "human_review_required": True, "reason": "x", "supporting_evidence_ids": [0], "warnings": ["w", " "],
    "conflicts_with_rule": False, "deterministic_status": "pass", "provider": "p", "model": "m",
}


def test_near_without_sentences(spark):
    text = "смп" + "x" * 47 + "только"
    rows = spark.createDataFrame([(text,), ("смп" + "x" * 48 + "только",), ("только смп",), ("смп. только",)], "t string")
    assert [r[0] for r in rows.select(shadow.near(F.col("t"), "смп", "только")).collect()] == [True, False, True, False]


def test_answers():
    says = "LLM verdict 'fail' conflicts with deterministic status 'pass'."
    for answer in (json.dumps(GOOD), "```json\n" + json.dumps(GOOD) + "\n```", "Here it is:\n```JSON\n" + json.dumps(GOOD) + "\n``` as asked"):
        assert shadow.parse_verdict(answer, "r", "pass", "p", "m") == GOOD | {"conflicts_with_rule": True, "warnings": ["w", says]}
    bare = {k: v for k, v in GOOD.items() if k not in ("provider", "model")}
    assert shadow.parse_verdict(json.dumps(bare), "r", "fail", "P", "M") == GOOD | {"warnings": ["w"], "deterministic_status": "fail", "provider": "P", "model": "M"}
    unsure = shadow.parse_verdict(json.dumps(GOOD | {"verdict": "unknown"}), "r", "pass", "p", "m")
    assert unsure["conflicts_with_rule"] and unsure["warnings"][-1] == "LLM verdict 'unknown' conflicts with deterministic status 'pass'."
    broken = {
        "human_review_required": (1, "Field 'human_review_required' must be a boolean"), "verdict": ("maybe", "Invalid verdict value"), "supporting_evidence_ids": ([True], "Field 'supporting_evidence_ids' must be list[int]"),
        "warnings": ([1], "Field 'warnings' must be list[str]"), "invocation_status": ("done", "Invalid invocation_status value"), "deterministic_status": ("", "Invalid deterministic_status value"), "reason": (None, "Field 'reason' must be a string"),
    }
    for field, (value, why) in broken.items():
        got = shadow.parse_verdict(json.dumps(GOOD | {field: value}), "r", "pass", "p", "m")
        assert (got["invocation_status"], got["verdict"], got["error_type"], got["error_message"], got["warnings"], got["raw_response_saved"]) == ("invalid_json", "unknown", "contract_validation_error", why, [f"Contract violation: {why}"], False)
    less = shadow.parse_verdict(json.dumps({k: v for k, v in GOOD.items() if k not in ("reason", "confidence")}), "r", "pass", "p", "m")
    assert less["error_message"] == "Missing required fields: confidence, reason"
    assert shadow.parse_verdict("[]", "r", "pass", "p", "m")["error_message"] == fixed.CONTRACT_OBJECT
    none = shadow.parse_verdict("nonsense", " ", "PASS ", "p", "m")
    assert (none["error_type"], none["rule_id"], none["deterministic_status"], none["conflicts_with_rule"]) == ("json_decode_error", "criterion_unknown", "pass", False) and none["warnings"] == ["Invalid JSON response: Expecting value"]


def test_failures():
    own = {"rule_id": "r", "deterministic_status": "pass", "provider": "p", "model": "m"}
    kinds = {k: shadow.failed(own, k, "x")["invocation_status"] for k in ("http_error", "url_error", "timeout", "ConnectionRefusedError", "OSError", None)}
    assert list(kinds.values()) == ["unavailable"] * 4 + ["error"] * 2
    assert shadow.failed(own, None, None)["error_type"] == "llm_error" and shadow.failed(own, "timeout", "slow")["warnings"] == ["LLM call failed: slow"]
    off = shadow.classify({"id": "r", "status": "pass"}, None, "", "p", "m", enabled=False)
    assert (off["invocation_status"], off["human_review_required"], off["reason"]) == ("skipped", False, fixed.LLM_DISABLED)
    empty = shadow.classify({"id": "r", "status": "pass"}, None, "", "p", "m")
    assert (empty["invocation_status"], empty["human_review_required"], empty["warnings"]) == ("skipped", True, [fixed.LLM_NO_EVIDENCE_WARNING])


def test_payload(spark):
    item = "array<struct<score:double,snippet:string,text:string,block_text:string>>"
    cases = [(1.0, " ", "t", None), (None, None, None, ""), (2.5, " s ", "t", "b"), (0.0, None, "\t", "x" * 1300), (1.0, "y", None, None), (1.0, "z", None, None)]
    df = spark.createDataFrame([(1, cases), (2, None), (3, [])], f"id int, evidence {item}")
    got = {r["id"]: json.loads(r["p"]) for r in df.select("id", F.to_json(shadow.payload(F.col("evidence"))).alias("p")).collect()}
    long = "x" * (1200 - len(fixed.LLM_CUT)) + fixed.LLM_CUT
    assert got[1] == [{"llm_evidence_id": 0, "text": "t", "score": 1.0}, {"llm_evidence_id": 2, "text": " s ", "score": 2.5}, {"llm_evidence_id": 3, "text": long, "score": 0.0}] and got[2] == got[3] == []
    cut = lambda t, n: spark.range(1).select(shadow.shortened(F.lit(t), n)).first()[0]
    assert cut("a" * 6 + "   " + "b" * 40, 30) == "aaaaaa" + fixed.LLM_CUT and cut("a" * 30, 5) == fixed.LLM_CUT[:5] and cut("abc", 3) == "abc"


def test_prompt_is_filled_once():
    assert shadow.render_prompt("{{a}} {{ b }} {{c}}", {"a": "{{b}}", "b": "1"}) == "{{b}} 1 {{c}}"


def _client(answer):
    """A client class that workers get by value."""

    class Fake:
        def chat(self, prompt):
            if "crash" in prompt:
                raise RuntimeError("boom")
            if "silent" in prompt:
                return None, "timeout", "slow"
            return answer, None, None

    return Fake


def test_verdicts_beside_rules(spark):
    item = "array<struct<score:double,snippet:string,text:string,block_text:string>>"
    auction = [(1.0, None, "электронный аукцион", None)]
    rows = [("a", "procurement_method", "c", "pass", "low", False, auction), ("b", "procurement_method", "silent", "pass", "low", True, auction), ("c", "procurement_method", "crash", "pass", "low", True, auction), ("d", "procurement_method", "c", "pass", "low", True, []), ("e", "other", "c", "pass", "low", False, auction), ("f", "purchase_type_goods", "c", "pass", "low", True, [(1.0, None, "поставка товара", None)])]
    df = spark.createDataFrame(rows, f"folder string, id string, criterion string, status string, risk string, human_review_required boolean, evidence {item}")
    client = _client(json.dumps(GOOD | {"rule_id": "procurement_method"}))
    got = {r["folder"]: r for r in shadow.shadow_verdicts(df, client, "{{rule_id}} {{criterion}}", "p", "m").collect()}
    assert [got[k]["llm_verdict"] and got[k]["llm_verdict"]["invocation_status"] for k in "abcdef"] == ["ok", "unavailable", "error", "skipped", None, "skipped"]
    assert got["d"]["llm_verdict"]["reason"] == fixed.SKIP_METHOD and got["f"]["llm_verdict"]["verdict"] == "pass"
    assert all(got[k]["status"] == "pass" for k in "abcdef")
    calm = shadow.shadow_verdicts(df, client, "{{rule_id}} {{criterion}}", "p", "m", selective=True).where("folder = 'a'").first()
    assert calm["llm_verdict"]["reason"] == fixed.SKIP_SELECTIVE
    odd = df.where("folder = 'a'").unionByName(df.where("folder = 'a'").withColumn("folder", F.lit(None).cast("string"))).unionByName(df.where("folder = 'a'")).withColumns({"told": F.lit(7), "skip": F.lit(8), "a.b": F.lit(9)})
    rows = shadow.shadow_verdicts(odd, client, "{{rule_id}} {{criterion}}", "p", "m").collect()
    assert len(rows) == 3 and all(r["llm_verdict"]["invocation_status"] == "ok" and (r["told"], r["skip"]) == (7, 8) for r in rows)
