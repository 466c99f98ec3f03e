import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillmark import __main__ as cli
from quillmark import run
from quillmark.operators import chat
from quillmark.sinks import docx_report, reports
from quillmark.sources import folder, office
from quillmark.sources.criteria import criteria_of

CRITERIA = [
    {"id": "subject_okpd2_oil", "criterion": "масла моторные", "priority": "high", "keywords": ["масла моторные"]},
    {"id": "subject_title_oil", "criterion": "масла", "priority": "high", "keywords": ["масла"]},
    {"id": "purchase_type_goods", "criterion": "поставка товара", "priority": "high", "keywords": ["поставка товара"]},
    {"id": "procurement_method", "criterion": "электронный аукцион", "priority": "medium", "keywords": ["электронный аукцион"]},
    {"id": "delivery", "criterion": "нет такого", "priority": "low", "keywords": ["нет такого"]},
]
PAGE = "<h1>Извещение</h1><p>Поставка товара: масла моторные</p><p>Закупка проводится как электронный аукцион.</p><table></table>"


def _template(places):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<d>" + "".join(f"<w:t>{{{{{p}}}}}</w:t>" for p in places) + "</d>")
    return out.getvalue()


PLACES = [*docx_report.REQUIRED, *docx_report.OPTIONAL]


def test_fallbacks_of_all_places():
    values, warnings = docx_report.report_values({})
    assert len(values) == 52 and warnings == [] and values == docx_report.REQUIRED | docx_report.OPTIONAL
    assert values["rules.price_nmc.comment"] == "Комментарий по НМЦК не сформирован." and values["rules.delivery_period.evidence"] == "Evidence по сроку поставки не найдено."
    with pytest.raises(ValueError):
        docx_report.report_values([])


def test_values_of_a_result():
    rules = [
        {"id": "price_nmc", "criterion": "НМЦК", "status": "PASS", "risk": "Low", "comment": " c\n1 ", "evidence": [{"snippet": " "}, {"text": "a  b"}, {"block": {"text": "z"}}, {"text": "third"}]},
        {"rule_id": "own", "criterion": "", "status": "unknown", "risk": None, "priority": "low", "human_review_required": True, "evidence": "one text"},
        {"id": "odd", "status": "weird"}, {"criterion": "nameless"}, 7,
    ]
    scenario = {"scenario": "s", "confidence": 0.755, "human_review_required": False, "blocking_criteria": [{"rule_id": "r", "message": "m"}, 1], "reasons": [{"message": "why", "rule_id": "r"}, {}], "conclusion": "from scenario"}
    values, warnings = docx_report.report_values({"rules": rules, "scenario_result": scenario, "stats": {"pass": 3, "fail": True}, "input_path": "/x", "rules_count": 4})
    assert values["rules.price_nmc.status"] == "pass" and values["rules.price_nmc.comment"] == "c 1" and values["rules.price_nmc.evidence"] == "a b\nz"
    assert values["scenario.blocking_criteria"] == "- [r] Критерий не указан — unknown / unknown\n  m" and values["scenario.reasons"] == "- why (r)\n- Причина не указана"
    assert (values["scenario.confidence"], values["scenario.human_review_required"], values["stats.pass"], values["stats.fail"], values["stats.human_review_required"], values["input.path"]) == ("75.5%", "нет", "3", "да", "1", "/x")
    assert values["questions.count"] == "1" and values["questions.items"] == "- Уточнить критерий: Критерий не указан ([own], status=unknown, risk=unknown)"
    assert values["summary.confirmed_criteria"] == "- [price_nmc] НМЦК — pass / low" and values["summary.general_conclusion"] == "from scenario"
    assert values["summary.low_priority_unknown_criteria"] == "- [own] Критерий не указан — unknown / unknown" == values["summary.attention_criteria"].split("\n")[0]
    assert values["evidence.appendix"] == "- [price_nmc] НМЦК\n  Основание: a b\nz\n- [own] Критерий не указан\n  Основание: one text"
    assert warnings == ["skipped rule without identifiable rule_id/id", "extra rule without direct placeholder: own", "extra rule without direct placeholder: odd", "unexpected rule status: weird for odd"]
    assert [docx_report.confidence(x, "-") for x in (1, 0, 0.5, 2, "x", None, True)] == ["100%", "0%", "50%", "2", "x", "-", "да"]


def test_cut_at_word():
    assert docx_report.cut_at_word("a" * 500) == "a" * 500 and docx_report.cut_at_word("a" * 501) == "a" * 497 + "..."
    assert docx_report.cut_at_word("one two  three", 13) == "one two three" and docx_report.cut_at_word("one two three", 12) == "one two..." and docx_report.cut_at_word("one two three", 10) == "one..."


def test_templates():
    done, warnings = docx_report.render_docx({"input_path": "<x>"}, _template(PLACES))
    with zipfile.ZipFile(io.BytesIO(done)) as z:
        assert "&lt;x&gt;" in z.read("word/document.xml").decode() and warnings == []
    less, warnings = docx_report.render_docx({}, _template(docx_report.REQUIRED))
    docx_report.check_docx(less)
    assert len(warnings) == len(docx_report.OPTIONAL)
    for places in ([*PLACES, "other"], PLACES[1:], PLACES[:3]):
        with pytest.raises(ValueError):
            docx_report.render_docx({}, _template(places))
    with pytest.raises(ValueError):
        docx_report.check_docx(_template(["a"]))


def test_conclusions():
    calm = {"status": "pass", "risk": "low", "priority": "high"}
    assert reports.CONCLUSION_CLEAR in reports.render_summary({"rules": [calm]})
    assert reports.CONCLUSION_PARTLY in reports.render_summary({"rules": [calm, {"status": "unknown", "priority": "low", "risk": "low"}]})


def test_settings():
    given = {"TENDER_LLM_ENABLED": " TRUE ", "TENDER_LLM_BASE_URL": "http://h/v1/", "TENDER_LLM_MODEL": " ", "TENDER_LLM_TIMEOUT_SECONDS": "+5", "TENDER_LLM_MAX_TOKENS": "-1", "TENDER_LLM_MAX_EVIDENCE_ITEMS": "99", "TENDER_LLM_SELECTIVE_ENABLED": "yes", "x": "y"}
    got = chat.settings_from(given, model="m")
    assert (got.enabled, got.model, got.timeout, got.max_tokens, got.evidence_items, got.evidence_chars, got.selective, got.run_on_pass) == (True, "m", 5, 512, 10, 1200, True, False)
    assert not chat.settings_from({}).enabled and not chat.settings_from({"TENDER_LLM_ENABLED": "1"}).enabled
    assert [chat.positive(x, 7, 9) for x in (None, "", "x", "0", "3", "12")] == [7, 7, 7, 7, 3, 9]


def test_client():
    answers = {"ok": (200, json.dumps({"choices": [{"message": {"content": "hi"}}]})), "shape": (200, "{}"), "kind": (200, json.dumps({"choices": [{"message": {"content": 1}}]})), "text": (200, "no"), "down": (503, "")}
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            code, text = answers[body["messages"][0]["content"]]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own = chat.Settings(True, "p", f"http://127.0.0.1:{server.server_port}/v1/", "m", "k")
    got = {k: chat.HttpClient(own).chat(k) for k in answers}
    server.shutdown()
    assert got["ok"] == ("hi", None, None) and {k: got[k][1] for k in ("shape", "kind", "text", "down")} == {"shape": "invalid_response", "kind": "invalid_response", "text": "invalid_response", "down": "http_error"}
    assert seen[0] == ("/v1/chat/completions", "Bearer k", {"model": "m", "messages": [{"role": "user", "content": "ok"}], "temperature": 0, "max_tokens": 512, "stream": False})
    server.server_close()
    assert chat.HttpClient(own).chat("ok")[1] == "url_error" and chat.HttpClient(chat.settings_from({})).chat("ok")[1] == "disabled"


def test_reader_statistics():
    assert folder.read_file("html", PAGE.encode())[1] == {"tables": 1, "paragraphs": 3, "table_rows": 0, "blocks": 3}
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="1"/><sheet name="b" r:id="1" state="hidden"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1" Target="s.xml"/></Relationships>')
        z.writestr("xl/s.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row r='{i}'><c r='A{i}'><v>{i}</v></c></row>" for i in range(1, 501)) + "</sheetData></worksheet>")
    assert folder.read_file("xlsx", sheet.getvalue())[1] == {"sheets": 1, "rows": 500, "blocks": 500}
    with zipfile.ZipFile(io.BytesIO(sheet.getvalue())) as package:
        assert [n for n, _ in office.sheet_rows(package, "xl/s.xml", [])] == list(range(1, 501))


def test_from_folder_to_reports(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "b.html").write_text(PAGE, "utf-8")
    (source / "A.htm").write_text("<p>масла</p>", "utf-8")
    (source / "broken.docx").write_bytes(b"no")
    (source / "note.sign").write_bytes(b"x")
    (tmp_path / "c.json").write_text(json.dumps(CRITERIA), "utf-8")
    (tmp_path / "t.docx").write_bytes(_template(PLACES))
    result = run.evaluate_folder(spark, str(source), criteria_of(CRITERIA))
    assert [(r["id"], r["status"]) for r in result["rules"]] == [(c["id"], "unknown" if c["id"] == "delivery" else "pass") for c in CRITERIA]
    assert result["scenario_result"]["scenario"] == "relevant_direct" and result["document_count"] == 2
    assert {k: result["source_stats"][k] for k in ("documents", "skipped", "failed", "blocks")} == {"documents": 2, "skipped": 1, "failed": 1, "blocks": 4}
    assert [e["block_text"] for e in result["rules"][1]["evidence"]] == ["масла", "Поставка товара: масла моторные"]
    files = cli.main(["score", "--input", str(source), "--criteria", str(tmp_path / "c.json"), "--out", str(tmp_path / "out"), "--docx-template", str(tmp_path / "t.docx")])
    assert files == 0 and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([run.SCORE, run.QUESTIONS, run.SUMMARY, run.DOCX])
    assert json.loads((tmp_path / "out" / run.SCORE).read_text("utf-8"))["stats"]["pass"] == 4
    none = run.evaluate_folder(spark, str(source), [])
    assert none["rules"] == [] and none["scenario_result"]["scenario"] == "need_human_review"
    capsys.readouterr()
    assert cli.main(["search", "--input", str(source), "--keyword", "аукцион"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["file_name"] == "b.html"
    with pytest.raises(FileNotFoundError):
        run.evaluate_folder(spark, str(tmp_path / "none"), [])


def test_one_rule(tmp_path, capsys, monkeypatch):
    for k in ("ENABLED", "PROVIDER", "MODEL"):
        monkeypatch.delenv(f"TENDER_LLM_{k}", raising=False)
    rule = tmp_path / "r.json"
    rule.write_text(json.dumps({"rule_id": "x", "status": "Pass", "evidence": [{"block": {"text": "t"}, "score": 1}]}))
    assert cli.main(["classify", "--rule-json", str(rule)]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["invocation_status"], told["rule_id"], told["deterministic_status"]) == ("skipped", "x", "pass") and list(told) == sorted(told)
    for text in ("[1]", "{"):
        rule.write_text(text)
        assert cli.main(["classify", "--rule-json", str(rule)]) == 2
    assert cli.main(["classify", "--rule-json", str(tmp_path / "none")]) == 2
