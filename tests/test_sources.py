import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.operators import audit
from quillmark.sinks import results
from quillmark.sources import folder, office, pdf, records
from quillmark.sources.criteria import load_criteria
from quillmark.streaming import resume

WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SNS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(body):
    return _zip({"word/document.xml": f"<w:document {WNS}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {WNS}><w:style w:styleId="a1"><w:name w:val="Заголовок 1"/></w:style></w:styles>'})


def _p(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def _tc(text, merge=""):
    return f"<w:tc><w:tcPr>{merge}</w:tcPr>{_p(text) if text else ''}</w:tc>"


DOCX = _docx(_p("Раздел", "a1") + _p(" ") + _p("текст  один") + f"<w:tbl><w:tr>{_tc('a')}{_tc('')}{_tc('b')}</w:tr><w:tr>{_tc('')}</w:tr><w:tr>{_tc('c')}{_tc('x', '<w:vMerge/>')}</w:tr></w:tbl>")
SHEET = f"""<worksheet {SNS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"/>
<row r="3"><c r="A3"><v>-0.0</v></c><c r="B3"><v>1.50</v></c><c r="C3" t="b"><v>1</v></c><c r="AA3"><f>HYPERLINK("http://x/1","p")</f><v>p</v></c></row><row r="5"><c r="B5" t="s"><v>1</v></c></row></sheetData></worksheet>"""
XLSX = _zip(
    {
        "xl/workbook.xml": f'<workbook {SNS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Hidden" sheetId="1" state="hidden" r:id="rId1"/><sheet name="Detail" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {SNS}><si><t>head</t></si><si><r><t>Sec</t></r><r><t>tion</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {SNS}><sheetData><row r='1'><c r='A1'><v>1</v></c></row></sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": SHEET,
    }
)


def test_docx():
    got = office.docx_blocks(DOCX)
    assert [(b["block_id"], b["section"], b["text"]) for b in got] == [("p000001", "Раздел", "Раздел"), ("p000002", "Раздел", "текст один"), ("t000001_r000001", "Раздел", "a | b"), ("t000001_r000003", "Раздел", "c")]


def test_xlsx():
    got = office.xlsx_blocks(XLSX)
    assert [(b["text"], b["section"], b["row_index"], b["excel_row_index"]) for b in got] == [("head | in", None, 1, 1), ("0 | 1.5 | true | http://x/1", None, 2, 3), ("Section", "Section", 3, 5)]
    assert list(office.xlsx_records(XLSX, "Detail", {"B": "b", "AA": "link"})) == [{"row": 3, "b": "1.5", "link": "http://x/1"}, {"row": 5, "b": "Section", "link": None}]
    with pytest.raises(ValueError):
        list(office.xlsx_records(XLSX, "None", {"A": "a"}))
    assert office.column_number("AA10") == 27 and office.format_number("1e20") == "100000000000000000000"


def test_pdf_pages():
    got = pdf.blocks_of_pages(["ОБЩЕЕ\n\nпервый\nабзац\n\n1", None, "Страница 2\n\n2.1 Сроки\n\nтекст"])
    assert [(b["page_number"], b["section"], b["text"]) for b in got] == [(1, "ОБЩЕЕ", "ОБЩЕЕ"), (1, "ОБЩЕЕ", "первый абзац"), (3, "2.1 Сроки", "2.1 Сроки"), (3, "2.1 Сроки", "текст")]


def test_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name, data in {"B.docx": DOCX, "b/a.XLSX": XLSX, "b/page.htm": b"<p>hi</p>", "~$x.docx": b"x", "x.sign": b"x", "broken.docx": b"nope"}.items():
        (tmp_path / name).write_bytes(data)
    got = folder.read_folder(spark, str(tmp_path))
    assert {r["file_name"]: r["source_type"] for r in got.documents.collect()} == {"B.docx": "docx", "a.XLSX": "xlsx", "page.htm": "html"}
    assert {r["file_name"]: r["reason"] for r in got.skipped.collect()} == {"~$x.docx": "temporary_office_file", "x.sign": "unsupported_extension"}
    assert [r["error_type"] for r in got.failed.collect()] == ["BadZipFile"]
    assert got.blocks.count() == 8 and {r["global_block_index"] for r in got.blocks.collect()} == set(range(1, 9))
    assert {r["source_type"]: r["documents"] for r in got.by_type.collect()} == {"docx": 1, "xlsx": 1, "html": 1, "pdf": 0}
    with pytest.raises(RuntimeError):
        folder.read_folder(spark, str(tmp_path), strict=True)


def test_records_and_resume(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(XLSX)
    rows = records.read_workbook_rows(spark, str(tmp_path), "Detail", {"B": "b"})
    assert sorted(r["row"] for r in rows.collect()) == [3, 5]
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"row": 1}\n{"row": 2}\n')
    args = (spark, str(source), "row int", lambda df: df.withColumn("v", F.col("row") * 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    resume.process_new(*args).awaitTermination()
    (source / "2.jsonl").write_text('{"row": 2}\n{"row": 3}\n')
    resume.process_new(*args).awaitTermination()
    last = audit.last_wins(resume.results(spark, str(tmp_path / "out")))
    assert sorted((r["row"], r["v"]) for r in last.collect()) == [(1, 10), (2, 20), (3, 30)]
    (tmp_path / "broken.jsonl").write_text('{"row": 1}\n{"ro')
    assert [r["row"] for r in records.read_json_lines(spark, str(tmp_path / "broken.jsonl"), "row int", strict=False).collect()] == [1]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        records.read_json_lines(spark, str(tmp_path / "broken.jsonl"), "row int").collect()


def _sheet(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda n, r: "".join(f'<c r="{c}{n}" s="3" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in r.items())
    return _zip(
        {
            "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Detail" r:id="1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1" Target="worksheets/s.xml"/></Relationships>',
            "xl/worksheets/s.xml": f'<worksheet {ns}><sheetData>' + "".join(f'<row r="{n}" ht="9">{cells(n, r)}</row>' if r else f'<row r="{n}"/>' for n, r in rows.items()) + "</sheetData><keep/></worksheet>",
            "other": "kept",
        }
    )


def test_audit_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_sheet({1: {"A": "ref"}, 2: {"A": "r2", "D": "x"}, 3: {"D": "x"}, 4: {"B": "p4", "D": "y"}, 5: {"C": "q5", "D": "x"}, 6: {"A": "r6", "D": "x"}}))
    rows = lambda **more: sorted(r["row"] for r in records.audit_rows(spark, str(tmp_path), "Detail", ("A", "B", "C", "D"), **more).collect())
    assert rows() == [2, 4, 5, 6] and rows(keep_empty=True) == [2, 3, 4, 5, 6] and rows(check_type="x") == [2, 5, 6] and rows(check_type="x", limit=2) == [2, 5] and rows(check_type="none") == []


def test_flags_in_a_workbook():
    old = _sheet({1: {"A": "head"}, 2: {"A": "a", "AJ": "old", "AO": "z"}, 4: None})
    flags = [{"row": 2, "ai": "1", "aj": "", "ak": "<", "an": "0"}, {"row": 3, "ai": "", "aj": "1", "ak": "", "an": "0"}, {"row": 4, "ai": "", "aj": "", "ak": "", "an": "1"}]
    new = results.fill_workbook(old, "Detail", flags)
    with zipfile.ZipFile(io.BytesIO(new)) as package:
        xml, other = package.read("xl/worksheets/s.xml").decode(), package.read("other")
        assert other == b"kept" and xml.endswith("<keep/></worksheet>") and [n for n, _ in office.sheet_rows(package, "xl/worksheets/s.xml", [])] == [1, 2, 3, 4]
        got = dict(office.sheet_rows(package, "xl/worksheets/s.xml", []))
    at = office.column_number
    assert got[2] == {1: "a", at("AI"): "1", at("AK"): "<", at("AN"): "0", at("AO"): "z"} and got[3] == {at("AJ"): "1", at("AN"): "0"} and got[4] == {at("AN"): "1"}
    assert '<c r="AJ2" s="3"/>' in xml and '<row r="2" ht="9">' in xml
    with zipfile.ZipFile(io.BytesIO(results.fill_workbook(old, "Detail", flags, dmc_only=True))) as package:
        assert dict(office.sheet_rows(package, "xl/worksheets/s.xml", []))[2] == {1: "a", at("AK"): "<", at("AO"): "z"}
    with pytest.raises(ValueError):
        results.fill_workbook(old, "None", flags)


def test_result_tables(spark):
    rows = [(2, "1", "", "", "0", "d", "r", "AF", False, "x", 0.5), (1, "", "", "1", "0", "d", "r", "AG", True, "x", None), (3, "", "1", "", "0", None, "r", None, True, "y", None)]
    df = spark.createDataFrame(rows, "row int, ai string, aj string, ak string, an string, decoded string, dmc_ref string, decode_source string, review_needed boolean, foil_status string, foil_confidence double")
    table = results.flags_table(df)
    assert table.columns == ["row", "AI (фольга не снята)", "AJ (нет DMC)", "AK (DMC не совпадает)", "AN (итог)"] and [tuple(r) for r in table.collect()][0] == (1, "", "", "1", "0")
    assert results.flags_table(df, dmc_only=True).columns == ["row", "AJ (нет DMC)", "AK (DMC не совпадает)"]
    review = [tuple(r) for r in results.review_table(df, dmc_only=True).collect()]
    assert review == [(1, "DMC распознан, но НЕ совпадает с эталоном AE", "d", "r", "AG", "1"), (3, "DMC не распознан (ни на AG, ни на AF)", None, "r", "—", "")]
    assert len(results.review_table(df.drop("foil_confidence", "decode_source")).columns) == 10


def test_criteria_files(tmp_path):
    path = tmp_path / "c.json"
    for data, n in (([{"id": "a"}], 1), ({"criteria": None}, 0), ({"id": "a"}, 1)):
        path.write_text(json.dumps(data))
        assert len(load_criteria(path)) == n
    path.write_text('{"x": 1}')
    with pytest.raises(ValueError):
        load_criteria(path)
    with pytest.raises(FileNotFoundError):
        load_criteria(tmp_path / "no.json")
    with pytest.raises(ValueError):
        load_criteria(tmp_path)
