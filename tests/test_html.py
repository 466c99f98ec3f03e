from quillmark.sources.html import decode_html, html_blocks, parse_html


def _texts(html):
    return [(b["block_type"], b["section"], b["text"]) for b in parse_html(html)]


def test_inner_first_and_loose_text():
    assert _texts("a<div>b<p>c</p>d</div>e") == [("paragraph", None, "a"), ("paragraph", None, "c"), ("paragraph", None, "bd"), ("paragraph", None, "e")]


def test_headings_ignored_tags_and_breaks():
    html = "<script>x</script><h1>T</h1><p>a<br>b</p></section><style>y</style>"
    assert _texts(html) == [("paragraph", "T", "T"), ("paragraph", "T", "a b")]


def test_tables():
    html = "<div>x<table><tr><td>1</td><td> </td><td>2<table><tr><td>in</td></tr></table></td></tr><tr><td></td></tr><tr><th>3</th></table>y</div>"
    got = parse_html(html)
    assert [b["text"] for b in got] == ["x", "1 | 2", "3", "y"]
    assert [(b["block_id"], b["row_index"]) for b in got[1:3]] == [("t000001_r000001", 1), ("t000001_r000003", 3)]


def test_unclosed_and_charset():
    assert [t for *_, t in _texts("<div>a<p>b")] == ["b", "a"]
    assert decode_html("<meta charset=windows-1251>привет".encode("cp1251")).endswith("привет")
    assert decode_html("привет".encode("cp1251")) == "привет"


def test_blocks(spark):
    df = spark.createDataFrame([(1, "<p>a</p><table><tr><td>b</td></tr></table>"), (2, None), (3, "")], "doc_id long, content string")
    got = html_blocks(df).orderBy("doc_id", "position").collect()
    assert [(r["doc_id"], r["text"], r["table_index"], r["cell_values"]) for r in got] == [(1, "a", None, None), (1, "b", 1, ["b"])]


def test_references_without_a_semicolon():
    assert _texts("<h1>a&amp</h1><p>b&copy c &am d&lt;") == [("paragraph", "a&", "a&"), ("paragraph", "a&", "b© c &am d<")]
