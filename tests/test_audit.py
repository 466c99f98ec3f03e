import pytest
from pyspark.sql import functions as F

from quillmark.operators import audit

PAIRS = [
    ("00000046a", "00000046a", True), ("00000046a", "]d200000046a", True), ("00000046a", "000\x1d00046a", True), ("00000046a", "0000<GS>0046a", True), ("00000046a", " 00000046 a\n", True),
    ("00000046a", "00000046A", False), ("00000046a", "", False), ("", "", False), ("00000046a", None, False), ("ab", "a{GS}b<FNC1>", True),
]


def test_codes(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string")
    got = [r["m"] for r in df.orderBy("i").select(audit.codes_match(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [m for *_, m in PAIRS]
    assert df.where("i = 5").select(audit.codes_match(F.col("a"), F.col("b"), True)).first()[0]


FACTS = "row int, dmc_ref string, decoded string, code_matches boolean, foil_removed boolean, foil_checked boolean, foil_error string, foil_review_needed boolean, af_present boolean, decode_error string"
CASES = [
    ((1, "a", "a", True, True, True, None, False, True, None), ("", "", "", "1"), False),
    ((2, "a", "b", False, True, True, None, False, True, None), ("", "", "1", "0"), True),
    ((3, "a", None, None, True, True, None, False, True, "empty_url"), ("", "1", "", "0"), True),
    ((4, None, "b", None, True, True, None, False, True, None), ("", "", "", "0"), False),
    ((5, "a", "a", True, False, True, None, False, True, None), ("1", "", "", "0"), False),
    ((6, "a", "a", True, None, True, "download_error: 1", True, True, None), ("1", "", "", "0"), True),
    ((7, "a", "a", True, None, False, None, None, True, None), ("1", "", "", "0"), False),
    ((8, "a", "a", True, True, True, None, False, None, None), ("", "", "", "0"), False),
    ((9, "<GS>", "a", False, True, True, None, False, True, None), ("", "", "", "0"), False),
]


def test_flags(spark):
    df = spark.createDataFrame([c[0] for c in CASES], FACTS)
    got = audit.evaluate(df).orderBy("row").collect()
    assert [((r["ai"], r["aj"], r["ak"], r["an"]), r["review_needed"]) for r in got] == [c[1:] for c in CASES]
    assert [r["foil_status"] for r in got][5:7] == ["ошибка загрузки фото", "не проверялась"]
    lenient = audit.evaluate(df, "ok").where("row = 7").first()
    assert (lenient["ai"], lenient["an"]) == ("", "1")
    with pytest.raises(ValueError):
        audit.evaluate(df, "x")


def test_summary_and_queue(spark):
    df = audit.evaluate(spark.createDataFrame([c[0] for c in CASES], FACTS))
    one = audit.summary(df).first()
    assert (one["n"], one["an1"], one["decoded"], one["empty_urls"], one["an1_pct"]) == (9, 1, 8, 1, 11)
    assert {r["row"] for r in audit.review_queue(df).collect()} == {2, 3, 6}
    nothing = audit.summary(df.where("row < 0")).first()
    assert nothing["n"] == 0 and not nothing["warn_none_decoded"]


def test_last_wins_resume_budget(spark):
    records = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")], "row int, seq int, v string")
    assert sorted((r["row"], r["v"]) for r in audit.last_wins(records).collect()) == [(1, "c"), (2, "b")]
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row int")
    done = spark.createDataFrame([(1, True), (2, False)], "row int, foil_checked boolean")
    assert {r[0] for r in audit.pending(rows, done).collect()} == {3}
    assert {r[0] for r in audit.pending(rows, done, foil_run=True).collect()} == {2, 3}
    assert [r["in_budget"] for r in audit.within_budget(rows, 2).orderBy("row").collect()] == [True, True, False]
