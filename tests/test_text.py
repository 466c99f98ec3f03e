from pyspark.sql import functions as F

from quillmark.functions import text as tx

CASES = ["  Ёлка — «тест» №5  x\x1cy ", "", "A,B;C", "5% и 3%", "CI4+ а-б/в.г", "\t\n"]


def test_columns_agree_with_strings(spark):
    df = spark.createDataFrame([(x,) for x in CASES], "t string")
    rows = df.select("t", tx.normalize_search(F.col("t")).alias("n"), tx.normalize_content(F.col("t")).alias("c"), tx.tokens(tx.normalize_search(F.col("t"))).alias("k")).collect()
    for r in rows:
        assert r["n"] == tx.normalize_search_text(r["t"])
        assert r["c"] == tx.normalize_content_text(r["t"])
        assert r["k"] == tx.token_list(r["n"])


def test_phrase_position_needs_edges(spark):
    row = spark.sql("SELECT 'предоплата оплата' AS t, 'оплата' AS p, 'лата' AS q").select(tx.phrase_position(F.col("t"), F.col("p")).alias("a"), tx.phrase_position(F.col("t"), F.col("q")).alias("b")).first()
    assert (row["a"], row["b"]) == (11, -1)


def test_truncate_and_snippet(spark):
    text = "а" * 400 + " цель " + "б" * 400
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tx.snippet_at(F.col("t"), F.lit(401), F.lit(4)).alias("s"), tx.truncate(F.lit("abcdef"), 3).alias("x"), tx.truncate(F.lit("ab  cdef"), 6).alias("y")).first()
    assert len(got["s"]) <= 320 and "цель" in got["s"]
    assert (got["x"], got["y"]) == ("abc", "ab...")
