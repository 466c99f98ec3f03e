"""Chat formatting (operator 5), in DataFrame functions only.

Chat logs often hold cumulative snapshots: a conversation, and again the same one a few turns later. A rolling
hash of turn prefixes finds them: the hash of the first k turns is the exclusive-or of the hashes of (place,
role, text), so it is a windowed bit_xor and may be summed in parts. A conversation whose whole hash is the hash
of a proper prefix of another is left out by an anti-join, equal conversations keep the one with the smallest id,
and the maximal ones are rendered.

Places and hashes are computed in two levels (BUCKET turns of a conversation, then its buckets), so a conversation
with a very large share of all turns is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of one conversation that a window sees together.
BUCKET = 1024

#: Fixed values of the rendered form.
TURN_START, TURN_MIDDLE, TURN_END = "<|", "|>\n", "<|end|>\n"


def _content(seed: int) -> Column:
    """Hash of a turn's role and text; nulls differ from empty ones."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("r"), F.col("role")), F.lit("")), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")))


def _order() -> tuple[Column, Column, Column]:
    """Turns of a conversation in order."""
    return F.col("turn"), F.col("role"), F.unhex(F.md5("text"))


def turns_with_prefix(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, h1, h2): h1 and h2 hash the turns up to this one, in order of turn; turns of one number
    come by role, then by the MD5 of their text; null first each time. Texts stay behind: only hashes move."""
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(2**62)))
    rows = conversations.select("conv_id", *(c.alias(f"o{i}") for i, c in enumerate(_order())), bucket.alias("bucket"), _content(1).alias("c1"), _content(2).alias("c2"))
    local = Window.partitionBy("conv_id", "bucket").orderBy(*(F.col(f"o{i}").asc_nulls_first() for i in range(3)))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("conv_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    placed = _join(rows.withColumn("local", F.row_number().over(local)), counts).withColumn("place", F.col("n_before") + F.col("local")).drop("n_before", "o0", "o1", "o2")
    placed = placed.withColumns({f"x{i}": F.xxhash64(F.lit(i), F.col("place"), F.col(f"c{i}")) for i in (1, 2)}).drop("c1", "c2")
    sums = placed.groupBy("conv_id", "bucket").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    sums = sums.select("conv_id", "bucket", *(F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    up_to = Window.partitionBy("conv_id", "bucket").orderBy("local").rowsBetween(Window.unboundedPreceding, 0)
    rolled = _join(placed, sums)
    return rolled.select("conv_id", "place", *(F.bit_xor(f"x{i}").over(up_to).bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)))


def _join(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Join on conversation and bucket, null ids included."""
    p = parts.withColumnsRenamed({"conv_id": "p_conv", "bucket": "p_bucket"})
    return rows.join(p, rows["conv_id"].eqNullSafe(p["p_conv"]) & (rows["bucket"] == p["p_bucket"])).drop("p_conv", "p_bucket")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are kept."""
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("w")).select("conv_id", F.col("w.place").alias("place"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    ends = whole.select(F.col("conv_id").alias("e_conv"), F.col("place").alias("n_turns"))
    proper = prefixes.join(ends, prefixes["conv_id"].eqNullSafe(ends["e_conv"])).where(F.col("place") < F.col("n_turns")).select("place", "h1", "h2").distinct()
    first = whole.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return first.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Collapse cumulative snapshots, then render every maximal conversation.

    Returns (conv_id, n_turns long, rendered string), one row for each kept conversation. A conversation is the
    rows of one conv_id (null is an id like any other, the smallest only if alone) in order of turn, then role, then the
    MD5 of the text, null first each time; repeated rows are repeated turns. A null role or text is rendered as the empty string. An empty table
    gives an empty one; other columns are not read. A rendered conversation is one value, so it must fit in a row.
    """
    kept = maximal(turns_with_prefix(conversations)).withColumnRenamed("conv_id", "k_conv")
    piece = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("")), F.lit(TURN_MIDDLE), F.coalesce("text", F.lit("")), F.lit(TURN_END))
    turns = conversations.select("conv_id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_order())), piece.alias("piece")).alias("t"))
    turns = turns.join(kept, turns["conv_id"].eqNullSafe(kept["k_conv"]))
    listed = turns.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", "n_turns", F.array_join(F.col("turns.piece"), "").alias("rendered"))


#: DuckDB: prefixes compared as whole strings.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS place
  FROM conversations),
p AS (
  SELECT conv_id, place, string_agg(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '') || chr(2), '') OVER (PARTITION BY conv_id ORDER BY place) AS pre,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
w AS (SELECT pre, n, min(conv_id) AS conv_id FROM p WHERE place = n GROUP BY pre, n),
k AS (SELECT w.conv_id, w.n FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = w.n AND p.pre = w.pre))
SELECT k.conv_id, k.n AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM k JOIN t USING (conv_id) GROUP BY ALL
"""
