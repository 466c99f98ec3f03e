"""The uniform table of text blocks, and numbers and sections that follow the order of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import collapse

#: Ranges of ids that a folder's documents are numbered in.
RANGES = 4096


def blocks_of_documents(docs: DataFrame, folder: str = "source", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of each text that aren't blank: (folder, doc_id, position from 1, block_id, block_type, section, text).
    Places come from the lines' own array, so nothing is shuffled."""
    lines = F.filter(F.transform(F.split(F.col(text), "\r\n|\r|\n"), collapse), lambda x: x != "")
    kept = docs.select(F.col(folder).alias("folder"), F.col(doc).alias("doc_id"), F.posexplode(lines).alias("at", "text")).withColumn("position", F.col("at").cast("long") + 1)
    return kept.select("folder", "doc_id", "position", F.format_string("p%06d", "position").alias("block_id"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("section"), "text")


def number_blocks(blocks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """blocks with document_index, document_id, global_block_index and global_block_id, from 1 within each folder in
    order of doc_id and position. Numbers come in two levels: counts of ranges of ids, then places within one, so no
    task sorts a folder's blocks as a whole. There are RANGES ranges between the least and the greatest id, however far
    apart these are; ids: a table whose doc_id tells them without reading the blocks."""
    low, high = (ids or blocks).agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 1 if low is None else (high - low) // RANGES + 1
    per_doc = blocks.groupBy("folder", "doc_id").agg(F.count("*").alias("n")).withColumn("range", F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)))
    before = Window.partitionBy("folder").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_doc.groupBy("folder", "range").agg(F.count("*").alias("docs"), F.sum("n").alias("blocks"))
    ranges = ranges.select("folder", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "blocks")))
    inside = Window.partitionBy("folder", "range").orderBy("doc_id")
    numbered = per_doc.join(ranges, ["folder", "range"]).select(
        "folder", "doc_id", (F.col("docs_before") + F.row_number().over(inside)).alias("document_index"),
        (F.col("blocks_before") + F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first"),
    )
    return blocks.join(numbered, ["folder", "doc_id"]).withColumn("global_block_index", F.col("first") + F.col("position")).drop("first").withColumns(
        {"document_id": F.format_string("d%06d", "document_index"), "global_block_id": F.format_string("b%06d", "global_block_index")}
    )


def carry_section(rows: DataFrame, heading: Column, keys: list[str], order: str) -> DataFrame:
    """rows with section: the last heading at or before the row, within keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(w))


def full_text(blocks: DataFrame, keys: list[str], order: str, separator: str = "\n") -> DataFrame:
    """The non-empty texts of each key in order, joined."""
    listed = blocks.where("text <> ''").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("x"))
    return listed.select(*keys, F.array_join(F.col("x.text"), separator).alias("full_text"))


def count_by_type(documents: DataFrame, types: tuple[str, ...] = ("docx", "html", "xlsx", "pdf")) -> DataFrame:
    """(source_type, documents) for every type, zeros kept."""
    spark = documents.sparkSession
    every = spark.createDataFrame([(t,) for t in types], "source_type string")
    return every.join(documents.groupBy("source_type").agg(F.count("*").alias("n")), "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).alias("documents"))
