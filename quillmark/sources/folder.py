"""Folders of files to tables: routing by suffix, skipped files, blocks, and files that could not be read.

Files come through Spark's binaryFile source, so any store that Spark reads will do; each is parsed by one
Arrow-batched call that turns an exception into a row of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.blocks import count_by_type, number_blocks
from quillmark.sources import html, office, pdf
from quillmark.work import checkpoint

#: Suffixes that are read, and why others are not.
TYPES = {"docx": "docx", "html": "html", "htm": "html", "xlsx": "xlsx", "pdf": "pdf"}
TEMPORARY, UNSUPPORTED = "temporary_office_file", "unsupported_extension"
_SCHEMA = "path string, position int, block_id string, block_type string, section string, text string, table_index int, row_index int, cell_values array<string>, sheet_name string, excel_row_index int, page_number int, error_type string, error string, stats string"
_ARROW = pa.schema({n: {"int": pa.int32(), "string": pa.string()}.get(t, pa.list_(pa.string())) for n, t in (x.split(" ") for x in _SCHEMA.split(", "))})
_READERS = {"docx": office.read_docx, "xlsx": office.read_xlsx, "html": html.read_html, "pdf": pdf.read_pdf}
#: Which kinds of blocks a type's statistics count beside all blocks, and by what name.
_COUNTED = {"docx": {"paragraphs": "paragraph", "table_rows": "table_row"}, "html": {"paragraphs": "paragraph", "table_rows": "table_row"}, "xlsx": {"rows": "table_row"}, "pdf": {"paragraphs": "paragraph"}}


@dataclass(frozen=True)
class Folder:
    """documents (with their readers' statistics), blocks, skipped and failed files, and counts by type."""

    documents: DataFrame
    blocks: DataFrame
    skipped: DataFrame
    failed: DataFrame
    by_type: DataFrame


def source_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, v))), suffix)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def skip_reason(path: Column) -> Column:
    """Why a file is left out; null where it is read. Temporary office files come first."""
    return F.when(F.startswith(file_name(path), F.lit("~$")), TEMPORARY).when(source_type(path).isNull(), UNSUPPORTED)


def parse_file(kind: str, data: bytes) -> list[dict]:
    return _READERS[kind](data)[0]


def read_file(kind: str, data: bytes) -> tuple[list[dict], dict[str, int]]:
    """Blocks, and the reader's statistics: what it counts itself (tables, sheets, pages, empty pages), then its blocks."""
    blocks, own = _READERS[kind](data)
    return blocks, own | {name: sum(b["block_type"] == t for b in blocks) for name, t in _COUNTED[kind].items()} | {"blocks": len(blocks)}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            try:
                blocks, stats = read_file(file["source_type"], file["content"])
                out = [{"path": file["path"], "position": 0, "stats": json.dumps(stats)}, *({"path": file["path"], "position": i} | b for i, b in enumerate(blocks, 1))]
            except Exception as e:
                out = [{"path": file["path"], "error_type": type(e).__name__, "error": str(e)}]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _in_order(files: DataFrame) -> DataFrame:
    """files with doc_id from 1 in order of their lower-cased path: ranges of paths are sorted each for itself, and a
    range's numbers begin after those before it, so no task sorts all names."""
    by = [F.lower("path"), F.col("path")]
    ranged = checkpoint(files.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    first = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    return ranged.join(F.broadcast(first), "__range").withColumn("doc_id", F.col("__before") + within).drop("__range", "__before")


def read_folder(spark: SparkSession, path: str, strict: bool = False) -> Folder:
    """Read a file, or all files under a folder, in order of their lower-cased path (files without a byte are not listed
    by Spark, so they are in no table). Each file is parsed once: what its reader gives is written to the shared folder.
    strict, as for a single file, raises where a file can't be read; otherwise it becomes a row of failed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select("path").withColumns({"file_name": file_name(F.col("path")), "source_type": source_type(F.col("path")), "reason": skip_reason(F.col("path"))})
    skipped = listed.where("reason IS NOT NULL").select("path", "file_name", "reason")
    wanted = files.select("path", source_type(F.col("path")).alias("source_type"), "content").where(skip_reason(F.col("path")).isNull())
    parsed = checkpoint(wanted.mapInArrow(_parse, _SCHEMA))
    failed = parsed.where("error_type IS NOT NULL").select("path", "error_type", "error")
    if strict and (one := failed.first()):
        raise RuntimeError(f"{one['error_type']}: {one['error']} ({one['path']})")
    documents = _in_order(parsed.where("position = 0").select("path", file_name(F.col("path")).alias("file_name"), source_type(F.col("path")).alias("source_type"), "stats"))
    blocks = parsed.where("position > 0").drop("error_type", "error", "stats").join(documents.drop("stats"), "path").withColumn("folder", F.lit(path)).withColumn("position", F.col("position").cast("long"))
    return Folder(documents, number_blocks(blocks, documents), skipped, failed, count_by_type(documents))
