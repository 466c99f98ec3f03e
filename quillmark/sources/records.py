"""Audit rows from workbooks and JSON lines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.sources.office import xlsx_records


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Strict input fails on a line that isn't JSON; what is resumed from may end in a broken line, which is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_workbook_rows(spark: SparkSession, path: str, sheet: str, columns: dict[str, str], skip_rows: int = 1) -> DataFrame:
    """(path, row, columns named by {letters: name}) of one sheet of each workbook under path. A workbook is one zip member, so one task
    reads it, as a stream; rows are dealt out after that."""
    schema = pa.schema({"path": pa.string(), "row": pa.int32()} | dict.fromkeys(columns.values(), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                found = ({"path": file["path"]} | r for r in xlsx_records(file["content"], sheet, columns, skip_rows))
                while held := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    rows = files.mapInArrow(run, "path string, row int, " + ", ".join(f"{c} string" for c in columns.values()))
    return rows.repartition(F.col("path"), F.col("row"))


#: An audit sheet's columns.
AUDIT_COLUMNS = ("dmc_ref", "photo_pack", "photo_dmc", "check_type")


def audit_rows(spark: SparkSession, path: str, sheet: str, letters: tuple[str, str, str, str], skip_rows: int = 1, check_type: str | None = None, keep_empty: bool = False, limit: int | None = None) -> DataFrame:
    """(path, row, dmc_ref, photo_pack, photo_dmc, check_type) of the sheets' rows, from the columns of these letters: those
    of one check type where it is given, without rows that have neither a reference nor a photo unless keep_empty is
    set, and the first limit of each workbook where that is given."""
    rows = read_workbook_rows(spark, path, sheet, dict(zip(letters, AUDIT_COLUMNS, strict=True)), skip_rows)
    if check_type is not None:
        rows = rows.where(F.col("check_type") == check_type)
    if not keep_empty:
        rows = rows.where(F.coalesce(*AUDIT_COLUMNS[:3]).isNotNull())
    if limit is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy("row"))).where(F.col("__n") <= limit).drop("__n")
