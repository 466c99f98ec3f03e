"""Token counts (operator 9): lengths of documents in flat token files that have no index.

A flat file is a run of fixed-size ids in which an end-of-document id closes every document. Blocks of a file are
read by offset and scanned at once for the separator. A document may span blocks: the place of the last separator
before a block is a prefix scan (a running maximum) over the blocks' last separators, one row for each block, so
no task holds a whole file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import shared_files
from quillmark.llm.byte_codec import codec
from quillmark.llm.common import checkpoint, slices

#: Bytes of a block, bytes of a written file beyond which the next one begins, bytes of text encoded at once.
BLOCK, FILE, SLICE = 1 << 20, 32 << 20, 4 << 20


def _scan(separator: int, width: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = min(block, length - k * block)
                ids = np.frombuffer(shared_files.read(path, k * block, size), kind)
                ends = np.flatnonzero(ids == separator) + k * (block // width)
                inner = np.diff(ends) - 1
                yield pa.RecordBatch.from_pydict(
                    {"file": [path], "block": [k], "first": [int(ends[0]) if len(ends) else None], "last": [int(ends[-1]) if len(ends) else None], "n": [len(ends)], "rest": [(length // width) if (k + 1) * block >= length else None], "inner": [inner]},
                    schema=pa.schema({"file": pa.string(), "block": pa.int64(), "first": pa.int64(), "last": pa.int64(), "n": pa.int64(), "rest": pa.int64(), "inner": pa.list_(pa.int64())}),
                )

    return run


def count_tokens(spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK, pattern: str = "*.bin") -> DataFrame:
    """(file, place from 0, n_tokens without the separator, ended) of every document in the flat files of a folder.

    Ids are little-endian unsigned integers of width 2 or 4 bytes. What follows a file's last separator is a
    document that hasn't ended; an empty document counts 0; an empty file has none. A file whose size isn't a
    multiple of width raises an error.
    """
    if block % width:
        raise ValueError("a block holds whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    odd = F.raise_error(F.concat(F.lit("not whole ids: "), F.col("path")))
    files = files.select("path", F.when(F.col("length") % width == 0, F.col("length")).otherwise(odd.cast("long")).alias("length")).where("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("k"))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "file string, block long, first long, last long, n long, rest long, inner array<long>"
    scanned = checkpoint(blocks.repartition(n, "path", "k").mapInArrow(_scan(separator, width, block), schema))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = scanned.join(carried, ["file", "block"])
    head = F.when(F.col("n") > 0, F.array(F.col("first") - F.col("previous") - 1)).otherwise(F.array().cast("array<long>"))
    closed = rows.select("file", "base", F.posexplode(F.concat(head, "inner")).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("place"), "n_tokens", F.lit(True).alias("ended"))
    last = rows.where(F.col("rest").isNotNull())
    open_length = F.col("rest") - F.coalesce("last", "previous") - 1
    opened = last.select("file", (F.col("base") + F.col("n")).alias("place"), open_length.alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return closed.unionByName(opened)


def _writer(path: str, separator: int, folder: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, k = codec(path, False), TaskContext.get().partitionId(), 0
        end = separator.to_bytes(2 if own.kind == "H" else 4, "little")
        held: list[bytes] = []
        listed: list[object] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{k:06d}.bin"
            shared_files.write(name, held)
            short = name.rpartition("/")[2]
            return pa.RecordBatch.from_arrays([pa.array([short] * len(listed), pa.string()), pa.array(range(len(listed)), pa.int64()), pa.array(listed, kind)], ["name", "place", "doc_id"])

        for whole in batches:
            kind = whole.column(0).type
            for batch in slices(whole, 1, SLICE):
                for i, ids in zip(batch.column(0).to_pylist(), own.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    held += [ids, end]
                    listed.append(i)
                    size += len(ids) + len(end)
                    if size >= most:
                        yield flush()
                        held, listed, size, k = [], [], 0, k + 1
        if held:
            yield flush()

    return run


def document_token_counts(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode documents to flat files (special tokens in texts are ordinary text, so the separator stays alone),
    then count tokens from the files alone: (doc_id, n_tokens), one row for each row of docs.

    A null or empty text has 0 tokens; null and repeated ids pass; very long texts are written whole; an empty table
    gives an empty one. Ids take as many bytes as the vocabulary needs. The files follow the input's partitions, without
    a shuffle; which row stands at which place is kept beside them, and a file that can't be found is an error.
    """
    spark = docs.sparkSession
    folder = shared_files.new_folder(spark, "flat-tokens")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    listed = checkpoint(own.mapInArrow(_writer(tokenizer, separator, folder, FILE), f"name string, place long, doc_id {kind}"))
    if listed.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, n_tokens long")
    width = 2 if codec(tokenizer, False).kind == "H" else 4
    counted = count_tokens(spark, folder, separator, width, block).where("ended").select(F.element_at(F.split("file", "/"), -1).alias("name"), "place", "n_tokens")
    lost = F.raise_error(F.concat(F.lit("not in the shared folder: "), F.col("name"))).cast("long")
    return listed.join(counted, ["name", "place"], "left").select("doc_id", F.coalesce("n_tokens", lost).alias("n_tokens"))
