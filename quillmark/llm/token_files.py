"""Token-ID / binary output (operator 7): documents as shards of ids, one compressed file with a wavelet matrix each.

A file holds the ids of some consecutive documents (in ascending id order) as a wavelet matrix, whose bit-planes
with rank and select give token access, counting and occurrence lookup, and the documents' ids and lengths:

    4 bytes magic, 8 bytes number of documents, 8 bytes size of the deflated header, the header (64-bit document
    ids, one byte each that tells a null id, 64-bit lengths), then the wavelet matrix's own bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import shared_files
from quillmark.llm.byte_codec import codec
from quillmark.llm.common import checkpoint, slices
from quillmark.llm.succinct import WaveletMatrix

MAGIC = b"QTF1"
#: Tokens of a shard, and bytes of text that a worker encodes at once.
SHARD, SLICE = 2_000_000, 4 << 20
SHARDS = pa.schema({"part": pa.int32(), "k": pa.int32(), "file": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()})


class TokenFile:
    """One shard that was read; matrix answers access, rank (count) and select (occurrences)."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n, size = struct.unpack_from("<QQ", data, 4)
        head = zlib.decompress(data[20 : 20 + size])
        self.doc_ids = np.frombuffer(head, "<i8", n)
        self.missing = np.frombuffer(head, "u1", n, 8 * n).view(bool)
        self.lengths = np.frombuffer(head, "<i8", n, 9 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.matrix = WaveletMatrix.from_bytes(data[20 + size :])

    @staticmethod
    def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, levels: int) -> bytes:
        head = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + np.array(lengths, "<i8").tobytes()
        head = zlib.compress(head, 1)
        return MAGIC + struct.pack("<QQ", len(doc_ids), len(head)) + head + WaveletMatrix.of(ids, levels).to_bytes()


def _writer(path: str, end_id: int, folder: str, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, k = codec(path, True), TaskContext.get().partitionId(), 0
        levels = max((own.library.get_vocab_size() - 1).bit_length(), end_id.bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/part-{part:06d}-{k:06d}.qtf"
            shared_files.write(name, [TokenFile.pack(doc_ids, [len(x) for x in held], np.concatenate(held), levels)])
            return pa.RecordBatch.from_pydict({"part": [part], "k": [k], "file": [name.rpartition("/")[2]], "n_docs": [len(doc_ids)], "n_tokens": [size]}, schema=SHARDS)

        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                for i, ids in zip(batch.column(0).to_pylist(), own.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    doc_ids.append(i)
                    held.append(np.append(np.frombuffer(ids, "<u2" if own.kind == "H" else "<u4").astype(kind), kind(end_id)))
                    size += len(held[-1])
                    if size >= shard:
                        yield flush()
                        doc_ids, held, size, k = [], [], 0, k + 1
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Write the documents' ids in ascending order of id (null first; equal ids by text) to files under folder.

    Returns the written shards in order: (part, k, file, n_docs, n_tokens), already computed. Ids are integers, may
    be null or repeat; a null text counts as empty and so has the end id alone. An empty table writes no file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("text").asc_nulls_first()]
    ranged = rows.repartitionByRange(order[0], order[1]).sortWithinPartitions(*order).select("id", "text")
    return checkpoint(ranged.mapInArrow(_writer(tokenizer, end_id, folder, shard), "part int, k int, file string, n_docs long, n_tokens long"))


def read_token_files(spark: SparkSession, folder: str, digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """Read the files back: (file, place in the file, doc_id, local_start, n_tokens, ids binary as little-endian
    unsigned 32-bit integers). digest: what of the ids, as a long in their place, leaves the worker that reads them."""
    kind = pa.binary() if digest is None else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                f = TokenFile(data.as_py())
                ids = f.matrix.decode()
                for a in range(0, len(f.doc_ids), 500):
                    of = slice(a, a + 500)
                    packed = [ids[s : s + n].astype("<u4").tobytes() for s, n in zip(f.starts[of], f.lengths[of], strict=True)]
                    many = len(packed)
                    told = packed if digest is None else list(map(digest, packed))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * many, pa.string()), pa.array(range(a, a + many), pa.int32()), pa.array(f.doc_ids[of], mask=f.missing[of]), pa.array(f.starts[of]), pa.array(f.lengths[of]), pa.array(told, kind)], ["file", "place", "doc_id", "local_start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtf").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, f"file string, place int, doc_id long, local_start long, n_tokens long, ids {'binary' if digest is None else 'long'}")


def with_starts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows of read_token_files with start: the ids of all documents before, over all files. Starts of partitions
    come from one sum for each partition; those of a partition's files from a window over that partition alone."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    files = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(local), F.lit(0))).join(parts, "part").select("file", (F.col("base") + F.col("inside")).alias("file_start"))
    return rows.join(files, "file").withColumn("start", F.col("file_start") + F.col("local_start")).drop("file_start")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, ids: Column | None = None, digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """Write the files to a new folder, read them back: (doc_id, start, n_tokens, ids), one row for each row of docs.
    ids: what is asked of the column of ids; digest: what of each document's ids, as a long in their place, leaves the worker
    that reads them, which saves their way through Spark. Null and repeated ids, null, empty and very
    long texts pass; an empty table gives an empty one; a file that can't be found is an error."""
    spark = docs.sparkSession
    folder = folder or shared_files.new_folder(spark, "token-files")
    shards = write_token_files(docs, tokenizer, end_id, folder, id_col, text_col)
    ids = F.col("ids") if ids is None else ids
    if shards.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, ids {'binary' if digest is None else 'long'}").select("doc_id", "start", "n_tokens", ids.alias("ids"))
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtf").load(folder).select("path")
    if there.count() < shards.count():
        raise FileNotFoundError(f"not all token files are in {folder}")
    rows = read_token_files(spark, folder, digest).select("file", "doc_id", "local_start", "n_tokens", ids.alias("ids"))
    return with_starts(rows, shards).select("doc_id", "start", "n_tokens", "ids")
