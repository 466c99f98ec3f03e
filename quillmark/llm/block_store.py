"""Blocks of rows in the shared folder, and packed messages between them.

Where every word of a corpus has something to ask of all others, one row for each question costs far more than the
text. Here rows are written as blocks of bounded size; a block's task reads it, packs what it asks into one message
for each bucket of hash values, and gets one message back from each. Asked values are different ones within a block,
so a value that a third of all rows hold reaches a bucket once from each block, and no bucket or block grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmark.llm import shared_files
from quillmark.llm.common import give_back, slices

#: Bytes of text of a block; blocks that one task writes at most; level of their compression.
BLOCK, PER_TASK, LEVEL = 8 << 20, 1 << 16, 6
#: A message: the block or bucket that it goes to, what it is, the block or bucket that it comes from, its content.
MESSAGE = "to long, kind int, src long, data binary"
_SCHEMA = pa.schema({"to": pa.int64(), "kind": pa.int32(), "src": pa.int64(), "data": pa.binary()})

Message = tuple[int, int, int, bytes]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers by byte planes, compressed; planes of zeros at the top are left out."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
        width = x.itemsize
        while width and not planes[width - 1].any():
            width -= 1
        out += [np.array([len(x)], "<u8").tobytes(), x.dtype.str[1:].encode(), bytes([width]), planes[:width].tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack was given."""
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        n, kind, width = int(np.frombuffer(raw, "<u8", 1, at)[0]), np.dtype("<" + raw[at + 8 : at + 10].decode()), raw[at + 10]
        planes = np.zeros((kind.itemsize, n), np.uint8)
        planes[:width] = np.frombuffer(raw, np.uint8, n * width, at + 11).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 11 + n * width
    return out


def pack_sorted(values: np.ndarray) -> np.ndarray:
    """Ascending unsigned values as differences, which pack well."""
    return np.diff(values, prepend=values.dtype.type(0))


def messages(rows: list[Message]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def file_of(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}.arrow"


def write_blocks(folder: str, text: int, also: Callable[[pa.RecordBatch], bytes], size: int = BLOCK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches to files of about so many bytes of the column at text, whole rows, and one message from each block to
    itself with what also says. A block's number holds its task attempt's, so a repeated task never replaces a file
    that others already know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().taskAttemptId() * PER_TASK
        number, held, held_size = first, [], 0

        def flush() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as f:
                f.write_batch(block)
            if number >= first + PER_TASK:
                raise ValueError("too many blocks in one partition")
            shared_files.write(file_of(folder, number), [sink.getvalue()])
            return messages([(number, 0, block.column(text).nbytes, also(block))])

        for whole in batches:
            for batch in slices(whole, text, size):
                own = batch.column(text).nbytes
                if held and held_size + own > size:
                    yield flush()
                    number, held, held_size = number + 1, [], 0
                held.append(batch)
                held_size += own
        if held:
            yield flush()

    return run


def read_block(folder: str, block: int) -> pa.RecordBatch:
    with pa.ipc.open_stream(shared_files.read_all(file_of(folder, block))) as f:
        return f.read_next_batch()


def deliver(sent: DataFrame, parts: int, answer: Callable[[int, list[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema: str = MESSAGE) -> DataFrame:
    """Bring messages to where they go; answer gets the receiver's number and all (kind, source, content) for it, in
    that order, and gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, []
        for batch in batches:
            for to, kind, src, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != at:
                    if got:
                        yield from answer(at, got)
                        give_back()
                    at, got = to, []
                got.append((kind, src, data))
        if got:
            yield from answer(at, got)
        got = []
        give_back()

    return sent.repartition(parts, "to").sortWithinPartitions("to", "kind", "src").mapInArrow(run, schema)


def bucket_cuts(values: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where the buckets begin and end in ascending unsigned values of so many bits."""
    top = values >> np.uint64(bits - 32) if bits > 32 else values << np.uint64(32 - bits)
    return np.searchsorted((top * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
