"""Benchmark decontamination (operator 4).

The words of the benchmark's items form windows (test phrases) of WINDOW consecutive words. Each task takes its
documents in shards and builds an FM-index of each: the words that occur in no phrase act as separators, runs of
phrase words are the index's text, its suffix array gives the Burrows-Wheeler transform, and a wavelet matrix over
that answers ranks. All phrases search backwards together; the rows that remain are located by walking back to
sampled suffix positions, and the found occurrences are merged into removal spans.

Leaving separators out is exact: an occurrence of a phrase is a run of phrase words at least as long as the phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import slices
from quillmark.llm.succinct import BitPlane, WaveletMatrix

WINDOW = 13
#: Bytes of text in a shard, and of benchmark text in a block that executors get at once.
SHARD, BLOCK = 24 << 20, 4 << 20
#: Every so many text positions a suffix position is kept.
SAMPLE = 8

#: Word characters are 0-9, A-Z (lower-cased), a-z and all beyond ASCII; every other byte separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """The windows of some items: words get symbols from 1, and each distinct window knows its items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str | None] = []
        number: dict[str | None, int] = {}
        for name, text in items:
            words = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            if words:
                k = number.setdefault(name, len(number))
                for i in range(max(1, len(words) - window + 1)):
                    owners.setdefault(tuple(words[i : i + window]), set()).add(k)
        self.ids = list(number)
        self.sizes = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.sizes.min()) if owners else 0
        self.codes = np.zeros((len(owners), max(window, 1)), np.int64)  # right-aligned
        for i, w in enumerate(owners):
            self.codes[i, -len(w) :] = w
        self.owner_start = np.cumsum([0, *(len(x) for x in owners.values())])
        self.owner = np.array([k for x in owners.values() for k in sorted(x)], np.int64)


class FmIndex:
    """FM-index of a text of symbols from 1 in which 0 ends every run; no search crosses a 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = self._suffixes(text)
        before = text[order - 1]  # of the suffix at 0 that is the last symbol, a 0
        self.levels = max(1, int(text.max()).bit_length())
        self.bwt = WaveletMatrix.of(before.astype(np.uint32), self.levels)
        self.start = np.cumsum(np.concatenate([[0], np.bincount(text, minlength=2)]))
        ends = np.flatnonzero(text == 0)
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE] = True
        sampled[0] = True
        sampled[ends] = True
        sampled[np.minimum(ends + 1, n - 1)] = True  # a walk back stops where its run begins
        self.mark = BitPlane.of(sampled[order])
        self.kept = order[sampled[order]]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; the zeros are all different, in order of place, so runs end there."""
        n, ends = len(text), np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends) - 1
        rank[ends] = np.arange(len(ends))
        k = 1
        order = np.argsort(rank, kind="stable")
        todo = order
        # ranks: the number of suffixes that are smaller, so a group's ranks stay apart as it is split
        value = rank[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        while True:
            group = rank[order]
            same = np.zeros(n, bool)
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= group[:-1] == group[1:]
            places = np.flatnonzero(same)
            if not len(places):
                return order
            todo = order[places]
            key = rank[todo] * (n + 1) + rank[np.minimum(todo + k, n - 1)]
            by = np.argsort(key, kind="stable")
            order[places] = todo[by]
            key = key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.flatnonzero(new)
            rank[order[places]] = np.repeat(places[begin], np.diff(np.append(begin, len(places))))
            k *= 2

    def search(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of right-aligned phrases: (phrase, low row, high row) of those that occur."""
        which = np.flatnonzero(codes[:, -1] < len(self.start) - 1)
        lo, hi = self.start[codes[which, -1]], self.start[codes[which, -1] + 1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(1, codes.shape[1] + 1):
            live = hi > lo
            which, lo, hi = which[live], lo[live], hi[live]
            over = sizes[which] == j
            found.append((which[over], lo[over], hi[over]))
            which, lo, hi = which[~over], lo[~over], hi[~over]
            if not len(which):
                break
            c = codes[which, -j - 1]
            known = c < len(self.start) - 1
            which, lo, hi, c = which[known], lo[known], hi[known], c[known]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.start[c] + both[: len(c)], self.start[c] + both[len(c) :]
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))  # type: ignore[return-value]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled position."""
        out, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            there = self.mark.get(row)
            out[todo[there]] = self.kept[self.mark.rank1(row[there])] + steps
            todo, row = todo[~there], row[~there]
            c = self.bwt.access(row)
            row = self.start[c] + self.bwt.rank(c, row)
            steps += 1
        return out


def runs_text(codes: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The index's text, each long enough run of symbols followed by a 0, and the place of each of its symbols."""
    inside = np.diff(np.concatenate([[0], codes > 0, [0]]).astype(np.int8))
    a, b = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    a, b = a[b - a >= shortest], b[b - a >= shortest]
    size = b - a + 1  # with the 0
    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text = np.where(np.repeat(b, size) > at, codes[np.minimum(at, len(codes) - 1)], 0) if len(a) else np.zeros(0, codes.dtype)
    return text, at


def search_shard(texts: list[bytes], blocks: Iterator[Phrases]) -> list[tuple[int, list[tuple[int, int]], list[str | None]]]:
    """(words, merged spans of word places, ids of the items found) of each text."""
    first, bound, cover, found, sizes = True, np.zeros(0, np.int64), np.zeros(0, np.int32), [], None
    items: list[set[str | None]] = [set() for _ in texts]
    for block in blocks:
        known = block.symbol.get
        parts = []
        for t in texts:
            w = words_of(t)
            parts.append(np.fromiter(map(known, w, repeat(0)), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))  # texts stay apart
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if first:
            sizes = np.array([len(p) for p in parts[::2]], np.int64)
            bound = np.cumsum(sizes + 1) - sizes - 1
            cover, first = np.zeros(len(codes) + 1, np.int32), False
        del parts
        if not len(block.sizes):
            continue
        text, place = runs_text(codes, block.shortest)
        if not len(text):
            continue
        index = FmIndex(text)
        which, lo, hi = index.search(block.codes, block.sizes)
        n = hi - lo
        phrase = np.repeat(which, n)
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = place[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.sizes[phrase], -1)
        doc = np.searchsorted(bound, at, side="right") - 1
        own = np.unique(doc * len(block.sizes) + phrase)  # each phrase of a document once, before its owners
        doc, phrase = own // len(block.sizes), own % len(block.sizes)
        for d in np.unique(doc).tolist():
            found = phrase[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")].tolist()
            items[d].update(block.ids[k] for k in set().union(*(block.owner[block.owner_start[p] : block.owner_start[p + 1]].tolist() for p in found)))
    if first:
        return [(len(words_of(t)), [], []) for t in texts]
    edge = np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(bound, a, side="right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, x, y in zip(doc.tolist(), (a - bound[doc]).tolist(), (b - bound[doc]).tolist(), strict=True):
        spans[d].append((x, y))
    return [(int(n), s, sorted(i, key=lambda x: (x is None, x or ""))) for n, s, i in zip(sizes, spans, items, strict=True)]


def _worker(blocks: list, window: int, extra: list[str], text: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def phrases() -> Iterator[Phrases]:
        for b in blocks:
            yield Phrases(b.value, window)
            b.__dict__.pop("_value", None)  # read again from the worker's file where it is needed again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[Phrases] = []
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = [x or b"" for x in whole.column(text).cast(pa.binary()).to_pylist()]
            if len(blocks) == 1 and not keep:
                keep.extend(phrases())
            got = search_shard(texts, iter(keep) if keep else phrases())
            cols = [whole.column(c).combine_chunks() for c in extra]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in got]
            cols += [pa.array([g[0] for g in got], pa.int64()), pa.array([sum(b - a for a, b in g[1]) for g in got], pa.int64()), pa.array(spans, schema.field("spans").type), pa.array([g[2] for g in got], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=schema.names)

        for whole in batches:
            for part in slices(whole, whole.schema.get_field_index(text), SHARD):
                held.append(part)
                size += part.column(text).nbytes
                if size >= SHARD:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, null_items: bool = False) -> list:
    """Broadcast variables of (id, text) rows, of BLOCK bytes of text each; the driver holds one block at a time."""
    sc, out, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where((F.col(id_col).isNotNull() | F.lit(null_items)) & F.col(text_col).isNotNull())
    for name, text in rows.toLocalIterator():
        block.append((name, bytes(text)))
        size += len(text)
        if size >= BLOCK:
            out.append(sc.broadcast(block))
            block, size = [], 0
    return [*out, sc.broadcast(block)] if block else out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", item_text: str = "text", null_items: bool = False) -> DataFrame:
    """Search every window of the benchmark's items in every whole document.

    Returns the columns named in keep, then n_words, n_hit (words inside occurrences), spans (merged removal
    spans, array of (start, end) places of words, end exclusive) and items (ids of the items found, sorted as
    strings). One row for each row of docs, repeated rows and null ids included; a null or empty text has no words
    and no hits. An item of fewer words than window is one window; one without words is none; items with a null
    text take no part, nor do those with a null id unless null_items is set: then their words count in n_hit and
    spans, and together they are one item, a null at the end of items. Repeated ids count as one item. Either table may be empty. Columns of docs that are not
    named don't pass, whatever their names. Very long texts are searched whole, in a shard of their own. The benchmark
    is sent in blocks of bounded size. No shuffle.
    """
    keep_fields = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    names = [f"k{i}" for i in range(len(keep))]
    text = names[keep.index(text_col)] if text_col in keep else "text"
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), *([] if text_col in keep else [F.col(text_col).alias(text)]))
    ddl = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, keep_fields, strict=True)), "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    blocks = benchmark_blocks(benchmark, item_id, item_text, null_items)
    return own.mapInArrow(_worker(blocks, window, names, text, schema), ddl).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words, and at least one, lies in occurrences."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
