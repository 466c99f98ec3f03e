"""SentencePiece encoding and decoding (operator 1).

Merge-type (BPE) vocabularies are encoded by a score-ordered agenda of adjacent symbol pairs: the best pair
(highest score, then leftmost) is merged, its new neighbours enter the agenda, and entries whose symbols have
changed since are skipped. No piece of a merge-type vocabulary may span from a non-space to a following space
mark, nor hold a line feed, so a text falls into chunks that are encoded one by one and remembered; every chunk
that is new to a worker is checked against the sentencepiece library, in the Arrow batch in which it appears.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import slices

SPACE = "▁"
#: Chunks that a worker remembers in each of two generations; the older one goes when the younger is full.
MEMORY = 120_000
#: Rank of a pair that doesn't merge; characters of a chunk from which its agenda is a heap of its own.
FAR, WIDEST = 2**31 - 1, 40
#: Bytes of text that a worker handles at once.
SLICE = 4 << 20


class PieceCodec:
    """Encoder and decoder for one model file; raises ValueError where the model is of another type."""

    def __init__(self, path: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds & {4, 5} or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a merge-type vocabulary with byte fallback, a leading space mark and no normalisation is needed")
        self.library = sp.SentencePieceProcessor(model_file=path)
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if sys.byteorder != "little" or any("\n" in x or re.search(f"[^{SPACE}]{SPACE}", x) for x in self.score):
            raise ValueError("pieces span chunks")
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        if any(len(x) > 1 and any(c not in self.id for c in x) for x in self.id):
            raise ValueError("pieces hold characters that aren't pieces")
        self._pairs()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk, in which spaces already are marks."""
        score, sym = self.score, list(chunk)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            if pair in score:
                todo.append((-score[pair], i, i + 1, pair))
        heapify(todo)
        while todo:
            _, a, b, pair = heappop(todo)
            if not sym[a] or not sym[b] or sym[a] + sym[b] != pair:
                continue
            sym[a], sym[b] = pair, ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if (x := pair + sym[c]) in score:
                    heappush(todo, (-score[x], a, c, x))
            p = before[a]
            if p >= 0 and (x := sym[p] + pair) in score:
                heappush(todo, (-score[x], p, a, x))
        out: list[int] = []
        for s in sym:
            if s:
                k = self.id.get(s)
                if k is None:
                    out += [self.byte[b] for b in s.encode()]
                else:
                    out.append(k)
        return out

    def keys(self, text: str) -> list[str]:
        """A text's chunks by their keys: a chunk is its key, with a space mark before it unless it begins a line."""
        if "  " in text or " \n" in text or SPACE in text or " " in (text[:1], text[-1:]):
            found = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE))
            return [x[1:] if x[0] == SPACE else x for x in found]
        return text.replace("\n", " \n").split(" ")

    def _pairs(self) -> None:
        """The table of symbol pairs that merge: open addressing, key left * 2^20 + right, to rank and symbol."""
        symbol = self.id
        self.char = np.full(0x110000, -1, np.int32)  # -1: written as several bytes
        self.char[:128] = self.byte[:128]
        for x, k in symbol.items():
            if len(x) == 1:
                self.char[ord(x)] = k
        order = {v: i for i, v in enumerate(sorted({-v for v in self.score.values()}))}
        keys, ranks, merged = [], [], []
        for x, k in symbol.items():
            for i in range(1, len(x)):
                a, b = symbol.get(x[:i]), symbol.get(x[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(order[-self.score[x]])
                    merged.append(k)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, FAR, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        slot = self._slot(np.array(keys, np.int64))
        for k, r, m, at in zip(keys, ranks, merged, slot.tolist(), strict=True):
            while self.key[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.key[at], self.rank[at], self.merged[at] = k, r, m

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of symbol pairs; the slot of a pair that doesn't merge is empty, so its rank is FAR."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        at = self._slot(key)
        todo = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            todo = todo[(self.key[at[todo]] != key[todo]) & (self.key[at[todo]] >= 0)]
        return at

    def agendas(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks: a row holds one chunk's symbols and the ranks of its adjacent pairs (its agenda);
        each round takes the best pair of every row, the leftmost among equals, merges it, and enters the new pairs."""
        out = [b""] * len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = self.char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        start = np.cumsum(size) - size
        odd = np.zeros(len(chunks), bool)
        odd[np.searchsorted(start + size, np.flatnonzero(text < 0), side="right")] = True
        odd |= (size > WIDEST) | (size == 0)
        for i in np.flatnonzero(odd):
            out[i] = array("I", self.agenda(chunks[i])).tobytes()
        rows = np.flatnonzero(~odd)
        rows = rows[np.argsort(size[rows], kind="stable")]
        for part in np.array_split(rows, max(1, len(rows) // 8000)):
            if not len(part):
                continue
            n, width = size[part].copy(), int(size[part].max())
            col = np.arange(width)
            sym = np.where(col < n[:, None], text[np.minimum(start[part][:, None] + col, len(text) - 1)], -1)
            rank = np.full((len(part), width), FAR, np.int32)
            if width > 1:
                inside = col[1:] < n[:, None]
                rank[:, :-1][inside] = self.rank[self._find(sym[:, :-1][inside], sym[:, 1:][inside])]
            while len(part):
                at = rank.argmin(1)
                here = np.arange(len(part))
                live = rank[here, at] < FAR
                if not live.all():
                    done = np.flatnonzero(~live)
                    flat, ends = sym[done][col < n[done, None]].astype("<u4").tobytes(), np.cumsum(n[done]) * 4
                    for i, a, b in zip(part[done].tolist(), (ends - n[done] * 4).tolist(), ends.tolist(), strict=True):
                        out[i] = flat[a:b]
                    part, n, sym, rank, at = part[live], n[live], sym[live], rank[live], at[live]
                    if not len(part):
                        break
                    here = here[: len(part)]
                whole = self.merged[self._find(sym[here, at], sym[here, at + 1])]
                take = np.minimum(col + (col > at[:, None]), width - 1)
                sym, rank = np.take_along_axis(sym, take, 1), np.take_along_axis(rank, take, 1)
                rank[:, -1] = FAR
                n -= 1
                sym[here, at] = whole
                follows = at + 1 < n
                rank[here, at] = FAR
                rank[here[follows], at[follows]] = self.rank[self._find(whole[follows], sym[here[follows], at[follows] + 1])]
                leads = at > 0
                rank[here[leads], at[leads] - 1] = self.rank[self._find(sym[here[leads], at[leads] - 1], whole[leads])]
        return out

    def learn(self, new: list[str]) -> None:
        """Encode chunks by their agendas, check them against the library, remember them."""
        told = self.library.encode(new, num_threads=1)
        mark = len(self.agenda(SPACE))
        own = self.agendas([x if x[:1] == "\n" else SPACE + x for x in new])
        for x, ids, mine in zip(new, told, own, strict=True):
            # the library puts a mark in front of whatever it is given
            if x and array("I", ids[mark:] if x[0] == "\n" else ids).tobytes() != mine:
                raise AssertionError(f"the agenda and the library differ on {x!r}")
            self.young[x] = mine

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, with the begin and end ids."""
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        begin, end, young = struct.pack("<I", self.bos), struct.pack("<I", self.eos), self.young
        cut = [self.keys(x) if x else [] for x in texts]
        missing: set[str] = set().union(*cut) - young.keys()
        for x in missing & self.old.keys():
            young[x] = self.old[x]
        self.learn(list(missing - young.keys()))
        return [begin + b"".join(map(young.__getitem__, x)) + end for x in cut]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One for each worker process, which keeps it over its tasks."""
    return PieceCodec(path)


def _worker(path: str, decode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids = own.encode_batch([x or "" for x in batch.column(1).to_pylist()])
                cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decode:
                    cols.append(pa.array([own.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Encode whole texts, and decode the ids again.

    Returns (doc_id, n_tokens long, ids binary: little-endian unsigned 32-bit with begin and end ids, decoded
    string). One row for each row of docs: repeated rows repeat, a null id stays null, a null or empty text gives
    the begin and end ids alone and decodes to the empty text, an empty table gives an empty one. Other columns
    of docs don't pass. Texts of any length are taken whole. No shuffle.
    """
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decode
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_worker(model, decode), schema)


def decode_ids(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode packed ids (as encode_documents gives them) to (doc_id, decoded); null ids give the empty text."""
    kind = df.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")
