"""SimHash near-dedup (operator 2).

A fingerprint is the majority of each bit over the hashes of a text's word shingles. Fingerprints within RADIUS
bits link, and components of links are groups of near copies. With the 64 bits cut into RADIUS + 2 blocks, two
such fingerprints agree in at least two blocks, so every pair of blocks is a key (three blocks of RADIUS + 3, and so
on, where there are more fingerprints than pairs tell apart), and each key's fingerprints form shards of at most SHARD. A shard's fingerprints are held in a BK-tree whose children are keyed by their integer
Hamming distance to the parent; a query at distance d follows only the edges d - RADIUS to d + RADIUS. Shard trees
go to the tasks that hold their queries by the exchange on the key, not through the driver, since their number
grows with the corpus. A task gives a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillmark.llm import shared_files
from quillmark.llm.block_store import MESSAGE, deliver, pack, read_block, unpack, write_blocks
from quillmark.llm.common import checkpoint, slices
from quillmark.llm.graph import components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of one shard; fingerprints searched together in a task; fingerprints that share a key by chance.
SHARD, TOGETHER, PER_KEY = 4096, 150_000, 16
#: Bytes of text that a worker handles at once, shingles counted at once, tree nodes visited at once.
SLICE, COUNTED, VISITED = 4 << 20, 1 << 16, 2_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    words = text.lower().split()  # bytes: A-Z, and the white space \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        pieces = [joined]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends)]
        pieces = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), "<u8", len(pieces))
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ids: list[Column], shingle: int = SHINGLE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The given columns of every row, then fp long: its text's fingerprint (null: as the empty text). No shuffle."""
    own = docs.select(*ids, F.col(text_col).alias("__text"))
    fields = own.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(fields), SLICE):
                texts = batch.column(len(fields)).cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(x or b"", shingle, seed) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*(f.name for f in fields), "fp"])

    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"]))


class BkForest:
    """BK-trees of many groups in flat arrays; a group's first member is its root."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group ascends from 0 without gaps; values within a group differ."""
        n = len(value)
        self.value, parent, edge = value, np.full(n, -1, np.int64), np.zeros(n, np.int64)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        self.root = first
        at = first[group] if n else np.zeros(0, np.int64)
        todo = np.flatnonzero(at != np.arange(n))
        while len(todo):
            d = np.bitwise_count(value[todo] ^ value[at[todo]]).astype(np.int64)
            key = at[todo] * 65 + d
            _, head, back = np.unique(key, return_index=True, return_inverse=True)
            nodes = todo[head]  # the first with this distance to this parent becomes its child
            parent[nodes], edge[nodes] = at[nodes], d[head]
            at[todo] = nodes[back]
            todo = todo[at[todo] != todo]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65 + edge[child]
        by = np.argsort(key, kind="stable")
        self.child, self.key = child[by], key[by]

    def within(self, value: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes of the query's tree within the radius."""
        q, node = np.arange(len(value)), root
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = np.bitwise_count(value[q] ^ self.value[node]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit]))
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            q, node = np.repeat(q, n), self.child[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest_links(group: np.ndarray, value: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, representative) of the links in each group, between members in tree and all others
    of the group; where all of a group are in its tree, of all its links."""
    n = len(value)
    inside = np.flatnonzero(tree)
    forest = BkForest(np.cumsum(np.concatenate([[0], group[inside][1:] != group[inside][:-1]])), value[inside])
    groups = group[inside][forest.root]
    whole = np.ones(int(group.max()) + 1, bool)
    whole[group[~tree]] = False
    asking = np.flatnonzero(~tree | whole[group])
    place = np.searchsorted(groups, group[asking])
    known = (place < len(groups)) & (groups[np.minimum(place, len(groups) - 1)] == group[asking])
    asking, place = asking[known], place[known]
    size = np.bincount(group[inside], minlength=int(group.max()) + 1)[group[asking]]
    label, load = np.arange(n), np.cumsum(size)
    at = 0
    while at < len(asking):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + VISITED, side="right")))
        q, node = forest.within(value[asking[at:to]], forest.root[place[at:to]], radius)
        a, b = asking[at:to][q], inside[node]
        while True:  # least labels travel over the links
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != label[label]).any():
                label = label[label]
        at = to
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _searcher(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """rows: key, i, j, part, fp in order; whole groups."""
            new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            rows, group = rows[many], group[many]
            if not len(rows):
                return
            group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
            value = rows[:, 4].copy().view(np.uint64)
            a, b = _forest_links(group, value, rows[:, 3] == rows[:, 1], radius)
            yield pa.RecordBatch.from_arrays([pa.array(rows[a, 4]), pa.array(rows[b, 4])], ["a", "b"])

        for batch in batches:
            rest.append(np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns], 1))
            if sum(map(len, rest)) >= TOGETHER:
                rows = np.concatenate(rest)
                cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
                if len(cut):
                    yield from search(rows[: cut[-1] + 1])
                    rows = rows[cut[-1] + 1 :]
                rest = [rows]
        if rest and sum(map(len, rest)):
            yield from search(np.concatenate(rest))

    return run


def links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD, agree: int | None = None) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct longs fp within radius bits.

    agree: blocks of bits that make a key; where it isn't given, it grows with the number of values, so that a key
    holds about PER_KEY of them at most.
    """
    if agree is None:
        agree, many = 2, values.count()
        while many > PER_KEY << (64 * agree // (radius + agree)):
            agree += 1
    blocks = radius + agree
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [F.xxhash64(F.lit(k), *(bits[i] for i in of)) for k, of in enumerate(combinations(range(blocks), agree))]
    keyed = values.select("fp", F.explode(F.array(*keys)).alias("key"))
    heavy = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("key", F.ceil(F.col("n") / shard).alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))
    dealt = keyed.join(heavy, "key", "left").select("fp", "key", own.alias("part"), other.alias("other")).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    n = max(8, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "fp").mapInArrow(_searcher(radius), "a long, b long")


def near_groups(marked: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id): each distinct fp with the least id of its component. What is joined on a component was
    written before, so that Spark may split the join where one component is very large."""
    least = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("id")))
    roots = components(links(least.select("fp"), radius))
    rooted = checkpoint(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root")))
    first = checkpoint(rooted.groupBy("root").agg(F.min("id").alias("component_id")))
    return rooted.join(first, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group near copies.

    Returns (doc_id, fingerprint: 16 lowercase hex digits, component_id: the least id reachable over links, its
    own included), one row for each row of docs, repeated rows and null ids included; a component of null ids alone
    has a null id. A null text counts as the empty one, whose fingerprint is zero and links like any other. Texts
    are lower-cased (A-Z) and cut at ASCII white space; fewer words than a shingle form one; very long texts are
    taken whole, COUNTED shingles at a time. An empty table gives an empty one. Other columns are not read.
    """
    marked = checkpoint(fingerprints(docs, [F.col(id_col).alias("doc_id")], shingle, seed, text_col))
    groups = near_groups(marked, "doc_id", radius)
    return marked.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _told(shingle: int, seed: int) -> Callable[[pa.RecordBatch], bytes]:
    """What a block says of its rows (column 0 the id, 1 the text): fingerprints, ids, which ids are missing."""

    def told(block: pa.RecordBatch) -> bytes:
        fp = np.array([fingerprint(x or b"", shingle, seed) for x in block.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        missing = block.column(0).is_null().to_numpy(False)
        return pack(fp.view(np.int64), block.column(0).fill_null(0).to_numpy(False).astype(np.int64), missing.view(np.uint8))

    return told


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of blocks to a row for each of their rows: fp, and its place in the order of what stays."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            fp, ids, missing = unpack(data)
            order = pa.StructArray.from_arrays([pa.array(missing.view(bool)), pa.array(ids), pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32))], ["none", "id", "block", "place"])
            yield pa.RecordBatch.from_arrays([pa.array(fp), order], ["fp", "order"])


def _give(folder: str) -> Callable[[int, list[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]]:
    def run(block: int, got: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        stay = sorted(int.from_bytes(data) for kind, _, data in got if kind)
        if stay:
            rows = read_block(folder, block).take(pa.array(stay))
            yield pa.RecordBatch.from_arrays(rows.columns[2:], rows.schema.names[2:])

    return run


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the row with the least id (null last), one of those that share it.

    Ids are integers; null and repeated ids, null, empty and very long texts, repeated rows and columns of any names
    pass; an empty table gives an empty one. Rows are written once, as blocks in the shared folder, and known by their
    place there, so it doesn't matter if docs give them in another order when read again.
    """
    folder, names = shared_files.new_folder(docs.sparkSession, "near-copies"), docs.columns
    own = docs.select(F.col(id_col).cast("long"), F.col(text_col), *(docs[f"`{c}`"] for c in names)).toDF("id", "own", *(f"c{i}" for i in range(len(names))))
    stored = checkpoint(own.mapInArrow(write_blocks(folder, 1, _told(shingle, seed)), MESSAGE))
    marked = stored.mapInArrow(_marks, "fp long, order struct<none:boolean,id:long,block:long,place:int>")
    kept = near_groups(marked, "order", radius).select("component_id.block", "component_id.place").distinct()
    stay = kept.select(F.col("block").alias("to"), F.lit(1).alias("kind"), F.col("block").alias("src"), F.unhex(F.lpad(F.hex("place"), 8, "0")).alias("data"))
    out = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return deliver(stored.unionByName(stay), max(8, stored.count()), _give(folder), out).toDF(*names)
