"""Exact top-k search (operator 8): exhaustive term-at-a-time accumulation.

A vector's dimensions are terms; a dimension's postings are the weights of the vectors that have it. A query row
holds its non-zero terms; each scatters query weight times posting weight into a dense array of scores, one for
each vector of the task's block. A partition selection takes the k best of a block, and the blocks' results merge.
Queries are sent to the executors in blocks of bounded size; all candidate rows are scored for every query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import shared_files
from quillmark.llm.block_store import pack, unpack
from quillmark.llm.common import checkpoint

#: Terms (dimensions of queries) of a file; candidate rows scored at once.
QUERY_TERMS, ROWS = 4_000_000, 1 << 16
SCALE = 256


def quantised(col: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; null where the vector is null or a component null or not finite."""
    doubles = F.transform(col, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(doubles, lambda x: F.floor(scale * x)))


class Postings:
    """The postings of a block of vectors, by term; absent and zero weights have none."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
        self.n, size = len(ids), np.diff(offsets)
        row, term = np.repeat(np.arange(self.n), size), np.arange(len(weights)) - np.repeat(offsets[:-1], size)
        there = weights != 0
        row, term, weights = row[there], term[there], weights[there]
        by = np.argsort(term, kind="stable")
        self.row, self.weight = row[by], weights[by]
        self.start = np.searchsorted(term[by], np.arange(int(term.max()) + 2 if len(term) else 1))
        self.largest = int(np.abs(weights).max()) if len(weights) else 0

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dense scores of one query; terms differ."""
        kind = np.int64 if self.largest * int(np.abs(weights).max(initial=0)) * max(1, len(terms)) < 2**63 else object
        out = np.zeros(self.n, kind)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if t + 1 < len(self.start):
                a, b = self.start[t], self.start[t + 1]
                if b - a == self.n:  # a posting for every row: rows are in order
                    out += self.weight[a:b].astype(kind) * w
                else:
                    out[self.row[a:b]] += self.weight[a:b].astype(kind) * w
        return out


def best(scores: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
    """Places of the k highest scores, ties to earlier places, without those in skip; in no particular order."""
    places = np.arange(len(scores))
    if len(skip):
        places = np.delete(places, skip)
        scores = scores[places]
    if len(scores) <= k:
        return places
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > floor)
    return places[np.concatenate([above, np.flatnonzero(scores == floor)[: k - len(above)]])]


def _query_writer(folder: str, query_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Query rows to files of at most so many terms: ids, terms of each, terms, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid4().hex}.queries"
            ids, terms, weights = zip(*held, strict=True)
            shared_files.write(f"{folder}/{name}", [pack(np.array(ids, np.int64), np.array([len(t) for t in terms], np.int64), np.concatenate(terms), np.concatenate(weights))])
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for batch in batches:
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = v.values.to_numpy(False).astype(np.int64)
                terms = np.flatnonzero(w)
                held.append((q, terms, w[terms]))
                size += len(terms) + 1
                if size >= query_terms:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _worker(folder: str, names: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()})

    def search(held: Postings, ids: np.ndarray, first: np.ndarray, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asked, many, terms, weights = unpack(bytes(shared_files.read_all(f"{folder}/{name}")))
        at = 0
        for q, n in zip(asked.tolist(), many.tolist(), strict=True):
            scores = held.scores(terms[at : at + n], weights[at : at + n])
            at += n
            if len(first) < len(ids):  # rows that share an id: the highest counts
                scores = np.maximum.reduceat(scores, first)
            own = np.searchsorted(ids[first], q)
            top = best(scores, k, np.array([own] if own < len(first) and ids[first[own]] == q else [], np.int64))
            yield np.full(len(top), q), ids[first[top]], scores[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = batch.column(0).to_numpy()
                by = np.argsort(ids, kind="stable")  # so earlier places have smaller ids
                vectors = batch.column(1).take(pa.array(by))
                ids = ids[by]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                held = Postings(ids, np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())]), vectors.flatten().to_numpy())
                for name in names:
                    got = list(search(held, ids, first, name))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_terms: int = QUERY_TERMS) -> DataFrame:
    """Each query's k highest integer inner products with all other rows.

    Returns (query_id, rank from 1, vec_id, score), at most k rows a query, ties to the smaller vec_id; fewer if
    there are fewer candidates. Queries are the rows for which is_query holds. A row is known by its id: rows that share
    one are a single item with several vectors, which is no candidate of its own and scores as its best pair of vectors;
    repeated query rows of one id and vector are asked once. Rows whose id is null, whose vector is null, or that hold a
    null or non-finite component take no part. Dimensions that one vector lacks count as zero; very long vectors have a
    file of queries of their own. Components are floor(scale * x). An empty table, or one without queries, gives an
    empty result. Other columns are not read, whatever their names. A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    folder = shared_files.new_folder(spark, "queries")
    written = checkpoint(own.where("asks").select("id", "v").distinct().mapInArrow(_query_writer(folder, query_terms), "name string"))
    names = sorted(r["name"] for r in written.collect())  # one for each query_terms terms
    if not names:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = own.select("id", "v").mapInArrow(_worker(folder, names, k), "query_id long, vec_id long, score long")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
