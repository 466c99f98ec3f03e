"""Toxicity (operator 10): a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all character triples that occur in both, with gaps, the decayed spans of their
occurrences, so an insult still matches with characters left out or put in; words are reduced to their letters
first ("i.d-i.o t" is one word). A label is its document's: in a clean document every word of every sentence is clean; in
a toxic one only some word of some sentence need be, so witness words are chosen (by their association with the label,
then the machine's own choice in each document) and the hardest words of clean documents join the training set. The
machine's rows are these words, not whole sentences, whose kernel drowns one word in all others (README has figures); so
a sentence scores as its worst word, a document as its worst sentence, and a logistic fit gives the score.

The kernel's features are explicit, so the landmarks' weights fold into one table of triples, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpoint, slices

#: Rows of each label that are trained on at most, in the order of a hash of their id.
TRAIN_ROWS = 2000
#: Landmarks of each kind, clean words drawn by hash, hardest clean words added in each round, rounds.
LANDMARKS, CLEAN, HARD, ROUNDS = 64, 4000, 1500, 3
#: Kernel: decay of a span, longest span of a triple; codes of characters, word start and word end.
DECAY, SPAN, CODES, START, END = 0.6, 6, 40, 38, 39
#: Labels may be wrong: the signed root of a first witness's log-likelihood ratio is at least LEAN, and no witness is
#: less than ODDS times as frequent in toxic rows as in clean ones.
LEAN, ODDS = 4.0, 5.0
#: A word of more letters is taken in overlapping windows of so many.
LONGEST = 48
#: Bytes of text that a worker handles at once; tokens that it remembers.
SLICE, MEMORY = 4 << 20, 150_000
THRESHOLD = 0.3

_SHAPES = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


def units(token: str) -> list[str]:
    """The words of one token: its letters, lower-cased; long ones in overlapping windows."""
    word = "".join(filter(str.isalpha, token.lower()))
    if len(word) <= LONGEST:
        return [word] if word else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def tokens(text: str) -> list[str]:
    """Tokens between white space, and each run of three or more one-character tokens as one more token."""
    found = text.split()
    ones = [len(x) == 1 for x in found]
    if sum(ones) < 3:
        return found
    run: list[str] = []
    more = []
    for x in [*(x if one else "" for x, one in zip(found, ones, strict=True)), ""]:
        if x:
            run.append(x)
        else:
            if len(run) >= 3:
                more.append("".join(run))
            run = []
    return found + more


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, each with its start and end mark, and where each begins."""
    text = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.where((text >= 97) & (text <= 122), text - 97, 26 + text * 7919 % 12)
    begin = np.cumsum(size + 2) - size - 2
    out = np.full(len(text) + 2 * len(words), START, np.int64)
    out[begin + size + 1] = END
    out[np.arange(len(text)) + np.repeat(2 * np.arange(len(words)) + 1, size)] = code
    return out, begin


def _triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every shape of a triple: places where it begins, the triples there, the weight of the shape."""
    code, begin = _codes(words)
    end = np.repeat(np.append(begin[1:], len(code)), np.diff(np.append(begin, len(code))))
    place = np.arange(len(code))
    for a, b in _SHAPES:
        at = place[place + a + b < end]
        yield at, (code[at] * CODES + code[at + a]) * CODES + code[at + a + b], DECAY ** (a + b + 1)


def _norms(words: list[str]) -> np.ndarray:
    """By length: the square root of the sum of squared weights of a word's triples."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.sqrt(sum(np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in _SHAPES))


def features(word: str) -> np.ndarray:
    """The word's normalised feature vector, dense."""
    out = np.zeros(CODES**3)
    for _, u, w in _triples([word]):
        np.add.at(out, u, w)
    return out / _norms([word])[0]


def project(words: list[str], table: np.ndarray) -> np.ndarray:
    """Inner products of the words' normalised features with a table over triples."""
    if not words:
        return np.zeros(0)
    code, begin = _codes(words)
    total = np.zeros(len(code))
    for at, u, w in _triples(words):
        total[at] += table[u] * w
    return np.add.reduceat(total, begin) / _norms(words)


@dataclass
class Model:
    table: np.ndarray  # of triples: the landmarks' weights folded in
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        return project(words, self.table) + self.bias

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -500, 500)))


def train_words(bad: list[str], clean: list[str], weights: np.ndarray) -> Model:
    """Support vector machine (squared hinge loss, Newton steps) on Nystroem features of words; weights of the bad
    words tell how often each was a witness."""
    marks = _diverse(bad, LANDMARKS) + _diverse(clean, LANDMARKS)
    vectors = np.array([features(x) for x in marks])
    values, basis = np.linalg.eigh(vectors @ vectors.T)
    keep = values > 1e-6 * values[-1]
    root = basis[:, keep] / np.sqrt(values[keep])
    x = np.stack([project(bad + clean, v) for v in vectors], 1) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat([1.0, -1.0], [len(bad), len(clean)])
    cost = np.concatenate([weights / weights.sum(), np.full(len(clean), 2 / len(clean))]) * len(y) / 2
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.05
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        new = np.linalg.solve(ridge + (x[on] * cost[on, None]).T @ x[on], (x[on] * cost[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return Model((root @ w[:-1]) @ vectors, float(w[-1]))


def _diverse(words: list[str], n: int) -> list[str]:
    """Up to n words, each the farthest from those chosen before (the first comes first)."""
    if len(words) <= n:
        return list(words)
    words = words[:3000]
    far, chosen = np.full(len(words), 2.0), []
    at = 0
    for _ in range(n):
        chosen.append(words[at])
        far = np.minimum(far, 2 - 2 * project(words, features(words[at])))
        far[at] = -1
        at = int(far.argmax())
    return chosen


def calibrate(worst: np.ndarray, label: np.ndarray, bad_share: float = 0.5) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, for rows of which bad_share have label 1."""
    n1, n0 = label.sum(), (1 - label).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, bad_share / max(n1, 1), (1 - bad_share) / max(n0, 1)) * len(label)
    x, w = np.stack([worst, np.ones_like(worst)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - t)) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


#: What a document without words scores like.
NO_WORDS = -4.0


def worst_words(texts: list[str], model: Model, known: dict[str, float]) -> list[float]:
    """The highest value of any word of each whole text; known remembers tokens."""
    if len(known) > MEMORY:
        known.clear()
    cut = [tokens(x) for x in texts]
    new = list(set().union(*cut) - known.keys())
    words = [units(x) for x in new]
    many = np.array([len(x) for x in words], np.int64)
    values = model.words([u for x in words for u in x])
    high = np.full(len(new), NO_WORDS)
    if len(values):
        high[many > 0] = np.maximum.reduceat(values, (np.cumsum(many) - many)[many > 0])
    known.update(zip(new, high.tolist(), strict=True))
    return [max(map(known.__getitem__, x), default=NO_WORDS) for x in cut]


def _worst_of(model, names: list[str], text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches to their columns in names and worst, of the column at text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                worst = worst_words([x or "" for x in batch.column(text).to_pylist()], model.value, known)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(worst, pa.float64())], [*names, "worst"])

    return run


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4; null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(row, label, text) of at most so many labelled rows of each label."""
    from functools import reduce

    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    drawn = reduce(DataFrame.unionByName, (own.where(F.col("label") == k).distinct().orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    return checkpoint(texts.select(F.monotonically_increasing_id().alias("row"), "label", F.coalesce("text", F.lit("")).alias("text")))


def _words_of(sample: DataFrame) -> DataFrame:
    """(row, label, word): the different words of each sampled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                words = [list(dict.fromkeys(u for t in tokens(x) for u in units(t))) for x in batch.column(2).to_pylist()]
                n = [len(x) for x in words]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(batch.column(1).to_numpy(), n)), pa.array([u for x in words for u in x], pa.string())], ["row", "label", "word"])

    return sample.mapInArrow(run, "row long, label int, word string")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model | None:
    """Train on labelled rows that aren't held out, at most rows of each label (drawn by a hash of the id, so at any
    size). What reaches the driver is bounded by rows, CLEAN and HARD. None where one label has no rows or words."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, id_col, text_col, label_col, rows)
    words = checkpoint(_words_of(sample))
    n = {r["label"]: r["n"] for r in words.groupBy("label").agg(F.countDistinct("row").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    counts = words.groupBy("word").agg(F.sum(F.col("label")).alias("bad"), F.sum(1 - F.col("label")).alias("clean"))
    bad_share, total = n[1] / (n[0] + n[1]), F.col("bad") + F.col("clean")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (total * share))).otherwise(0.0)
    lean = F.sqrt(F.greatest(2 * (part(F.col("bad"), bad_share) + part(F.col("clean"), 1 - bad_share)), F.lit(0.0)))
    lean = F.when(F.col("bad") >= total * bad_share, lean).otherwise(-lean)
    apart = F.col("bad") / float(n[1]) >= ODDS * F.col("clean") / float(n[0])
    counts = checkpoint(counts.withColumns({"lean": lean, "apart": apart}))
    of_bad = checkpoint(words.where("label = 1").join(counts.where("apart").select("word", "lean"), "word").select("row", "word", "lean"))

    def tally(best: DataFrame) -> dict[str, int]:
        return {r["word"]: r["n"] for r in best.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(2 * rows).collect()}

    first = tally(of_bad.where(F.col("lean") >= LEAN))
    witness = first
    if not witness:
        witness = tally(of_bad.groupBy("row").agg(F.max_by("word", F.struct("lean", "word")).alias("word")))
    if not witness:
        return None
    clean_words = counts.where("clean > 0 AND NOT apart").select("word")
    clean = [r["word"] for r in clean_words.orderBy(F.xxhash64("word"), "word").limit(CLEAN).collect()]
    if not clean:
        return None
    model = None
    for _ in range(ROUNDS):
        bad = sorted(witness, key=lambda x: (-witness[x], x))
        model = train_words(bad, clean, np.array([witness[x] for x in bad], float))
        sent = spark.sparkContext.broadcast(model)
        valued = _values(of_bad.select("row", "word"), sent, "row long").where("value > 0")
        witness = tally(valued.groupBy("row").agg(F.max_by("word", F.struct("value", "word")).alias("word"))) | first or witness
        hard = _values(clean_words.select(F.lit(0).cast("long").alias("row"), "word"), sent, "row long").orderBy(F.desc("value"), "word").limit(HARD)
        clean = sorted({*clean, *(r["word"] for r in hard.collect())})
    sent = spark.sparkContext.broadcast(model)
    got = sample.select("label", "text").mapInArrow(_worst_of(sent, ["label"], 1), "label int, worst double").collect()
    shares = labels.where(~held_out(F.col(id_col))).agg(F.avg(F.when(F.col(label_col).isin(0, 1), F.col(label_col).cast("double")))).first()
    model.slope, model.offset = calibrate(np.array([r["worst"] for r in got]), np.array([r["label"] for r in got]), shares[0])
    return model


def _values(rows: DataFrame, model, ids: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.value.words(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["row", "word", "value"])

    return rows.mapInArrow(run, f"{ids}, word string, value double")


def score_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named in keep, and score (0 to 1) of every whole text. One row for each row of docs; a null or
    empty text, or one without letters, scores like NO_WORDS; without a model every score is 0. No shuffle."""
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias("score"))
    names = [f"k{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)), *([] if text_col in keep else [F.col(text_col).alias("text")]))
    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.schema.fields[: len(keep)])
    at = keep.index(text_col) if text_col in keep else len(keep)
    worst = own.mapInArrow(_worst_of(docs.sparkSession.sparkContext.broadcast(model), names, at), ddl + "worst double")
    score = 1 / (1 + F.exp(-(F.col("worst") * model.slope + model.offset)))
    return worst.select(*(F.col(x).alias(c) for c, x in zip(keep, names, strict=True)), score.alias("score"))


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """Train, then score every document: (doc_id, held_out, score, predicted).

    Labels of held-out rows, language, source and id are never inputs of a score. Null ids are scored and never
    trained on; repeated rows repeat; a label that is neither 0 nor 1 is ignored; empty tables give an empty one or
    scores of 0. Other columns are not read.
    """
    scored = score_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), train(docs, labels, id_col, text_col, label_col, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
