"""Columns of hostile names, ties, repeated rows, nulls and empty tables, for operators and pipeline stages."""

import json

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import block_store, chat_format, decontaminate, queries, sentencepiece_codec, shared_files, simhash, substring_dedup, token_counts, toxicity, vector_topk
from quillmark.llm.common import shared_dir

#: Names that the operators themselves use for something.
HOSTILE = [
    "__row", "__order", "__spans", "__doc", "__text", "spans", "start", "end", "other", "others", "doc", "fp", "node", "root", "to", "kind", "src", "data", "order", "id", "own", "c0", "c1", "k0", "row", "label", "word",
    "score", "worst", "value", "n_words", "n_hit", "items", "block", "place", "component_id", "a.b", "n_tokens", "ids", "name", "file",
]
LINE = [f"w{i}" for i in range(4000)]
PASSAGE = " ".join(LINE[:70])
ROWS = [
    (1, f"{PASSAGE} {' '.join(LINE[100:160])}"), (2, f"{' '.join(LINE[200:260])} {PASSAGE}"), (3, "a short text of five words"), (3, "a short text of five words"), (None, None), (None, ""), (4, ""),
    (5, "you idiot " + " ".join(LINE[300:340])), (6, "item words one two three four five six seven eight nine ten eleven twelve thirteen"), (7, " ".join(LINE[400:420] * 500)),
]


def _docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    said = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5("text"), F.lit("-")))
    return df.select(*(F.concat(F.lit(h), F.lit("="), said).alias(h) for h in HOSTILE), "doc_id", "text", F.length("text").cast("long").alias("n_chars"))


def _intact(rows, changed=()):
    """Rows whose hostile columns still tell their own id and first text."""
    for r in rows:
        own = {r[h].removeprefix(f"{h}=") for h in HOSTILE}
        assert len(own) == 1 and next(iter(own)).split("/")[0] == ("-" if r["doc_id"] is None else str(r["doc_id"]))
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "", r["n_chars"]) for r in rows)


def _want(*keep):
    return sorted((i is None, i or 0, t is None, t or "", None if t is None else len(t)) for i, t in keep)


def test_keep_one_with_hostile_columns(spark):
    docs = _docs(spark)
    left = simhash.keep_one(docs)
    assert left.dtypes == docs.dtypes
    assert _intact(left.collect()) == _want(*(ROWS[i] for i in (0, 1, 2, 6, 7, 8, 9)))  # of empty texts 4 has the least id
    assert simhash.keep_one(docs.limit(0)).count() == 0
    alone = docs.where("doc_id IS NULL AND text = ''").unionByName(docs.where("doc_id IS NULL AND text = ''"))
    assert simhash.keep_one(alone).count() == 1


def test_remove_passages_with_hostile_columns(spark):
    docs = _docs(spark)
    left = substring_dedup.remove_passages(docs)
    assert left.columns == docs.columns
    want = [(i, " ".join(LINE[200:260])) if i == 2 else (i, t) for i, t in ROWS]
    assert _intact(left.collect()) == _want(*want)
    assert substring_dedup.remove_passages(docs.limit(0)).count() == 0


def test_stages_with_hostile_columns(spark, tmp_path):
    docs = _docs(spark)
    spark.createDataFrame([(1, "item words one two three four five six seven eight nine ten eleven"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert _intact(corpus_pipeline.toxic_out(spark, docs, f"{tmp_path}/none").collect()) == _want(*ROWS)
    assert len(corpus_pipeline.toxic_out(spark, docs, str(tmp_path)).collect()) <= len(ROWS)
    left = corpus_pipeline.benchmark_out(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and _intact(left.collect()) == _want(*(r for r in ROWS if r[0] != 6))
    assert len(corpus_pipeline.near_copies_out(spark, docs, "").collect()) == 7 and corpus_pipeline.repeats_out(spark, docs, "").count() == len(ROWS)
    done = corpus_pipeline.encoded(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in done) == sorted((i is None, i or 0) for i, _ in ROWS)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_operators_with_hostile_columns(spark):
    docs = _docs(spark)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())
    every = sorted((i is None, i or 0) for i, _ in ROWS)
    assert ids(simhash.near_duplicates(docs)) == every
    assert ids(token_counts.document_token_counts(docs, queries.vocabulary("byte_bpe_50k.json"), 50256)) == every
    assert ids(toxicity.judge_toxicity(docs, spark.createDataFrame([(1, 0, "x")], "doc_id long, toxic int, score string"))) == every
    assert ids(decontaminate.find_contamination(docs, spark.createDataFrame([("a", "x")], "item_id string, text string"), keep=("doc_id", *HOSTILE))) == every
    assert ids(sentencepiece_codec.encode_documents(docs, queries.vocabulary("piece_bpe_32k.model"))) == every
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(docs).collect()} == {2}


# --- recall of op6 ---
@pytest.mark.parametrize("size", [60, 80])
def test_recall_by_share_of_changed_words(spark, size):
    """Passages of which so many words are others, at random places, beside words of their own."""
    rng = np.random.default_rng(size)
    line = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    texts, shares = [], {}
    for k, share in enumerate((0.0, 0.05, 0.10, 0.15, 0.20)):
        for i in range(60):
            p = line(size)
            q = list(p)
            for j in rng.choice(size, round(size * share), replace=False):
                q[j] = f"s{rng.integers(10**9)}"
            a = 10_000 * k + i
            texts += [(a, " ".join(line(40) + p + line(40))), (a + 5000, " ".join(line(40) + q + line(40)))]
            shares[a + 5000] = share
    texts += [(90_000 + i, " ".join(line(150))) for i in range(100)]
    found = {r["doc_id"]: r["spans"] for r in substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    recall = {s: sum(d in found for d, x in shares.items() if x == s) / 60 for s in sorted(set(shares.values()))}
    assert min(recall.values()) >= 0.9 and recall[0.0] == recall[0.05] == 1.0
    assert not found.keys() - shares.keys()  # nothing where nothing repeats
    words = [w for d, s in found.items() for x in s for w in range(x["start"], x["end"])]
    assert sum(not 40 <= w < 40 + size for w in words) <= 0.01 * len(words)


def test_words_that_go_on(spark):
    """A word repeated many times is one seed at many places: exact repeats of 50 words are still found, and in order."""
    texts = [(1, "x " * 30 + "a b c " + "y " * 80), (2, "q " * 10 + "y " * 60 + "end"), (3, "z " * 500), (4, "p " * 49 + "o"), (5, "p " * 49 + "e"), (6, "u v " * 40), (7, "s " + "u v " * 30)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {2: [(10, 70)], 7: [(1, 61)]}


def test_hashed_words():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    letters = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "a", "b", "é", "日", "\x85", "\xa0", "x" * 300]
    seen = {}
    for k in range(200):
        texts = ["".join(rng.choice(letters, int(rng.integers(0, 12)))) for _ in range(int(rng.integers(0, 5)))]
        whole = pa.array(["zz", *texts], pa.string())[1:] if k % 2 else pa.array(texts, pa.string())
        hashes, many = substring_dedup.hashed_words(whole)
        split = [t.encode().split() for t in texts]
        assert many.tolist() == [len(x) for x in split]
        for word, h in zip((w for x in split for w in x), hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_messages():
    arrays = [np.array([], np.uint64), np.array([0, 1, 2**64 - 1], np.uint64), np.array([-1, 5], np.int64), np.zeros(7, np.int32), np.arange(300, dtype=np.uint32)]
    for a, b in zip(arrays, block_store.unpack(block_store.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) << np.uint64(1))
    assert (np.cumsum(block_store.pack_sorted(values)) == values).all()
    cut = block_store.bucket_cuts(values, 7)
    assert cut[0] == 0 and cut[-1] == 1000 and all(int(values[i]) * 7 >> 64 == k for k in range(7) for i in range(cut[k], cut[k + 1]))


def test_blocks_are_whole(spark, monkeypatch):
    monkeypatch.setattr(block_store, "BLOCK", 100)
    rows = spark.createDataFrame([(i, "t" * (i % 90)) for i in range(50)] + [(99, "long " * 100)], "id long, own string").repartition(2)
    folder = shared_files.new_folder(spark, "test-blocks")
    stored = rows.mapInArrow(block_store.write_blocks(folder, 1, lambda b: str(b.num_rows).encode(), 100), block_store.MESSAGE).collect()
    read = [x for r in stored for x in block_store.read_block(folder, r["to"]).column(0).to_pylist()]
    assert sorted(read) == [*range(50), 99] and sum(int(r["data"]) for r in stored) == 51 and len({r["to"] for r in stored}) == len(stored) > 10
    shared_files.remove(folder)
    shared_files.remove(folder)


# --- op5 ties, op8 repeated ids ---
def test_chats_with_ties_as_in_sql(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        turns = [(c // 3, int(rng.integers(0, 3)), str(rng.choice(["user", "bot"])), str(rng.choice(["a", "b", "c", ""]))) for _ in range(int(rng.integers(1, 6)))]
        rows += [(c, None if t == 0 else t, r if t != 2 else None, x or None) for _, t, r, x in turns]
        if c % 4 == 0:
            rows += rows[-2:]  # repeated rows
    rows += [(500, k % 2, "user", "long " * 2000) for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(map(tuple, chat_format.format_chats(df).collect()))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    assert got == sorted(con.execute(chat_format.ORACLE_SQL).fetchall())
    again = chat_format.format_chats(df.withColumns({h: F.lit(1) for h in ("bucket", "local", "place", "h1", "o0", "t", "k_conv", "n_turns")}))
    assert sorted(map(tuple, again.collect())) == got


def test_several_vectors_of_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.0]), (1, [0.0, 0.75]), (1, [0.0, 0.75]), (2, [0.25, 0.25]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, score string, id int").repartition(3)
    want = [(50, 1, 1, 192 * 256), (50, 2, 2, 64 * 256), (50, 3, 3, -256 * 256)]
    for terms in (1, 1000):
        got = vector_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_terms=terms)
        assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    assert sorted(con.execute(queries.OP8_SQL).fetchall()) == want


def test_wide_vocabularies(spark, tmp_path):
    """A vocabulary of more than 65,536 ids is written in four bytes, and counted so."""
    vocabulary = {"[UNK]": 0, "a": 1, "b": 2, **{f"x{i}": i for i in range(3, 70_000)}}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocabulary, "merges": []}}))
    df = spark.createDataFrame([(1, "abba"), (2, ""), (3, "b")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(df, str(path), 69_999).collect()} == {1: 4, 2: 0, 3: 1}


def test_links_with_more_blocks(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**62), 2**62, 300).tolist()
    values += [v ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for v, a, b, c in zip(values, *rng.integers(0, 60, (3, 300)), strict=True)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    few = {frozenset(r) for agree in (2, 3, 4) for r in simhash.links(df.select("fp").distinct(), agree=agree).collect()}
    for agree in (2, 3, 4):
        assert {frozenset(r) for r in simhash.links(df.select("fp").distinct(), agree=agree).collect()} == few
    assert len(few) >= 300 - 5


def test_shared_folder_must_be_named():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
    Context.master = "local[3]"
    assert shared_dir(Session()).startswith("file:")
