"""Operators 1, 2, 4, 6, 7, 9: edge cases and brute force on small fixtures."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import byte_codec, decontaminate, sentencepiece_codec, shared_files, simhash, substring_dedup, succinct, token_counts, token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "\n", "a\n b", "\n\n x", "▁▁a ▁", "日本 語\U0001f600", "á \x00 \t", " \n \n", "x\n", "<s> </s>", "<|endoftext|> a", "don't  stop.\nNow", "a\u00a0b", "word. " * 3000]
DOCS = "doc_id long, text string, fp string, words string, n_words int, __row int"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 0, 0) for i, t in texts], DOCS)


def _edge(spark):
    return _docs(spark, [(1, None), (2, ""), (None, "no id"), (3, "a b c"), (3, "a b c"), (4, "long " * 50_000)])


# --- 1 ---
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁\n.é日\t", max_size=30), min_size=1, max_size=20))
def test_pieces_as_the_library(texts):
    own = sentencepiece_codec.codec(PIECES)
    told = own.library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == told


def test_pieces_heap_and_rows_agree():
    own = sentencepiece_codec.codec(PIECES)
    words = ["▁" + w for w in "hello internationalisation aaaaaaa thththth x 日本語 ▁▁▁▁".split()] + ["▁" + "ab" * 60]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.agendas(words)] == [own.agenda(w) for w in words]


def test_pieces_memory_turns(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMORY", 3)
    own = sentencepiece_codec.PieceCodec(PIECES)
    for _ in range(3):
        for text in ("a b c d e f", "a g h", ""):
            assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == own.library.encode(text, add_bos=True, add_eos=True)


def test_pieces_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = _docs(spark, list(enumerate([*ODD, None])))
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_documents(df, PIECES).collect()}
    for i, t in enumerate([*ODD, None]):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == library.decode(ids)
    assert sentencepiece_codec.encode_documents(_edge(spark), PIECES).count() == 6
    assert sentencepiece_codec.encode_documents(df.limit(0), PIECES).count() == 0
    back = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_documents(df, PIECES, decode=False), PIECES)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {k: r["decoded"] for k, r in got.items()}


# --- 2 ---
def _slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _slow_groups(values):
    """{id: least id} of (id, fingerprint)."""
    least = {i: i for i, _ in values}
    changed = True
    while changed:
        changed = False
        for i, x in values:
            for j, y in values:
                if (x ^ y).bit_count() <= 4 and least[j] < least[i]:
                    least[i] = least[j]
                    changed = True
    return least


@pytest.mark.parametrize("text", [*ODD, None, "A b C d E", "É b\x0bc\x0cd e f g"])
def test_fingerprints(text):
    assert simhash.fingerprint((text or "").encode()) == _slow_fingerprint(text)


def test_groups_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40).tolist()
    values = []
    for i in range(400):  # chains of flips around some centres, repeats included
        x = base[i % 40]
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            x ^= 1 << int(b)
        values.append((i, x))
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in values]
    marked = spark.createDataFrame(signed, "doc_id long, fp long")
    want = _slow_groups(values)
    got = {r["doc_id"]: r["component_id"] for r in marked.join(simhash.near_groups(marked, "doc_id"), "fp").collect()}
    assert got == want
    few = {tuple(r) for r in simhash.links(marked.select("fp").distinct(), shard=8).collect()}  # many shards a key
    assert {frozenset(p) for p in few} and all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in few)
    from quillmark.llm.graph import components

    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(list(few), "a long, b long")).collect()}
    by_fp = {x: roots.get(x, x) for _, x in signed}
    first = {}
    for i, x in signed:
        first[by_fp[x]] = min(first.get(by_fp[x], i), i)
    assert {i: first[by_fp[x]] for i, x in signed} == want


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(_edge(spark)).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 1 and by[3]["component_id"] == 3 and by[None]["component_id"] is None
    assert simhash.near_duplicates(_edge(spark).limit(0)).count() == 0
    kept = simhash.keep_one(_edge(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]


# --- 4 ---
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _slow_contamination(text, items):
    words = WORD.findall(_lower(text))
    hit, ids = [False] * len(words), set()
    for i, t in items:
        own = WORD.findall(_lower(t))
        size = min(13, len(own))
        for k in range(max(1, len(own) - 12) if own else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[k : k + size]:
                    ids.add(str(i))
                    hit[p : p + size] = [True] * size
    return len(words), sum(hit), sorted(ids)


def test_contamination_by_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(6)]
    line = lambda n: " ".join(rng.choice(words, n))
    items = [(1, line(20)), (10, line(15)), (2, "W1, w2"), (3, ""), (4, None), (None, "w1 w1"), (2, "w5 w5 w5"), (7, line(13))]
    texts = [line(int(n)) for n in rng.integers(0, 60, 40)] + [f"x {items[0][1]}. y", items[1][1] + " " + items[1][1], items[7][1][:-1], None, "", items[0][1].upper()]
    df = _docs(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1 << 22, 1):  # one block, and one for each item
        decontaminate.BLOCK, old = blocks, decontaminate.BLOCK
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(df, bench).collect()}
        decontaminate.BLOCK = old
        for i, t in enumerate(texts):
            n, hit, ids = _slow_contamination(t, [x for x in items if x[0] is not None])
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, ids)
            assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == hit
    none = decontaminate.find_contamination(df, bench.limit(0))
    assert {r["n_hit"] for r in none.collect()} == {0}
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(_edge(spark), bench, keep=("doc_id", "text")).count() == 6


def test_contamination_by_items_without_id(spark, tmp_path):
    import corpus_pipeline
    import duckdb
    from quillmark.llm import queries

    items = [(1, "a b c"), (None, "w1 w1"), (None, "x y z"), (2, "w1 w1"), (3, None), (None, None)]
    texts = [(1, "w1 w1 and a b c"), (2, "x y z"), (3, "only these words"), (4, "a b c"), (5, None), (6, "w1 w1 x y z")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op4_decontamination"]).fetchall())
    assert sorted(map(tuple, queries.op4_decontamination(spark, str(tmp_path)).collect())) == want
    assert [w[2] for w in want] == [5, 3, 0, 3, 0, 5]
    left = corpus_pipeline.benchmark_out(spark, _docs(spark, texts).select("doc_id", "text"), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 5]


def test_index_counts_and_places():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 3000).astype(np.int32)
    text, place = decontaminate.runs_text(codes, 2)
    index = decontaminate.FmIndex(text)
    phrases = [[1, 2], [3, 3, 1], [1, 2, 3, 1, 2], [9, 1]]
    table = np.zeros((4, 5), np.int64)
    for i, p in enumerate(phrases):
        table[i, -len(p) :] = p
    which, lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    found = {int(w): sorted(place[index.locate(np.arange(a, b))].tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
    for i, p in enumerate(phrases):
        assert found.get(i, []) == [k for k in range(len(codes) - len(p) + 1) if codes[k : k + len(p)].tolist() == p]


# --- 6 ---
def test_chains():
    b = list(range(0, 100, 5))
    assert substring_dedup.chain(b, [x + 7 for x in b]) == [list(range(20))]
    assert substring_dedup.chain([0, 5, 300, 305], [0, 5, 900, 905]) == [[0, 1], [2, 3]]
    assert substring_dedup.chain([0, 5], [9, 4]) == []


def test_alignment_ends_and_gaps():
    a = [f"a{i}" for i in range(100)]
    b = ["x"] * 10 + a[:40] + ["new"] + a[41:100] + ["y"] * 10
    assert substring_dedup.align(a, b, [(0, 10)]) == [(10, 110)]
    assert substring_dedup.align(a, ["z"] * 100, [(0, 0)]) == []
    assert substring_dedup.align(a[:20], a[:20], [(0, 0)]) == []


def test_passages(spark):
    rng = np.random.default_rng(1)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))
    passage, other = line(60), line(55)
    fuzzy = " ".join("new" if i == 30 else w for i, w in enumerate(passage.split()))
    short = line(40)
    texts = [(1, f"{line(30)} {passage} {line(20)}"), (2, f"{line(10)}\n{passage}\n{line(5)}"), (3, f"{fuzzy} {line(30)}"), (4, line(200)), (5, f"{short} {line(30)}"), (6, f"{line(20)} {short}"), (7, other), (8, other), (9, f"{passage} {other}"), (10, ""), (11, None), (None, passage), (12, f"{line(8)} {other}"), (12, f"{line(8)} {other}")]
    df = _docs(spark, texts)
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(df).collect()}
    spans = {i: [(s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()}
    assert spans == {2: [(10, 70)], 3: [(0, 60)], 8: [(0, 55)], 9: [(0, 115)], 12: [(8, 63)]}
    assert got[2]["others"] == [1] and got[9]["others"] == [1, 7] and got[2]["n_words"] == 60
    left = substring_dedup.remove_passages(df.withColumn("n_chars", F.length("text")))
    assert left.columns == [*df.columns, "n_chars"]
    out = [(r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()]
    assert len(out) == len(texts)
    by = {i: t for i, t, _ in out}
    assert passage in by[1] and passage not in by[2] and by[8] == "" and by[4] == texts[3][1] and by[11] is None and by[None] == passage
    assert all(n == len(t) for _, t, n in out if t is not None)
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_stretches_across_gaps(spark):
    a = [f"a{i}" for i in range(90)]
    new = [f"n{i}" for i in range(30)]
    both = lambda x, y: substring_dedup.align(x, y, [(x.index("a3"), y.index("a3")), (x.index("a60"), y.index("a60"))])
    for gap in (6, 7, 12, 13, 22):  # 90 words of up to 112 agree
        wide = a[:45] + new[:gap] + a[45:]
        assert both(a, wide) == [(0, 90 + gap)] and both(wide, a) == [(0, 90)]
        assert both(a[:45] + [f"x{i}" for i in range(gap)] + a[45:], wide) == [(0, 90 + gap)]
    assert both(a, a[:45] + new[:23] + a[45:]) == [(0, 45), (68, 113)]
    assert both(a[:30] + new + a[30:], a) == [(0, 30), (30, 90)]
    parts = [(0, 20, 0, 20, 20), (24, 44, 20, 40, 20), (60, 80, 40, 60, 20)]
    assert substring_dedup.stretches(parts) == [(0, 44)]
    assert substring_dedup.stretches([(0, 30, 0, 30, 30), (28, 50, 28, 50, 22)]) == [(0, 50)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:45] + new[:7] + a[45:]))]
    assert [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in substring_dedup.repeated_passages(_docs(spark, rows)).collect()] == [(2, [(0, 97)])]


def test_passages_whose_parts_occur_earlier(spark):
    rng = np.random.default_rng(5)
    line = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    passages = [line(60) for _ in range(8)]
    texts = []
    for i, p in enumerate(passages):  # pieces of 20 words, every 16 words: each seed has an earlier holder
        texts += [(10 * i + k, " ".join(line(30) + p[at : at + 20] + line(30))) for k, at in enumerate(range(0, 48, 16))]
        texts += [(100 + i, " ".join(line(15) + p + line(9))), (200 + i, " ".join(line(i) + p + line(12)))]
        texts.append((300 + i, " ".join(p[32:] + p[16:36] + p[:20] + line(40) + p)))  # its first places are the pieces'
        texts.append((400 + i, " ".join(p)))
    split = {d: t.split() for d, t in texts}
    want = {}
    for d, w in split.items():  # brute force: words inside runs of 50 words that a smaller id holds
        earlier = {tuple(x[j : j + 50]) for e, x in split.items() if e < d for j in range(len(x) - 49)}
        hit = sorted({j + k for j in range(len(w) - 49) if tuple(w[j : j + 50]) in earlier for k in range(50)})
        if hit:
            want[d] = hit
    assert {200 + i for i in range(8)} <= set(want)
    got = {r["doc_id"]: {k for s in r["spans"] for k in range(s["start"], s["end"])} for r in substring_dedup.repeated_passages(_docs(spark, texts)).collect()}
    assert set(got) == set(want) and all(got[d] >= set(want[d]) for d in want)


def _agrees(a, b, least=50, words=5):
    """Whether a stretch of so many words at one offset agrees in 0.8 of its words, a run of five among them."""
    same = [x == y for x, y in zip(a, b, strict=True)]
    return any(
        5 * sum(same[i:j]) >= 4 * (j - i) and any(all(same[k : k + words]) for k in range(i, j - words + 1))
        for i in range(len(a)) for j in range(i + least, len(a) + 1) if same[i] and same[j - 1]
    )


def test_fuzzy_passages_by_brute_force(spark):
    rng = np.random.default_rng(11)
    line = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    texts, want, spoilt = [], set(), 0
    for i in range(300):
        size, share = [(55, 0.8), (55, 0.85), (55, 0.9), (80, 0.8), (60, 0.7), (50, 0.8)][i % 6]
        p = line(size)
        q = list(p)
        for k in rng.choice(size, round(size * (1 - share)), replace=False):
            q[k] = f"s{rng.integers(10**9)}"
        texts += [(i, " ".join(line(60) + p + line(60))), (1000 + i, " ".join(line(60) + q + line(60)))]
        if _agrees(p, q):
            want.add(1000 + i)
        else:
            spoilt += 1
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(_docs(spark, texts)).collect()}
    assert got == want and spoilt > 40 and len(want) > 180


def _brute_passages(split, least=50):
    """By document: words in passages, from all seeds that it shares with each document of a smaller id, not only first holders."""
    out = {}
    for d, w in split.items():
        covered = set()
        for e, x in split.items():
            places = {}
            for i in range(len(x) - 4 if e < d else 0):
                places.setdefault(tuple(x[i : i + 5]), []).append(i)
            rows = [(0, e, 0, 0, j, i) for j in range(len(w) - 4) for i in places.get(tuple(w[j : j + 5]), ())]
            for c in substring_dedup.chains_of(np.array(rows, np.int64).reshape(-1, 6)):
                covered |= {k for s, t in substring_dedup.align(x, w, list(zip(c[5], c[4], strict=True))) for k in range(s, t)}
        if runs := [(s, t) for s, t in substring_dedup.united(np.array(sorted(covered)), np.array(sorted(covered)) + 1) if t - s >= least] if covered else []:
            out[d] = {k for s, t in runs for k in range(s, t)}
    return out


def test_fuzzy_passages_whose_parts_occur_earlier(spark):
    rng = np.random.default_rng(3)
    line = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    split = {}
    for i in range(48):
        p = line(60 + i % 3 * 15)
        q, differ = [], set(rng.choice(len(p), [3, 6, 9][i % 3 if i < 24 else 0], replace=False).tolist())
        for k, w in enumerate(p):  # other words, or some left out or put in
            kind = 0 if i < 24 else k % 3
            q += [w] if k not in differ else [[f"s{k}"], [], [f"s{k}", w]][kind]
        parts = [q[at : at + 12] for at in range(0, len(q), 8)]  # each seed has an earlier holder, in pieces of 12 words
        for k, part in enumerate(parts):
            split[20 * i + k] = line(15) + part + line(15)
        split[2000 + i] = [w for part in parts for w in [*part, f"x{i}"]] * (i % 2) + line(20) + p + line(20)  # or earlier in that holder
        split[3000 + i] = line(9) + q + line(i)
    want = _brute_passages(split)
    assert len(want.keys() & {3000 + i for i in range(48)}) >= 40
    got = {r["doc_id"]: {k for s in r["spans"] for k in range(s["start"], s["end"])} for r in substring_dedup.repeated_passages(_docs(spark, [(d, " ".join(w)) for d, w in split.items()])).collect()}
    assert set(got) == set(want) and all(got[d] >= want[d] for d in want)


def test_holders_of_one_seed():
    rng = np.random.default_rng(4)
    side, size, n = substring_dedup.SIDE, substring_dedup.SIDE * 2 + 5, 300
    words = rng.integers(1, 400, (n, size + 2 * substring_dedup.SHIFT)).astype(np.uint16)
    words[rng.random(words.shape) < 0.4] = 7  # a frequent word
    for i in range(0, n, 3):  # some of the words beside the seed are those of another
        at = rng.random(words.shape[1]) < rng.uniform(0.6, 1)
        words[i, at] = words[i + 1, at]
    words[:, substring_dedup.SHIFT + side : substring_dedup.SHIFT + side + 5] = np.arange(401, 406)
    words[::7, :30] = 0  # a text's edge
    group = np.arange(n) // 100
    want = set()
    for x in range(0, n, 2):
        for y in range(n):
            own, other = words[x, 8:-8], words[y]
            hit = [v > 0 and v in other[k : k + 17] for k, v in enumerate(own)]
            line = [v == other[k + 8] for k, v in enumerate(own)]
            last, first = next((k for k in range(side, size) if not line[k] or not own[k]), size), next((k + 1 for k in range(side, -1, -1) if not line[k] or not own[k]), 0)
            beside = [h and (last - first < 25 or not first <= k < last) for k, h in enumerate(hit)]
            if x != y and group[x] == group[y] and any(all(own[s:e]) and sum(hit[s:e]) >= e - s - m and (last - first < 25 or sum(beside[s:e]) >= 5) for s, e, m in substring_dedup._AROUND):
                want.add((x, y))
    pairs = [(a, b) for x, y in substring_dedup.alike(group, words, np.arange(n) % 2 == 0) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert set(pairs) == want and len(pairs) == len(want) > 50


def test_words_that_go_on_and_on_stay_few_chains():
    one = lambda left, n, right: np.array([*range(left, left + 30), *[9] * n, *range(right, right + 30)], np.uint16)
    a, b = one(100, 120, 200), one(100, 110, 200)
    chains = substring_dedup.shared_chains(a, b)
    assert len(chains) <= 4  # not one for each two places
    covered = {k for c in chains for s, e in substring_dedup.align(a.tolist(), b.tolist(), c) for k in range(s, e)}
    assert covered == set(range(170))
    assert len(substring_dedup.shared_chains(one(300, 120, 400), one(500, 40, 600))) <= 4


def _runs_of_one_word(n, size):
    """Words around the first place of a run of one word, beside words of their own."""
    side, shift = substring_dedup.SIDE, substring_dedup.SHIFT
    words = np.arange(10, 10 + n * (2 * (side + shift) + 5)).astype(np.uint16).reshape(n, -1)
    words[:, side + shift : side + shift + size] = 9
    return words


def test_runs_of_one_word_alone_are_not_sent():
    words, n = _runs_of_one_word(200, 22), 200
    words[199] = words[0]
    words[199, 60] = 7  # this one goes on like the first beyond the run
    order = np.arange(n, dtype=np.int64)
    told = substring_dedup.pack(substring_dedup.pack_sorted(np.full(n, 5, np.uint64)), np.ones(n, np.uint8), order, order.astype(np.int32), np.full(n, 50, np.int32), order.astype(np.uint64), words.ravel())
    sent = [substring_dedup.unpack(data) for batch in substring_dedup._near(0, [(substring_dedup.ASKED, 3, told)]) for data in batch.column(3).to_pylist()]
    assert [(local.tolist(), ids.tolist()) for local, ids, *_ in sent] == [([199], [0])]  # not each two of 200


def test_pairs_of_runs_by_brute_force():
    rng = np.random.default_rng(6)
    words = _runs_of_one_word(120, 1)
    middle = words.shape[1] // 2
    for i in range(120):  # runs of unlike lengths; some words of another, or the run's word once more, beside
        other = rng.random(words.shape[1]) < rng.choice([0, 0.3, 0.8])
        words[i, other] = words[i // 2, other]
        words[i, rng.integers(0, words.shape[1], i % 4)] = 9
        before, after = (rng.integers(15, 24), 0) if i % 5 == 0 else (0, rng.integers(15, 24))  # its last place, or its first one
        words[i, middle - 3 - before : middle + 4 + after] = 60_000
        words[i, middle - 2 - before : middle + 3 + after] = 9
    group, asks = np.arange(120) // 40, np.arange(120) % 3 > 0
    kept = []
    for found in (substring_dedup.alike, substring_dedup.alike_runs):
        x, y = (np.concatenate(c) for c in zip(*found(group, words, asks), strict=True))
        good = substring_dedup.one_to_one(words, x, y, True)
        kept.append(sorted(zip(x[good].tolist(), y[good].tolist(), strict=True)))
    assert kept[0] == kept[1] and len(kept[0]) > 50


def test_where_spans_can_lie_at_most():
    rng = np.random.default_rng(2)
    a, b, i, j, far = [], [], [], [], []
    for t in range(1500):
        x, y = (rng.integers(1, rng.choice([3, 8, 300]) + 1, rng.integers(30, 90)).astype(np.uint16) for _ in range(2))
        n = int(rng.integers(5, 12))
        p, q = int(rng.integers(0, len(x) - n + 1)), int(rng.integers(0, len(y) - n + 1))
        m = min(len(x) - p, len(y) - q) if t % 3 == 0 else n
        x[p : p + m] = np.where((rng.random(m) < 0.7) | (np.arange(m) < n), y[q : q + m], x[p : p + m])
        for some, value in ((a, x), (b, y), (i, p), (j, q), (far, n - 5)):
            some.append(value)
    i, j, far = map(np.array, (i, j, far))
    done, (narrow,), may = substring_dedup.ended(a, b, i, j, far), substring_dedup.promising(a, b, (substring_dedup.CHAIN,)), substring_dedup.reach(a, b)
    spans = 0
    for k in range(len(a)):
        (theirs, others), (ours, pairs) = substring_dedup.listed(a[k]), substring_dedup.listed(b[k])
        found, more = substring_dedup.aligned(theirs, ours, others, pairs, [(i[k], j[k]), (i[k] + far[k], j[k] + far[k])])
        assert not (done[k] and (more or found and not narrow[k]))
        assert all(may[k][s:e].all() for s, e in found) and (narrow[k] or not found)
        spans += len(found) > 0
    assert spans > 20 and done.sum() > 20
    run = lambda left, n, right: np.array([*range(left, left + 30), *[9] * n, *range(right, right + 30)], np.uint16)
    assert [x.sum() for x in substring_dedup.reach([run(100, 24, 200), run(100, 30, 200)], [run(300, 40, 400), run(300, 30, 400)])] == [40, 30]
    assert not substring_dedup.reach([run(100, 40, 200)], [run(300, 22, 400)])[0].any()  # 22 of 25 words, but none at an end


def test_one_to_one():
    side, shift = substring_dedup.SIDE, substring_dedup.SHIFT
    n, at = 2 * (side + shift) + 5, side + shift
    words = np.arange(1, 4 * n + 1, dtype=np.uint16).reshape(4, n)
    for i, size in enumerate((30, 14, 22)):  # a word that goes on for so long from the seed on, beside words of their own
        words[i, at : at + size] = 999
    words[3] = words[0]
    words[3, at + 3 : at + 6] = 7
    pairs = [(x, y) for xs, ys in substring_dedup.alike(np.zeros(4, np.int64), words, np.ones(4, bool)) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)]
    x, y = (np.array(c) for c in zip(*pairs, strict=True))
    kept = {p for p, k in zip(pairs, substring_dedup.one_to_one(words, x, y), strict=True) if k}
    assert (0, 1) in pairs and (0, 1) not in kept  # 14 words stand for 22 and more
    assert {(0, 2), (0, 3), (3, 0)} & set(pairs) <= kept and (0, 3) in kept


def test_aligning_takes_no_table_of_a_whole_text():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 500, 20_000).astype(np.uint16), rng.integers(500, 1000, 20_000).astype(np.uint16)
    for k in range(0, 18_000, 60):
        b[k : k + 5] = a[k : k + 5]
    start = time.process_time()
    (theirs, others), (ours, pairs) = substring_dedup.listed(a), substring_dedup.listed(b)
    assert all(not substring_dedup.aligned(theirs, ours, others, pairs, [(k, k)])[0] for k in range(0, 18_000, 60))
    assert time.process_time() - start < 1  # 300 such tables took more than that
    assert not substring_dedup.align(theirs, ours, [(0, 0)])


def test_fuzzy_stretch_beside_an_exact_one():
    a, b = [f"a{i}" for i in range(215)], [f"a{i}" for i in range(215)]
    b[60:160] = [f"n{i}" for i in range(100)]
    for k in (162, 164, 168, 170, 172, 174, 192, 194, 196, 198, 212):
        b[k] = f"s{k}"
    places = [(0, 0), (175, 175)]
    assert substring_dedup.align(a, b, places[1:]) == [(160, 215)]
    assert substring_dedup.align(a, b, places) == [(0, 60), (160, 215)]


def test_one_seed_is_enough(spark):
    p = [f"w{i}" for i in range(52)]
    q = [w if k % 5 or k in (25, 50) else f"s{k}" for k, w in enumerate(p)]  # runs of four words, but for one
    assert substring_dedup.chain([3], [4], least=1) == [[0]] and substring_dedup.chain([0, 40], [0, 70], [30, 3], 1) == [[0, 1]]
    got = substring_dedup.repeated_passages(_docs(spark, [(1, " ".join(["x"] * 9 + p)), (2, " ".join(q + ["y"] * 9))])).collect()
    assert [r["doc_id"] for r in got] == [2] and got[0]["n_words"] >= 50


def test_cut_spans():
    assert substring_dedup.cut_spans(" a b\nc  d ", [(1, 3)]) == "a d"
    assert substring_dedup.cut_spans("a b", [(0, 2)]) == ""


# --- 7 and 9 ---
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.,'s1é日\t\x1c\r", max_size=25), min_size=1, max_size=20), st.booleans())
def test_bytes_as_the_library(texts, special):
    own = byte_codec.codec(BYTES, special)
    texts = [*texts, "a <|endoftext|> b"]
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = not special
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bytes_memory_turns(monkeypatch):
    monkeypatch.setattr(byte_codec, "MEMORY", 2)
    own = byte_codec.ByteCodec(BYTES)
    for text in ("a b c d", "e f\ng", "a b", "", "\nx y") * 2:
        assert np.frombuffer(own.encode_batch([text])[0], "<u2").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 5000):
        values = rng.integers(0, 300, n).astype(np.uint16)
        w = succinct.WaveletMatrix.from_bytes(succinct.WaveletMatrix.of(values, 9).to_bytes())
        assert (w.decode() == values).all()
        at = np.arange(n)
        assert (w.access(at) == values).all()
        for s in {0, 7, 299, *values[:3].tolist()}:
            places = np.flatnonzero(values == s)
            assert w.count(s) == len(places) and (w.select(s, np.arange(len(places))) == places).all()
            assert (w.rank(np.full(n, s), at) == np.concatenate([[0], np.cumsum(values == s)[:-1]])[:n]).all()


def test_token_files(spark):
    df = _docs(spark, [(7, "b c"), (3, "a"), (None, "no id"), (5, None), (9, ODD[-1]), (3, "a"), (4, "<|endoftext|>")])
    library = Tokenizer.from_file(BYTES)
    order = [(None, "no id"), (3, "a"), (3, "a"), (4, "<|endoftext|>"), (5, ""), (7, "b c"), (9, ODD[-1])]
    want, start = [], 0
    for i, t in order:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = shared_files.new_folder(spark, "test")
    got = token_files.round_trip(df, BYTES, 2, folder=folder).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got] == want
    assert token_files.round_trip(df.limit(0), BYTES, 2).count() == 0
    small = shared_files.new_folder(spark, "test")
    token_files.write_token_files(df, BYTES, 2, small, shard=5)
    assert sum(r["n_tokens"] for r in token_files.read_token_files(spark, small).collect()) == start


def test_token_counts(spark):
    df = _docs(spark, [(i, t) for i, t in enumerate([*ODD, None])] + [(2, ODD[2]), (None, "x")])
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    want = sorted((i if i is not None else -1, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate([*ODD, None]), (2, ODD[2]), (None, "x")])
    for block in (4, 1 << 20):
        got = token_counts.document_token_counts(df, BYTES, 50256, block=block).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got) == want
    assert token_counts.document_token_counts(df.limit(0), BYTES, 50256).count() == 0


def test_flat_files_without_index(spark):
    folder = shared_files.new_folder(spark, "flat")
    shared_files.write(f"{folder}/a.bin", [np.array([1, 9, 9, 2, 3, 4, 5, 6, 9, 7], "<u2").tobytes()])
    shared_files.write(f"{folder}/b.bin", [np.array([9], "<u2").tobytes()])
    for block in (2, 6, 1 << 20):
        got = sorted((r["file"][-5:], r["place"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(spark, folder, 9, block=block).collect())
        assert got == [("a.bin", 0, 1, True), ("a.bin", 1, 0, True), ("a.bin", 2, 5, True), ("a.bin", 3, 1, False), ("b.bin", 0, 0, True)]


def test_digests(spark, tmp_path):
    """The registered queries derive the contract's digests."""
    from quillmark.llm import queries

    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in queries.op1_sentencepiece(spark, str(tmp_path)).collect():
        ids = library.encode(ODD[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    tk = Tokenizer.from_file(BYTES)
    for r in queries.op7_token_files(spark, str(tmp_path)).collect():
        ids = tk.encode(ODD[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_tell_a_digest(spark):
    df = spark.createDataFrame([(2, "b c"), (1, None), (3, "é 日\n a")], "doc_id long, text string")
    want = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.round_trip(df, BYTES, 2).orderBy("start").collect()]
    assert [tuple(r) for r in token_files.round_trip(df, BYTES, 2, digest=zlib.crc32).orderBy("start").collect()] == want
    assert token_files.round_trip(df.limit(0), BYTES, 2, digest=zlib.crc32).schema["ids"].dataType.simpleString() == "bigint"


def test_bytes_of_all_kinds_are_pieces():
    own = byte_codec.ByteCodec(BYTES)
    text = " ".join(map(chr, [*range(33, 127), *range(161, 173), *range(174, 1000), 0x65E5, 0x1F600])) + "\nx"
    assert np.frombuffer(own.encode_batch([text])[0], "<u2").tolist() == own.library.encode(text, add_special_tokens=False).ids
