"""Operators 3, 5, 8, 10, the graph and the pipeline: edge cases and brute force on small fixtures."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat_format, toxicity, url_filter, vector_topk
from quillmark.llm.graph import components
from quillmark.llm.queries import URL_RULES

URLS = [
    "http://a.com/x", "https://EXAMPLE.com/en/1", "https://www.Example.com/en/", "https://m.example.com/en/2?x", "http://x.net/es/#t", "http://net/fr/", "http://xnet/fr/", "x", None, "", "http://example.com",
    "http://example.com?/en/", "http://notexample.com/en/", "http://a.b.www.example.com/en/", "a://b://c.com/", "http://example.com/EN/", "http://user@x.com:80/", "http://e.com/\nen", "http://example.com.net/fr/x",
]


def _judge(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls_by_brute_force(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r"), (None, URLS[1], "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(df, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = _judge(URLS[r["page_id"]] if r["page_id"] is not None else URLS[1])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_rule_index():
    index = {r[1]: r[0] for r in url_filter.rule_index([*URL_RULES, ("a.b", "", "block"), ("c.d", "/x/part", "block")])}
    assert index["net/fr/"] == "fr" and index["www.example.com/en/"] == "www" and index["com/"] == "com" and index["c.d/x/part"] in ("c", "d", "x")
    for bad in ([("A.com", "/", "allow")], [("a", "/", "x")], [("a", "/", "allow"), ("a", "/", "block")]):
        with pytest.raises(ValueError):
            url_filter.rule_index(bad)


def test_rules_without_path_or_rare_tokens(spark):
    df = spark.createDataFrame([(1, "http://x.a.b"), (2, "http://a.b/c"), (3, "http://a.bc/"), (4, "http://c.d/x/partial"), (5, "http://c.d/x/p")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, [("a.b", "", "block"), ("c.d", "/x/part", "block")]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow"}


def test_chats(spark):
    say = lambda c, *turns: [(c, i, r, t, 0) for i, (r, t) in enumerate(turns)]
    a, b, c = ("user", "hi"), ("assistant", "ho"), ("user", None)
    rows = [*say(1, a), *say(2, a, b), *say(3, a, b, c), *say(4, a, b, c), *say(5, a, c), *say(6, ("user", "")), *say(None, ("system", "s")), (7, 5000, "user", "late", 0), (7, None, "user", "first", 0), (7, 2, "user", "mid", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat_format.format_chats(df).collect()}
    assert sorted(k for k in got if k is not None) == [3, 5, 6, 7] and None in got
    assert got[3] == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nho<|end|>\n<|user|>\n<|end|>\n")
    assert re.findall("first|mid|late", got[7][1]) == ["first", "mid", "late"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(10)] + [(300, None), (301, [1.0, None]), (302, [math.nan] * 8), (303, [math.inf] * 8), (350, [0.0] * 8), (400, [0.5]), (None, [1.0] * 8), (7, rows[7][1]), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for terms in (4_000_000, 9):  # one block of queries, and many
        got = vector_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_terms=terms).collect()
        found = {}
        for r in got:
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        queries = sorted({i for i, _ in v if i % 50 == 0})
        assert sorted(found) == queries
        for q in queries:
            own = next(w for i, w in v if i == q)
            best = sorted((-sum(x * y for x, y in zip(own, w, strict=False)), i) for i, w in v if i != q)[:5]
            assert sorted(found[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert vector_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert vector_topk.top_k(df.where("vec_id IN (0, 1)"), F.col("vec_id") % 50 == 0, 5).count() == 1


def test_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (102, 102), (103, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 103: 100}


# --- 10 ---
def _toxic_tables(spark):
    rng = np.random.default_rng(8)
    parts = ["th", "er", "on", "an", "re", "ed", "in", "st", "ou", "le", "ha", "wi"]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 5))))
    bad = ["idiot", "moron", "clown", "loser"]
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words.insert(5, str(rng.choice(bad)))
            words.insert(20, "lowei" + str(rng.choice(parts)))
        docs.append((i, " ".join(words), 1))
        labels.append((i, int(i % 4 == 0), "x"))
    extra = ["a i.d-i.o.t here", "so i d i o t then", "an idxiot now", "some loweiha", "the and of " * 30, "", None, "123 !!", "x" * 5000]
    docs += [(1000 + k, t, 1) for k, t in enumerate(extra)] + [(None, "you moron", 1), (0, docs[0][1], 1)]
    labels += [(1, None, "x"), (None, 1, "x"), (5, 7, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity(spark):
    docs, labels = _toxic_tables(spark)
    got = toxicity.judge_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert [by[1000 + k]["predicted"] for k in range(9)] == [1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert by[None]["predicted"] == 1 and not by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_without_labels(spark):
    docs, labels = _toxic_tables(spark)
    assert {r["score"] for r in toxicity.judge_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.judge_toxicity(docs.limit(0), labels).count() == 0


def test_kernel_is_the_sum_over_triples():
    def slow(word):
        s, out = f"^{word}$", {}
        code = lambda c: {"^": toxicity.START, "$": toxicity.END}.get(c) or (ord(c) - 97)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN + 1)):
                    key = ((0 if s[i] == "a" else code(s[i])) * 40 + (0 if s[j] == "a" else code(s[j]))) * 40 + (0 if s[k] == "a" else code(s[k]))
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    for w in ("idiot", "abcabc", "a"):
        dense = toxicity.features(w) * toxicity._norms([w])[0]
        want = np.zeros(len(dense))
        for k, x in slow(w).items():
            want[k] += x
        assert np.allclose(dense, want)
    assert np.allclose(toxicity.project(["idiot", "clown"], toxicity.features("idiot")), [toxicity.features("idiot") @ toxicity.features(w) for w in ("idiot", "clown")])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = _toxic_tables(spark)
    rng = np.random.default_rng(1)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))
    passage, item, text = line(60), line(20), line(80)
    more = [(2000, f"{line(30)} {passage}"), (2001, f"{passage} {line(30)}"), (2002, f"{line(10)} {item}"), (2003, text), (2004, text + " end"), (2005, line(100))]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    frame = frame.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == frame.columns
            seen.append({r["doc_id"]: r["text"] for r in at.collect()})
    toxic, near, cut, clean = seen
    assert 4 not in toxic and 1003 not in toxic and 1 in toxic and 2005 in toxic
    assert 2003 in near and 2004 not in near and 1005 in near and 1006 not in near
    assert passage in cut[2000] and passage not in cut[2001] and cut[2005] == near[2005]
    assert 2002 not in clean and 2005 in clean and 2001 in clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(clean)
