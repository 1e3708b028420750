"""Pruned BM25 and the keyword search against their plain forms."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.operators import keyword

CHUNKS, QUERIES = "kb_id string, chunk_id string, content string", "query_id long, kb_id string, query_text string"
VOCABULARY = [f"w{i:03d}" for i in range(200)]


def corpus(rng, n=400):
    words = lambda: " ".join(rng.choices(VOCABULARY, weights=[1 / (i + 1) for i in range(200)], k=rng.randrange(1, 60)))
    rows = [("ab"[i % 2], f"c{i}", words()) for i in range(n)]
    return [*rows, ("a", "same1", "w001 w002"), ("a", "same2", "W001 w002!"), ("a", "blank", ""), ("b", "none", None), ("a", "inside", "xw150x w151y_ w00")]


def questions(rng, n=25):
    rows = [(i, "ab"[i % 2], " ".join(rng.choices(VOCABULARY, k=rng.randrange(1, 9)))) for i in range(n)]
    return [*rows, (100, "a", "w001 W001 w001"), (101, "a", ""), (102, "a", None), (103, "a", "zzz"), (104, "nowhere", "w001"), (105, "a", " ".join(VOCABULARY))]


@pytest.mark.parametrize(("block", "most"), [(4, 3), (16, 10), (256, 500)])
def test_pruned_equals_whole(spark, monkeypatch, block, most):
    monkeypatch.setattr(keyword, "BLOCK", block)
    rng = random.Random(block)
    chunks, queries = spark.createDataFrame(corpus(rng), CHUNKS), spark.createDataFrame(questions(rng), QUERIES)
    rank = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy(F.desc("ft_score"), "chunk_id"))
    wanted = {tuple(r) for r in keyword.bm25(queries, chunks).withColumn("r", rank).where(F.col("r") <= most).drop("r").collect()}
    for asked in (queries, None):  # an index for these queries, and one for any
        got = {tuple(r) for r in keyword.bm25_top(queries, keyword.impacts(chunks, asked), most).collect()}
        assert got == wanted and wanted


def test_blocks_are_skipped(spark, monkeypatch):
    """Where a rare word decides, the postings of the frequent ones aren't read."""
    monkeypatch.setattr(keyword, "BLOCK", 8)
    rows = [("a", f"c{i:04d}", "the of and " * (1 + i % 5) + (f"rare{i % 50} " * 3 if i % 10 == 0 else "")) for i in range(1000)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(i, "a", f"the of and rare{10 * i}") for i in range(5)], QUERIES)
    index = keyword.impacts(chunks, queries)
    looked = keyword.bm25_top(queries, index, 5, looked=True).collect()
    assert len(looked) == 5 and all(r["skipped"] > 10 * r["read"] for r in looked)
    sizes = index.blocks.select(F.size("ids").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 8  # a frequent token is many blocks


def plain_search(rows, asked, k):
    """keyword.score over all chunks that search would take as candidates, in Python."""
    import math
    import re

    split = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    out = set()
    for qid, kb, text in asked:
        own = [(c, t) for x, c, t in rows if x == kb]
        docs = {c: split(t) for c, t in own}
        n, mean = len(docs), sum(map(len, docs.values())) / max(1, sum(t is not None for _, t in own))
        terms = list(dict.fromkeys(split(text)))
        ft = {}
        for c, words in docs.items():
            s = 0.0
            for t in terms:
                tf, df = words.count(t), sum(t in w for w in docs.values())
                if tf:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if s:
                ft[c] = round(s, 6)
        ask = [t for t in dict.fromkeys(re.split(r"[\s_]+", (text or "").lower())) if len(t) > 1]
        best = sorted(ft, key=lambda c: (-ft[c], c))[: max(8 * k, 60)] if ft else [c for c, t in own if any(a in (t or "").lower() for a in ask)]
        raw = {}
        for c in best:
            low = dict(own)[c].lower()
            counts = [min(3, low.count(a)) for a in ask]
            hits, tf = sum(x > 0 for x in counts), sum(counts)
            if hits:
                x = (0.7 * hits / len(ask) + 0.3 * tf / (tf + 2)) * max(0.6, min(1, 300 / max(300, len(low))))
                raw[c] = x * 0.75 + min(1, ft[c] / (ft[c] + 5)) * 0.25 if ft.get(c) else x
        scores = {c: round(min(1, x) / min(1, max(raw.values())), 6) for c, x in raw.items()}
        out |= {(qid, c, s) for c, s in sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k]}
    return out


def test_search_with_its_fallback(spark):
    rng = random.Random(9)
    rows = corpus(rng, 150)
    asked = [*questions(rng, 10)[:10], (200, "a", "w15"), (201, "a", "151y 50x"), (202, "a", "zzz"), (203, "b", "00")]
    got = keyword.search(spark.createDataFrame(asked, QUERIES), spark.createDataFrame(rows, CHUNKS), 5).collect()
    rounded = lambda found: sorted((q, c, round(s, 5)) for q, c, s in found)
    assert rounded((r["query_id"], r["chunk_id"], r["score"]) for r in got) == rounded(plain_search(rows, asked, 5))
    assert {r["query_id"] for r in got} >= {200, 201, 203}


def test_counts_equal_the_expression(spark):
    """Occurrences counted once a chunk are those that score works out for each pair."""
    rng = random.Random(4)
    chunks, queries = spark.createDataFrame(corpus(rng, 60), CHUNKS), spark.createDataFrame(questions(rng, 12)[:12], QUERIES)
    pairs = keyword.bm25(queries, chunks)
    plain = keyword.score(pairs.join(queries, ["query_id", "kb_id"]).join(chunks, ["kb_id", "chunk_id"]), 400).select("query_id", "chunk_id", "score", "rank")
    got = keyword.search(queries, chunks, 400).select("query_id", "chunk_id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.collect()}


def test_containing_gives_each_pair_once_without_exchanging_pairs(spark):
    """Lots and parts of a few rows, equal chunk ids, queries without tokens, knowledge bases without queries."""
    texts = [("a", f"c{i % 40:02d}", " ".join(w for j, w in enumerate(("Alpha", "betamax", "gamma\tdelta", "日本語", "omega")) if (i >> j) & 1)) for i in range(60)] + [("b", "c00", "alpha"), ("c", "c00", "alpha"), ("a", "none", None)]
    asked = [(1, "a", "alph max"), (2, "a", "delta omega alpha"), (3, "a", ""), (4, "b", "pha"), (5, "a", "本"), (6, "z", "alpha"), (7, "a", "gamma delta")]
    chunks, queries = spark.createDataFrame(texts, "kb_id string, chunk_id string, content string"), spark.createDataFrame(asked, "query_id long, kb_id string, query_text string")
    parts = {1: ("alph", "max"), 2: ("delta", "omega", "alpha"), 3: (), 4: ("pha",), 5: ("本",), 6: ("alpha",), 7: ("gamma", "delta")}
    wanted = sorted({(q, kb, c) for q, kb, _ in asked for b, c, x in texts if b == kb and any(p in (x or "").lower() for p in parts[q])})
    for lot, part in ((5, 2), (1000, 1000)):
        assert sorted(tuple(r) for r in keyword.containing(queries, chunks, lot, part).collect()) == wanted
    assert keyword.containing(queries.where("query_id = 3"), chunks).count() == 0


def test_words_are_counted_in_runs_and_once_for_all_figures(spark, monkeypatch):
    monkeypatch.setattr(keyword, "WORDS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 4), pa.array(list("abcd")), pa.array([["x", "y", "x"], None, [], ["z"] * 9])], ["kb_id", "chunk_id", "words"])
    made = list(keyword._tally(iter([batch])))
    assert len(made) > 1
    rows = {(r["chunk_id"], r["token"]): (r["tf"], r["length"]) for b in made for r in b.to_pylist()}
    assert rows == {("a", "x"): (2, 3), ("a", "y"): (1, 3), ("a", ""): (0, 3), ("b", ""): (0, None), ("c", ""): (0, 0), ("d", "z"): (9, 9), ("d", ""): (0, 9)}


def test_holders_of_texts_of_any_length(spark):
    """Texts of any number of words, inside words, blank, null, of another knowledge base."""
    from quarrymill.plans.queries_text import _holders

    texts = [(1, "k", "aa bb cc dd ee ff gg"), (2, "k", "a bb cc dd ee f"), (3, "k", "bb"), (4, "k", "b c"), (5, "k", "aa bb cc"), (6, "k", "a bb cc d"), (7, "k", "zz\nbb yy"), (8, "k", ""), (9, "k", " "), (10, "k", None), (11, "j", "bb"), (12, "k", "d ee ff gg h"), (13, "k", "bb  cc"), (14, "k", " bb cc ")]
    held = [("k", "c1", "x aa bb cc dd ee ff gg hh"), ("k", "c2", "aa bb cc"), ("k", "c3", "abba"), ("k", "c4", None), ("k", "c5", ""), ("k", "c6", "zz\nbb yyy"), ("j", "c7", "bbb cc"), ("k", "c8", "aa bb  cc")]
    got = sorted(tuple(r) for r in _holders(spark.createDataFrame(texts, QUERIES), spark.createDataFrame(held, CHUNKS)).collect())
    assert got == sorted((i, c) for i, kb, t in texts for b, c, x in held if kb == b and t is not None and x is not None and t in x)


def test_leading_equals_whole_and_exchanges_no_postings(spark, monkeypatch):
    """Few parts and many, lots of a few words; chunks without text, words of one chunk more than a lot has."""
    for limits in ({}, {"LEADING": 3, "PARTS": 1, "SLOTS": 3}):
        for name, value in limits.items():
            monkeypatch.setattr(keyword, name, value)
        rng = random.Random(len(limits))
        chunks, queries = spark.createDataFrame(corpus(rng, 300), CHUNKS).repartition(5), spark.createDataFrame(questions(rng), QUERIES)
        for most in (3, 500):
            rank = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy(F.desc("ft_score"), "chunk_id"))
            wanted = {tuple(r) for r in keyword.bm25(queries, chunks).withColumn("r", rank).where(F.col("r") <= most).drop("r").collect()}
            made = keyword.leading(queries, chunks, most)
            assert {tuple(r) for r in made.collect()} == wanted and wanted
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == bool(limits)


def test_lots_hold_what_their_chunks_hold(monkeypatch):
    monkeypatch.setattr(keyword, "LOT_WORDS", 4)
    texts = [["x", "y", "x"], None, [], ["z"] * 300, ["y"], ["x", "y"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["k", "j", "k", "k", "k", "k"]), pa.array(list("abcdef")), pa.array(texts, pa.list_(pa.string()))], ["kb_id", "chunk_id", "words"])
    made, got = [r for b in keyword._lots(iter([batch])) for r in b.to_pylist()], {}
    assert len(made) > 2 and sum(r["n"] for r in made) == 6 and sum(r["told"] for r in made) == 5 and sum(r["total"] for r in made) == 306
    for r in made:
        at = keyword._widened(r["steps"]).cumsum()
        for place, tf in zip(at, keyword._widened(r["tf"]), strict=True):
            got[r["kb_id"], r["ids"][place // len(r["words"])], r["words"][place % len(r["words"])]] = tf
        assert dict(zip(r["words"], r["df"], strict=True)) == {w: sum(w in (texts["abcdef".index(i)] or ()) for i in r["ids"]) for w in r["words"]}
        assert keyword._widened(r["lengths"]).tolist() == [len(texts["abcdef".index(i)] or ()) for i in r["ids"]]
    assert got == {("k", "a", "x"): 2, ("k", "a", "y"): 1, ("k", "d", "z"): 300, ("k", "e", "y"): 1, ("k", "f", "x"): 1, ("k", "f", "y"): 1}


def test_search_exchanges_candidates_texts_only(spark):
    """Of many texts a few are candidates: the others' bytes are in no exchange."""
    rows = [("a", f"c{i:04d}", " ".join(f"t{i * 50 + j}" for j in range(50)) + (" needle" if i % 100 == 0 else "")) for i in range(2000)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    found = keyword.search(spark.createDataFrame([(1, "a", "needle")], QUERIES), chunks, 5)
    above = found._jdf.queryExecution().executedPlan().toString().split("lower(content")[0].splitlines()[::-1]
    assert "LeftSemi" in next(x for x in above if "Exchange hashpartitioning" in x or "LeftSemi" in x)
    assert [r["chunk_id"] for r in found.orderBy("rank").collect()] == [f"c{100 * i:04d}" for i in range(5)]
