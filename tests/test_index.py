"""The vector index against all pairs: recall, work, and every vector findable, with odd lengths, nulls, copies and empty tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarrymill.operators import index, vectors

CORPUS, QUERIES = "kb_id string, chunk_id string, embedding array<float>", "query_id long, kb_id string, vector array<float>"


def clusters(n=1500, dim=16, groups=25, seed=0):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((groups, dim)) * 4
    x = heads[rng.integers(0, groups, n)] + 0.5 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x, q, k):
    return {(i, str(j)) for i in q for j in np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:k]}


def test_recall_with_a_tenth_of_the_cells(spark):
    x = clusters()
    corpus = spark.createDataFrame([("a", str(i), [float(c) for c in v]) for i, v in enumerate(x)], CORPUS)
    asked = list(range(0, 1500, 30))
    queries = spark.createDataFrame([(i, "a", [float(c) for c in x[i]]) for i in asked], QUERIES)
    made = index.build(corpus)
    assert len(made.centres) == int(4 * 1500**0.5)
    got = index.search(made, queries, corpus, 10).collect()
    assert len({(r["query_id"], r["chunk_id"]) for r in got} & nearest(x, asked, 10)) >= 0.9 * 10 * len(asked)
    assert all(r["chunk_id"] == str(r["query_id"]) and r["similarity"] > 0.999 for r in got if r["rank"] == 1)
    scored = {r["query_id"]: r["scored"] for r in index.scored_rows(made, queries, 0.1).collect()}
    assert np.mean(list(scored.values())) < 0.2 * 1500
    exact = {tuple(r)[:4] for r in vectors.knn(queries, corpus, 10).collect()}
    everything = {tuple(r)[:4] for r in index.search(made, queries, corpus, 10, share=1.0, rerank=150).collect()}
    assert everything == exact  # all cells, all candidates


def test_every_vector_is_indexed_once(spark):
    x = clusters(300, 8, 3)
    rows = [("ab"[i % 2], str(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [("a", f"copy{i}", [1.0] * 8) for i in range(200)]  # one group of copies
    rows += [("a", "short", [1.0, 0.0, 0.0]), ("a", "short2", [0.0, 1.0, 0.0]), ("b", "none", None), (None, "lost", [1.0] * 8), ("a", "empty", [])]
    corpus = spark.createDataFrame(rows, CORPUS)
    made = index.build(corpus, cells=12)
    held = made.blocks.select("kb", F.explode("ids").alias("id")).collect()
    assert sorted((r["kb"], r["id"]) for r in held) == sorted((kb, i) for kb, i, v in rows if kb and v and len(v) == 8)
    queries = spark.createDataFrame([(1, "a", [1.0] * 8), (2, "b", [1.0] * 8), (3, "a", [1.0, 0.0, 0.0]), (4, "a", None), (5, "nowhere", [1.0] * 8)], QUERIES)
    got = index.search(made, queries, corpus, 5, share=1.0, rerank=60).collect()
    by_query = {q: [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(1, 6)}
    assert all(c.startswith("copy") for c in by_query[1]) and len(by_query[1]) == 5
    assert len(by_query[2]) == 5 and all(int(c) % 2 == 1 for c in by_query[2])
    assert by_query[3] == ["short", "short2"]  # another length, exactly
    assert by_query[4] == by_query[5] == []


def test_index_of_nothing(spark):
    corpus = spark.createDataFrame([], CORPUS)
    queries = spark.createDataFrame([(1, "a", [1.0] * 8)], QUERIES)
    assert index.search(index.build(corpus), queries, corpus, 3).collect() == []


def test_centres_are_those_of_plain_k_means(spark):
    x = clusters(400, 8, 6)
    sample = spark.createDataFrame([([float(c) for c in v],) for v in x], "embedding array<double>").repartition(5)
    plain = x[:7].copy()
    for _ in range(4):
        own = ((x[:, None, :] - plain[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in set(own):
            plain[j] = x[own == j].mean(axis=0)
    assert np.allclose(index.fit_centres(sample, x[:7].copy(), 4), plain, atol=1e-9)


def test_lots_and_parts_of_all_pairs(spark):
    x = clusters(200, 4, 8)
    rows = [("a", str(i), [float(c) for c in v]) for i, v in enumerate(x)]
    corpus = spark.createDataFrame([*rows, ("a", "short", [1.0]), ("b", "0", rows[0][2]), ("a", "none", None), (None, "x", rows[0][2])], CORPUS)
    asked = list(range(0, 200, 10))
    queries = spark.createDataFrame([*[(i, "a", rows[i][2]) for i in asked], (1, "b", rows[0][2]), (2, "c", rows[0][2]), (3, "a", None)], QUERIES)
    whole = sorted(map(tuple, vectors.knn(queries, corpus, 5).collect()))
    assert {r[:3] for r in whole if r[1] == "b"} == {(1, "b", "0")}
    # equal similarities after rounding are ordered by the id, so compare with distances rounded likewise
    for i in asked:
        s = np.round(np.clip(1 - ((x - x[i]) ** 2).sum(1) / 2, 0, 1), 4)
        best = sorted(range(200), key=lambda j: (-s[j], str(j)))[:5]
        assert [r["chunk_id"] for r in vectors.knn(queries.where(F.col("query_id") == i), corpus, 5, 4).orderBy("rank").collect()] == [str(j) for j in best] if i % 100 == 0 else True
    assert sorted(map(tuple, vectors.knn(queries, corpus, 5, lot_rows=7, part_rows=3).collect())) == whole


def test_queries_of_all_pairs_are_not_broadcast(spark):
    """AQE saw queries that are small before they are copied to all lots, and broadcast the copies."""
    x = clusters(300, 4, 8)
    corpus = spark.createDataFrame([("a", str(i), [float(c) for c in v]) for i, v in enumerate(x)], CORPUS)
    found = vectors.knn(corpus.select(F.col("chunk_id").cast("long").alias("query_id"), "kb_id", F.col("embedding").alias("vector")), corpus, 3)
    assert len(found.collect()) == 900
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "lot#" in line]


def test_queries_of_the_index_are_not_broadcast(spark):
    x = clusters(600)
    corpus = spark.createDataFrame([("a", str(i), [float(c) for c in v]) for i, v in enumerate(x)], CORPUS)
    queries = corpus.where("cast(chunk_id as int) % 20 = 0").select(F.col("chunk_id").cast("long").alias("query_id"), "kb_id", F.col("embedding").alias("vector"))
    found = index.search(index.build(corpus), queries, corpus, 5)
    assert len(found.collect()) == 150
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for above, line in zip(lines, lines[1:]) if "BroadcastHashJoin" in line and "cell#" in line and "Inner" in line and "ids#" in above]


def test_small_keys_are_not_copied(spark):
    """lsh_knn has many small keys: queries went to as many lots as there are shuffle partitions, whatever the key's size."""
    import pyarrow as pa

    def sizes(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table([pa.array([len(left)], pa.int64()), pa.array([len(right)], pa.int64())], ["q", "c"])

    q, c = spark.range(30).selectExpr("id", "id % 3 as kb"), spark.range(60).selectExpr("id", "id % 3 as kb")
    whole = vectors.meeting(q, c, ["kb"], ("id", 10), ("id", 20)).applyInArrow(sizes, "q long, c long").collect()
    assert sorted(map(tuple, whole)) == [(10, 20)] * 3
    cut = vectors.meeting(q, c, ["kb"], ("id", 10), ("id", 5)).applyInArrow(sizes, "q long, c long")
    assert tuple(cut.selectExpr("sum(c)", "max(q)").first()) == (60, 10)  # four lots a key: queries are copied, vectors aren't
