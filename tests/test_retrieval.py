"""The text pipeline, its reports and projections, labelled queries, and collections with commit and abort."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import graph, ranking
from quarrymill.operators.vectors import encode_distinct, letter_encoder
from quarrymill.plans import retrieval
from quarrymill.sources import collection, files

WORDS = ("pump valve", "valve motor", "motor pump pump", "cold room", "room heater", "zzz")


def encode(df):
    return encode_distinct(df.withColumn("text", F.lower("text")), None, letter_encoder(), "local", "letters")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("k", f"c{i}", i // 3, i % 3, w, "pump.txt" if i < 3 else None) for i, w in enumerate(WORDS)]
    df = spark.createDataFrame(rows, "kb_id string, chunk_id string, file_id long, chunk_index int, content string, filename string")
    return encode(df.withColumn("text", F.col("content"))).drop("text")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(7, "k", "Pump  valve"), (8, "k", "cold room"), (9, "k", ""), (10, "none", "pump")], "query_id long, kb_id string, query_text string")


def test_text_search(spark, corpus, queries):
    stages = ranking.Stages()
    found = retrieval.text_search(queries, corpus, 2, 6, encode, stages=stages, scorer=lambda q, c: c.str.len() - 10.0)
    rows = sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"]))
    assert {r["query_id"] for r in rows} == {7, 8}  # a query without text, and one of an unknown knowledge base, find nothing
    first = rows[0]
    assert first["chunk_id"] == "c0" and first["similarity"] == 1.0 and first["rank"] == 1 and first["kb_id"] == "k"
    assert first["rerank_score"] == 1.0 and abs(first["second_score"] - (0.7 / (1 + 2.718281828459045**0) + 0.3)) < 1e-6
    counts = stages.counts()
    assert counts["candidates"] >= counts["threshold"] >= counts["clusters"] >= 2
    # diversification reorders what is clustered, and loses nothing
    other = retrieval.text_search(queries, corpus, 2, 6, encode, diversify=True)
    assert sorted((r["query_id"], r["key"], r["rank"]) for r in other.collect()) == sorted((r["query_id"], r["key"], r["rank"]) for r in rows)


def test_variants_count_a_chunk_once(spark, corpus, queries):
    found = retrieval.text_search(queries, corpus, 10, 6, encode)
    assert found.groupBy("query_id", "key").count().where("count > 1").isEmpty()


def test_scorer_sees_chosen_rows_only(spark):
    df = spark.createDataFrame([(1, "q", "a" * 2000, True), (1, "q", None, True), (1, "q", "c", False), (1, "q", "d", None)], "query_id long, query_text string, content string, on boolean")

    def scorer(queries, contents):
        assert len(queries) and set(contents) <= {"a" * 1500, ""}
        return contents.str.len()

    got = {r["content"]: r["logit"] for r in ranking.score_with(df, scorer, F.col("on")).collect()}
    assert got == {"a" * 2000: 1500.0, None: 0.0, "c": None, "d": None}


def test_projection(spark):
    df = spark.createDataFrame([(1, 1, "x", 0.5, 0.9, ["graph", "vector"], "c1", 3, None), (1, 2, None, 0.4, None, [], None, None, None)], "query_id long, rank int, content string, score double, final_score double, channels array<string>, chunk_id string, file_id int, filename string")
    a, b = ranking.projected(df, ("file_id", "filename")).orderBy("rank").collect()
    assert a.asDict() == {"query_id": 1, "rank": 1, "content": "x", "similarity": 0.9, "metadata": {"file_id": "3", "channels": "graph,vector"}, "source": "unknown", "chunk_id": "c1"}
    assert (b["content"], b["similarity"], b["chunk_id"], b["metadata"]) == ("", 0.4, None, {"channels": ""})
    assert ranking.projected(df.select("query_id", "rank", "content")).first()["similarity"] == 0.0


def test_entity_report(spark):
    names = spark.createDataFrame([(1, 0, "Pump"), (1, 1, "Pump"), (1, 0, "水泵的结构"), (2, 0, "-")], "query_id long, kb_id int, query_entity string")
    entities = spark.createDataFrame([(0, "pump", "Pump", 3, 0.9, ["P"])], "kb_id int, canonical_name string, name string, mention_count int, confidence double, aliases array<string>")
    rows = {r["query_id"]: r for r in graph.entity_report(names, graph.lookup(names, entities)).collect()}
    one = rows[1]
    assert one["extracted_entities"] == ["Pump", "水泵的结构"] and one["matched_entities"] == ["Pump"] and one["unmatched_entities"] == ["水泵的结构"] and one["fallback_used"]
    assert [(d["kb_id"], d["matched_entity"], d["match_stage"]) for d in one["match_details"]] == [(0, "Pump", "exact"), (0, None, "none"), (1, None, "none")]
    assert rows[2]["matched_entities"] == [] and rows[2]["normalized_entities"] == [] and not rows[2]["fallback_used"]
    channels = spark.createDataFrame([(1, "vector"), (1, "vector"), (3, "graph")], "query_id long, channel string")
    got = {r["query_id"]: r for r in ranking.search_report(channels, channels.where("query_id = 1"), graph.entity_report(names, graph.lookup(names, entities))).collect()}
    assert set(got) == {1, 2, 3} and got[1]["vector_result_count"] == 2 and got[1]["fused_result_count"] == 2 and got[2]["graph_result_count"] == 0 and got[3]["matched_entities"] is None


def test_diversity_without_chunk_ids(spark):
    rows = [(1, None, "g", "e", "x" * 130, 0, 0.9), (1, None, "g", "e", "x" * 120 + "y", 1, 0.8), (1, "", "h", "e", "x", 1, 0.7), (1, "c", "g", None, None, None, 0.6), (1, "c", "g", None, None, None, 0.6)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, source string, entity string, content string, kb_id int, score double")
    out = ranking.diversify_sources(df).orderBy(F.desc("score")).collect()
    # the second row is the first one's copy by its first 120 characters
    assert [r["score"] for r in out] == [0.9, 0.7, 0.6] and out[0]["key"].startswith("g|e|") and len(out[0]["key"]) == 20 and out[2]["key"] == "c"


def test_numbers_of_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, 401)))
    (tmp_path / "b.jsonl").write_text("line 1")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 3  # the file is split
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 401 and all(r["value"] == (f"line {r['line']}" if r["line"] % 5 else "") for r in got)


def test_labelled_queries_fail_with_their_line(spark, tmp_path):
    good = '{"kb_id": 1, "query": "a"}\n\n{"kb_id": null, "query": "b", "relevant_keywords": ["w"]}\n'
    (tmp_path / "good.jsonl").write_text(good)
    rows = files.read_labelled_queries(spark, str(tmp_path / "good.jsonl")).orderBy("query").collect()
    assert [(r["kb_id"], r["query"], r["relevant_chunk_ids"], r["relevant_keywords"]) for r in rows] == [(1, "a", [], []), (None, "b", [], ["w"])]
    assert files.read_labelled_queries(spark, str(tmp_path / "good.jsonl"), 1).first()["query"] == "a"
    for i, (bad, why) in enumerate([('{"kb_id": 1, "query"', "not a JSON object"), ("[1]", "not a JSON object"), ('{"kb_id": 1}', "kb_id or query is missing")]):
        (tmp_path / f"bad{i}.jsonl").write_text(good + bad + "\n")
        with pytest.raises(Exception, match=f"line 4 of .*bad{i}.jsonl: {why}"):
            files.read_labelled_queries(spark, str(tmp_path / f"bad{i}.jsonl")).collect()


def test_collection_commits_whole_runs(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "id long, v string"
    df = spark.range(100).repartition(3).select("id", F.col("id").cast("string").alias("v"))
    assert collection.read_collection(spark, path, schema).count() == 0
    collection.add_run(df, path, "one")
    collection.add_run(df, path, "one")  # a replay
    collection.add_run(df.where("id < 0"), path, "none")
    assert collection.read_collection(spark, path, schema).count() == 100
    assert [(r["run_id"], r["rows"]) for r in collection.committed(spark, path)] == [("none", 0), ("one", 100)]
    collection.remove_run(spark, path, "one")
    assert collection.read_collection(spark, path, schema).count() == 0


def test_collection_after_a_failed_task(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "id long"

    @F.pandas_udf("long")
    def breaks(ids: pd.Series) -> pd.Series:
        if (ids == 99).any():
            raise ValueError("half-way")
        return ids

    collection.add_run(spark.range(5), path, "before")
    with pytest.raises(Exception):
        collection.add_run(spark.range(0, 100, 1, 4).select(breaks("id").alias("id")), path, "broken")
    assert collection.read_collection(spark, path, schema).count() == 5
    left = [name for name in os.listdir(path) if name.startswith("broken")]
    assert not left and len(os.listdir(path)) == 2  # the first run's folder and the marks
    with pytest.raises(Exception):
        spark.range(1).write.format("collection").mode("overwrite").save(path)
