"""Paths around hubs against all paths, and what merges and upserts keep."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarrymill.operators import graph

RELATIONS = "kb_id int, source string, target string, type string, chunk_ids array<string>"


def test_paths_around_hubs_equal_all_paths(spark):
    """The cut of a node's neighbours changes no result: hubs, parallel relations, loops back to the start."""
    rng = random.Random(3)
    edges = {(rng.choice("ab"), "hub", f"n{rng.randrange(60):02d}", rng.choice("xyz")) for _ in range(150)}
    edges |= {("a", f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}", rng.choice("xy")) for _ in range(60)}
    edges |= {("a", "s", "hub", t) for t in "uvw"} | {("a", "hub", "s", t) for t in "tuvwxyz"} | {("a", "lone", "s", "x"), ("b", "lone", "hub", "x")}
    rows = [(ord(kb) - 97, s, t, k, [f"c{rng.randrange(9)}" for _ in range(3)]) for kb, s, t, k in sorted(edges) if s != t]
    relations = spark.createDataFrame(rows, RELATIONS)
    starts = spark.createDataFrame([(1, 0, "s"), (2, 0, "hub"), (3, 0, "lone"), (4, 1, "lone"), (5, 0, "n07"), (6, 0, "nowhere")], "query_id long, kb_id int, entity string")
    every = graph.paths(starts, relations, limit=None).collect()
    key = lambda r: (r["hop"], r["target"], ",".join(r["relations"]), ",".join(r["evidence"]))
    for limit in (1, 3, 5):
        wanted = {(q, r["kb_id"], key(r)) for q in range(1, 7) for r in sorted((r for r in every if r["query_id"] == q), key=key)[:limit]}
        got = graph.paths(starts, relations, limit=limit).collect()
        assert {(r["query_id"], r["kb_id"], key(r)) for r in got} == wanted and len(got) == len(wanted)


def test_a_hub_hands_on_few_rows(spark):
    hub = [(0, "hub", f"n{i:05d}", "x", ["c"]) for i in range(5000)] + [(0, f"s{i}", "hub", "x", ["c"]) for i in range(20)]
    starts = spark.createDataFrame([(i, 0, f"s{i}") for i in range(20)], "query_id long, kb_id int, entity string")
    got = graph.paths(starts, spark.createDataFrame(hub, RELATIONS))
    assert got.count() == 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan or "_place" in plan  # the neighbours are cut before they meet the starts


def entity(seq, name, kind, chunks, attributes, labels=("l",)):
    return (1, seq, "N", name, kind, list(labels), [name], 0.5 + seq / 100, 1, chunks, attributes)


ENTITY = "kb_id int, seq int, canonical_name string, name string, type string, labels array<string>, aliases array<string>, confidence double, mention_count int, chunk_ids array<string>, attributes map<string,string>"


def test_merge_counts_chunks_once_and_keeps_first_attributes(spark):
    rows = [entity(2, "b", "brand", ["c1", "c2"], {"k": "two"}), entity(1, "a", None, ["c1"], {"k": "one", "j": "x"}, ("m",)), entity(3, "c", "other", [], None), entity(4, "d", "unknown", None, {})]
    got = graph.merge_entities(spark.createDataFrame(rows, ENTITY)).first()
    assert (got["name"], got["type"], got["mention_count"], got["n_chunks"], got["chunk_ids"]) == ("a", "brand", 4, 2, ["c1", "c2"])
    assert got["attributes"] == {"j": "x", "k": "one"} and got["labels"] == ["l", "m"] and got["aliases"] == ["a", "b", "c", "d"]
    slim = graph.merge_entities(spark.createDataFrame(rows, ENTITY), attributes=False)
    assert "attributes" not in slim.columns and slim.first()["n_chunks"] == 2


def test_attributes_survive_an_upsert(spark):
    merged = lambda *rows: graph.merge_entities(spark.createDataFrame(list(rows), ENTITY))
    old = merged(entity(1, "a", "t", ["c1"], {"k": "old", "only": "old"})).withColumns({"first_run_id": F.lit("r1"), "last_run_id": F.lit("r1")})
    got = graph.upsert_entities(old, merged(entity(2, "a", "t", ["c2"], {"k": "new", "more": "new"})), "r2").first()
    assert got["attributes"] == {"only": "old", "k": "new", "more": "new"} and got["mention_count"] == 2
    relation = lambda seq, attributes: (1, seq, "A", "B", "t", 0.5, 1, ["c1"], attributes)
    schema = "kb_id int, seq int, source string, target string, type string, confidence double, evidence_count int, chunk_ids array<string>, attributes map<string,string>"
    ends = spark.createDataFrame([(1, "A"), (1, "B")], "kb_id int, canonical_name string")
    made = lambda *rows: graph.merge_relations(spark.createDataFrame(list(rows), schema), ends)
    first = made(relation(2, {"a": "second"}), relation(1, {"a": "first"}), relation(0, {}))
    assert first.first()["attributes"] == {"a": "first"} and first.first()["n_chunks"] == 1
    both = graph.upsert_relations(first.withColumn("first_run_id", F.lit("r1")), made(relation(3, None)), "r2").first()
    assert both["attributes"] == {"a": "first"} and both["evidence_count"] == 4


def test_merges_keep_the_least_ids_and_count_all(spark):
    rows = spark.createDataFrame([entity(i, "a", "t", [f"c{i % 7}"], {"k": str(i)}) for i in range(30)] + [entity(40, "b", "t", [], None)], ENTITY)
    for chunks, ids in ((None, [f"c{i}" for i in range(7)]), (5, [f"c{i}" for i in range(5)])):
        (got,) = graph.merge_entities(rows, chunks=chunks).collect()
        assert (got["chunk_ids"], got["n_chunks"], got["mention_count"], got["attributes"]) == (ids, 7, 31, {"k": "0"})
    assert graph.merge_entities(rows, attributes=False, chunks=0).columns == ["kb_id", "canonical_name", "name", "type", "labels", "aliases", "confidence", "mention_count"]
    ties = spark.createDataFrame([(1, i, "N", "M", "t", 0.5, 1, [f"c{i % 7}"]) for i in range(30)] + [(1, 1, "N", "lost", "t", 0.5, 1, ["c1"])], "kb_id int, seq int, source string, target string, type string, confidence double, evidence_count int, chunk_ids array<string>")
    ends = spark.createDataFrame([(1, "N"), (1, "M")], "kb_id int, canonical_name string")
    (got,) = graph.merge_relations(ties, ends, chunks=5).collect()
    assert (got["target"], got["evidence_count"], got["chunk_ids"], got["n_chunks"]) == ("M", 30, [f"c{i}" for i in range(5)], 7)
    (got,) = graph.merge_relations(ties, ends, chunks=0).collect()
    assert got["evidence_count"] == 30 and "chunk_ids" not in got.asDict()


def test_numbers_of_neighbours_need_no_lists(spark):
    relations = spark.createDataFrame([(1, "N", f"m{i % 9}", "xy"[i % 2], ["c"]) for i in range(40)], RELATIONS)
    names = spark.createDataFrame([(1, "N"), (1, "m1"), (1, "alone")], "kb_id int, canonical_name string")
    found = graph.neighbours(relations, names)
    counts = found.select("canonical_name", "n_outgoing", "n_incoming")
    assert {tuple(r) for r in counts.collect()} == {("N", 18, None), ("m1", None, 2), ("alone", None, None)}
    assert "collect_" not in counts._jdf.queryExecution().optimizedPlan().toString()
    few = {r["canonical_name"]: r for r in graph.neighbours(relations, names, most=3).collect()}
    whole = {r["canonical_name"]: r for r in found.collect()}
    assert few["N"]["outgoing"] == whole["N"]["outgoing"][:3] and len(whole["N"]["outgoing"]) == 18 and few["m1"]["incoming"] == whole["m1"]["incoming"]


def test_counts_left_equals_delete_file(spark):
    """Counted from extractions by chunk: what delete_file leaves of the merged tables, with repeated rows, self-loops and null ends."""
    rows = [(i % 2, f"c{i % 13}-{i % 2}", int(i % 13 % 3 == 0), f"a{i % 4}", f"a{i % 5}" if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "kb_id int, chunk_id string, file_id int, a string, b string")
    told = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    spoken = lambda x: F.array(told("entity", x["a"]), told("entity", x["b"]), F.when(x["a"] != x["b"], told("relation", F.concat_ws("|", x["a"], F.lit("t"), x["b"]))))
    wanted = {}
    for kb, chunk, file, a, b in rows:
        if not (kb == 0 and file == 1):
            for name in (("entity", a), ("entity", b), *([("relation", f"{a}|t|{b}")] if b is not None and a != b else [])):
                wanted.setdefault((kb, *name), set()).add(chunk)
    for per_task in (250_000, 7):
        made = graph.counts_left(0, 1, df, spoken, per_task)
        assert {tuple(r)[:3]: r["n"] for r in made.collect()} == {k: len(c) for k, c in wanted.items()}
    seq = df.withColumn("seq", F.monotonically_increasing_id())
    ties = seq.where("b is not null").select("kb_id", "seq", F.col("a").alias("source"), F.col("b").alias("target"), F.lit("t").alias("type"), F.lit(0.5).alias("confidence"), F.lit(1).alias("evidence_count"), F.array("chunk_id").alias("chunk_ids"))
    mentions = seq.select("kb_id", "chunk_id", F.explode(F.array("a", "b")).alias("canonical_name")).where("canonical_name is not null").distinct()
    relations = graph.merge_relations(ties, mentions)
    support = relations.select("kb_id", F.concat_ws("|", "source", "type", "target").alias("fact_id"), F.explode("chunk_ids").alias("chunk_id"))
    left = graph.delete_file(0, 1, df.select("kb_id", "chunk_id", "file_id").distinct(), mentions, mentions.select("kb_id", "canonical_name").distinct(), relations, support)
    assert {(r["kb_id"], "relation", f"{r['source']}|t|{r['target']}"): len(r["chunk_ids"]) for r in left["relations"].collect()} == {k: len(c) for k, c in wanted.items() if k[1] == "relation"}
    assert {(r["kb_id"], "entity", r["canonical_name"]) for r in left["entities"].collect()} == {k for k in wanted if k[1] == "entity" and k[2] is not None}


def test_delete_file_makes_no_lists_of_a_names_chunks(spark):
    from quarrymill.plans.queries_graph import delete_file

    plan = delete_file(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_ids" not in plan and "Join" not in plan


def test_channel_with_ids_looked_up_equals_the_one_with_lists(spark):
    """Ids taken from rows that repeat, for what is found only, make the same paths, counts and scores as lists in the tables."""
    rng = random.Random(8)
    edges = sorted({(rng.randrange(2), f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice("xy")) for _ in range(60)} | {(0, "n1", "n2", "x"), (0, "n2", "n1", "x")})
    rows = [(kb, s, t, k, [f"c{rng.randrange(12):02d}" for _ in range(rng.randrange(9))]) for kb, s, t, k in edges if s != t]
    listed = spark.createDataFrame(rows, RELATIONS)
    evidence = listed.select("kb_id", "source", "target", "type", F.explode("chunk_ids").alias("chunk_id"))
    evidence = evidence.unionByName(evidence.limit(40)).unionByName(evidence.limit(3).withColumn("chunk_id", F.lit(None).cast("string")))
    names = [(kb, f"n{i}", [f"c{j}" for j in range(i)]) for kb in range(2) for i in range(9)]
    entities = spark.createDataFrame(names, "kb_id int, canonical_name string, chunk_ids array<string>").withColumns({"name": F.col("canonical_name"), "aliases": F.array(F.upper("canonical_name")), "confidence": F.lit(0.5), "mention_count": F.lit(3).cast("long")})
    mentioned = entities.select("kb_id", "canonical_name", F.explode("chunk_ids").alias("chunk_id"))
    mentioned = mentioned.unionByName(mentioned)
    asked = spark.createDataFrame([(i, kb, f"N{i}") for i in range(9) for kb in range(2)], "query_id long, kb_id int, query_entity string")
    starts = asked.select("query_id", "kb_id", F.lower("query_entity").alias("entity"))
    key = lambda r: tuple(map(str, r))
    columns = ["query_id", "kb_id", "entity", "target", "relations", "evidence", "hop"]
    plain = graph.paths(starts, listed).select(columns).collect()
    assert sorted(map(key, graph.paths(starts, listed.drop("chunk_ids"), evidence=evidence).select(columns).collect())) == sorted(map(key, plain)) and plain
    columns = ["query_id", "kb_id", "key", "source", "entity", "hop", "score", "rank"]
    plain = graph.graph_channel(asked, entities, listed, 20).select(columns).collect()
    hit = graph.lookup(asked, entities)
    got = graph.graph_channel(asked, entities.drop("chunk_ids"), listed.drop("chunk_ids"), 20, hit=hit, mentioned=mentioned, evidence=evidence)
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, plain)) and plain


def test_letters_and_the_graph_of_hybrid_search_carry_no_texts_or_ids(spark):
    from quarrymill.plans import queries_graph

    texts = spark.createDataFrame([(1, "Abba"), (2, None), (3, "abba")], "id long, text string")
    made = queries_graph.letters_of(texts, "id", "text")
    got = {r["id"]: list(r["embedding"]) for r in made.collect()}
    assert got[1] == got[3] and not any(got[2]) and len(got[1]) == 26
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    held = queries_graph.looked_up(spark, "/root/testdata/sf0.001")
    assert "chunk_ids" not in held["entities"].columns + held["relations"].columns
