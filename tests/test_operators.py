"""Golden rows and invariants of operators that SQL can't check."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.config import Profile
from quarrymill.functions import sql as sql_functions
from quarrymill.functions import text as tx
from quarrymill.operators import chunking, datasets, evaluate, extraction, graph, keyword, ranking, vectors
from quarrymill.sources import files, sinks
from quarrymill.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_keys(spark):
    assert one(spark, tx.tokens(F.lit("Hello, hello a 图 的 World/foo"))) == ["hello", "图", "world", "foo"]
    assert one(spark, tx.lookup_key(F.lit("Ｎ－４７ （冷室）"))) == "n47冷室"
    assert one(spark, tx.code_entities(F.lit("see N-47 and P_1127, 1127A; 见N-47冷室"))) == ["N-47", "P_1127", "1127A"]
    assert one(spark, tx.vector_recall(F.lit(5), F.lit(750))) == 43
    assert one(spark, tx.fallbacks(F.lit("水泵的结构"))) == ["水泵", "结构", "水泵的", "的结构"]
    assert one(spark, tx.variants(F.lit(""))) == []


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    assert [r["start"] for r in chunking.fixed_chunks(df, 4, 1).orderBy("start").collect()] == [0, 3, 6, 9]


@pytest.mark.parametrize("text", ["", "short", "word " * 900, "一。二！" * 700, "x" * 3000, "para one.\n\n" * 200, ("a long line, with commas, " * 40 + "\n") * 5])
def test_recursive_split_keeps_its_contract(text):
    chunks = chunking._split_one(text, "text", Profile(300, 50))
    assert all(c.strip() and len(c) <= 300 for c in chunks)
    assert set("".join(chunks).replace(" ", "").replace("\n", "")) == set(text.replace(" ", "").replace("\n", ""))
    if 0 < len(text.strip()) <= 280:
        assert chunks == [text.strip()]


def test_semantic_split():
    assert chunking.semantic_split("one two three\n\none two four", 1, 100) == ["one two three\n\none two four"]
    assert all(len(c) <= 50 for c in chunking.semantic_split("A sentence here. " * 30, 5, 50))
    assert chunking.force_split("x" * 70 + ". Short. Other.", 50) == ["x" * 70 + ".", "Short. Other."]
    assert chunking.semantic_split("aaaa\n\nbbbb", 5, 8) == ["aaaa\n\nbbbb"] and chunking.semantic_split("aaaa\n\nbbbb", 1, 8, None) == ["aaaa", "bbbb"]
    assert chunking.semantic_split("一、甲\n十一、乙\n二、丙", 1, 4, None) == ["一、甲\n十一、乙", "二、丙"]


def test_hard_split():
    assert chunking.hard_split("  a. b  \n\nc", 10) == "a. b\n\nc"
    assert chunking.hard_split("aaaa,bbbb,cccccccc,dd", 10) == "aaaa,\nbbbb,\ncccccccc,dd"  # the rest fits into 1.3 times the limit
    assert chunking.hard_split("x" * 25, 10) == "x" * 10 + "\n" + "x" * 10 + "\n" + "x" * 5
    assert chunking.hard_split("y" * 12 + "." + "z" * 14, 10) == "y" * 12 + ".\n" + "z" * 10 + "\n" + "z" * 4


@pytest.mark.parametrize("most", [3, 10, 40])
@pytest.mark.parametrize("text", ["", ",,,,,", "ab, cd. ef" * 30, "一二三，四五。六" * 20, "x" * 100 + "," + "y" * 9])
def test_cuts_are_at_punctuation(text, most):
    ends = [i + 1 for i, c in enumerate(text) if c in chunking.PUNCTUATION]
    cuts = list(chunking.cut_places(ends, most))
    assert cuts == sorted(set(cuts)) and set(cuts) <= set(ends)
    # a piece is longer than the limit only if no punctuation is inside it
    assert all(b - a <= most or not [e for e in ends if a < e < b] or b - max(e for e in ends if a < e < b) >= most for a, b in zip([0, *cuts], cuts))
    assert "".join(chunking.split_line(text, most)).replace(" ", "") == text.replace(" ", "")


def test_packed():
    assert chunking.packed(["aa", "bb", "cccc", "d"], 5, "-") == ["aa-bb", "cccc", "d"]
    assert chunking.packed(["aaaaaaa", "b"], 3) == ["aaaaaaa", "b"] and chunking.packed([], 3) == []
    assert chunking.packed(["a", "b", "a"], 9, "", lambda held, p: p != "b") == ["a", "ba"]


def test_separators_come_first():
    text = "intro " * 10 + "\n\nclass A:\n" + "    pass\n" * 5 + "\n\ndef f():\n" + "    return 1\n" * 5
    assert [c.split("\n")[0][:7] for c in chunking._split_one(text, "code", Profile(80, 0))] == ["intro i", "class A", "def f()"]
    assert chunking.semantic_split(None, 1, 10) == []


def test_html_and_json_text():
    page = "<html><head><title>t</title></head><body><nav>skip</nav><h2>Head</h2><p>One <b>two</b></p><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><p>One <b>two</b></p><span>short</span><script>x</script></body></html>"
    assert files.html_text(page) == "## Head\n\nOne two\n\n- a\n- b\n\n1 | 2"
    assert files.json_text('{"a": 1, "b": {"c": [1, 2]}}') == "a: 1\nb:\n  c:\n    - 1\n    - 2"
    assert files.json_text('{"a": 1}\n\n{"a": 2}', True) == "[Record 1]\na: 1\n\n[Record 3]\na: 2"
    assert files.json_text('{"r": [{"x": 1}, {"x": 2}]}') == "r:\n  x: 1\n\n  x: 2"
    assert files.json_text('{"a": 1}\n{"a": 2}') == "[Record 1]\na: 1\n\n[Record 2]\na: 2" and files.json_text("plain\ntext") == "[Record 1]\nplain\n\n[Record 2]\ntext"
    assert files.decode("图书馆".encode("gbk")) == "图书馆" and files.decode(b"\xff\xfe\xfa") is not None


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n')
    (tmp_path / "c.bin").write_bytes(b"no")
    rows = {r["ext"]: r["text"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows == {"md": "# Title", "jsonl": "[Record 1]\nk: 1"}


def test_labelled_queries(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"kb_id": 1, "query": "a", "relevant_chunk_ids": ["c"]}\n{"kb_id": 1, "query": "b"}\n')
    rows = files.read_labelled_queries(spark, str(tmp_path / "q.jsonl")).orderBy("query").collect()
    assert rows[0]["relevant_chunk_ids"] == ["c"] and rows[1]["relevant_keywords"] == []


def test_ir_metrics(spark):
    hits = spark.createDataFrame([(1, i + 1, h) for i, h in enumerate([False, True, False, True, False])] + [(2, 1, False)], "query_id long, rank int, hit boolean")
    rel = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "query_id long, total int")
    rows = {r["query_id"]: (r["recall"], r["mrr"], round(r["ndcg"], 4)) for r in evaluate.ir_metrics(hits, rel, 5).collect()}
    assert rows == {1: (1.0, 0.5, 0.6509), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([("A", "c", True, float(x), 2, 1, 1) for x in (100, 200, 300, 400)], "mode string, category string, success boolean, elapsed_ms double, iterations int, steps int, quality int")
    assert evaluate.ab_summary(df).first()["p95_ms"] == 385.0


def test_entity_merge_golden(spark):
    schema = "kb_id int, seq long, canonical_name string, name string, type string, labels array<string>, aliases array<string>, confidence double, mention_count int, chunk_ids array<string>, attributes map<string,string>"
    rows = spark.createDataFrame([(1, 1, "n47", "N-47", "unknown", ["l"], ["n 47"], 0.9, 1, ["c1"], {"a": "1"}), (1, 2, "n47", "n47", "device", [], [], 0.8, 1, ["c2"], {"a": "2", "b": "3"})], schema)
    (e,) = graph.merge_entities(rows).collect()
    assert (e["name"], e["type"], e["confidence"], e["mention_count"], e["chunk_ids"], e["attributes"]) == ("N-47", "device", 0.9, 2, ["c1", "c2"], {"a": "1", "b": "3"})
    rel = spark.createDataFrame([(1, 1, "n 47", "x", "t", 0.5, 1, ["c1"])], "kb_id int, seq long, source string, target string, type string, confidence double, evidence_count int, chunk_ids array<string>")
    assert graph.merge_relations(rel, graph.merge_entities(rows)).count() == 0


def test_entity_merge_of_many_mentions(spark):
    """Lists are built of distinct values only; a plain merge gives the same."""
    one_of = lambda name: F.concat(F.lit(name), (F.col("id") % 7).cast("string"))
    attributes = F.map_from_arrays(F.array(F.lit("first"), one_of("k")), F.array(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "even")))
    rows = spark.range(3000).select(F.lit(1).alias("kb_id"), (F.col("id") * 7 % 3000).alias("seq"), F.when(F.col("id") > 9, "e").alias("canonical_name"), one_of("n").alias("name"), F.lit("t").alias("type"), F.array(one_of("l"), F.lit(None).cast("string")).alias("labels"), F.when(F.col("id") % 2 == 0, F.array(one_of("a"))).alias("aliases"), F.lit(0.5).alias("confidence"), F.lit(1).alias("mention_count"), F.array((F.col("id") % 50).cast("string")).alias("chunk_ids"), attributes.alias("attributes"))
    merged = graph.merge_entities(rows)
    given, got = rows.collect(), {r["canonical_name"]: r for r in merged.collect()}
    assert set(got) == {"e", None}
    for name, e in got.items():
        own = sorted((r for r in given if r["canonical_name"] == name), key=lambda r: r["seq"])
        first = {}
        for r in own:
            first = r["attributes"] | first
        distinct = lambda c: sorted({x for r in own for x in r[c] or () if x is not None})  # noqa: E731, B023
        assert (e["name"], e["mention_count"], e["attributes"]) == (own[0]["name"], len(own), first)
        assert (e["labels"], e["aliases"], e["chunk_ids"]) == ([*distinct("labels"), None], distinct("aliases"), distinct("chunk_ids"))
        assert e["n_chunks"] == len(e["chunk_ids"])
    lean = merged.select("name", "attributes", "n_chunks")._jdf.queryExecution().optimizedPlan().toString()
    assert lean.count("collect_list") == 1  # the attributes, each key once


def test_substring_fallback_scores_all_candidates(spark):
    texts = [(f"c{i:03}", "xabcdy " + "filler " * 100) for i in range(99)] + [("c999", "xabcdy")]
    chunks = spark.createDataFrame([("kb", c, t) for c, t in texts] + [("kb", "d", "other words")], "kb_id string, chunk_id string, content string")
    asked = spark.createDataFrame([(1, "kb", "abcd"), (2, "kb", "other")], "query_id long, kb_id string, query_text string")
    rows = keyword.search(asked, chunks, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in rows] == [(1, "c999", 1), (1, "c000", 2), (1, "c001", 3), (2, "d", 1)]
    assert rows[0]["score"] == 1.0 and rows[1]["score"] < 1.0


def test_paths_golden(spark):
    rel = spark.createDataFrame([(1, "a", "b", "r1", ["1"]), (1, "b", "c", "r2", ["2"]), (1, "a", "b", "r3", ["3"])], "kb_id int, source string, target string, type string, chunk_ids array<string>")
    starts = spark.createDataFrame([(1, 1, "a")], "query_id long, kb_id int, entity string")
    rows = {(r["target"], tuple(r["relations"]), r["hop"]) for r in graph.paths(starts, rel, limit=None).collect()}
    assert rows == {("b", ("r1",), 1), ("b", ("r3",), 1), ("c", ("r1", "r2"), 2), ("c", ("r3", "r2"), 2)}


def test_upsert_twice_is_once(spark):
    schema = "kb_id int, canonical_name string, name string, type string, labels array<string>, aliases array<string>, confidence double, mention_count long, chunk_ids array<string>"
    new = spark.createDataFrame([(1, "a", "A", "t", ["x"], ["al"], 0.5, 2, ["c1", "c2"])], schema)
    empty = graph.upsert_entities(new.limit(0).withColumns({"first_run_id": F.lit("r"), "last_run_id": F.lit("r")}), new, "r1")
    twice = graph.upsert_entities(empty, new, "r2").first()
    assert twice["mention_count"] == 2 and twice["first_run_id"] == "r1" and twice["last_run_id"] == "r2"


def test_parse_replies(spark):
    replies = [(1, '{"entities": [{"name": "a"}], "triples": []}'), (2, "```json\n{'nodes': [{'name': 'b'},], 'edges': [{'source': 'b', 'relation': 'r', 'target': 'c'}]}\n```"), (3, "nothing"), (4, None)]
    rows = {r["chunk_id"]: r for r in extraction.parse_replies(spark.createDataFrame(replies, "chunk_id long, reply string")).collect()}
    assert rows[1]["entities"][0]["name"] == "a" and not rows[1]["parse_failed"]
    assert rows[2]["entities"][0]["name"] == "b" and rows[2]["triples"][0]["tail"] == "c"
    assert rows[3]["parse_failed"] and rows[4]["parse_failed"] and rows[4]["entities"] == []


def test_mmr_and_diversity(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.89, [1.0, 0.0]), (1, "c", 0.5, [0.0, 1.0]), (1, "d", 0.4, None)], "query_id long, key string, similarity double, embedding array<double>")
    assert [r["key"] for r in ranking.mmr(rows, 3, 3).orderBy("rank").collect()] == ["a", "c", "b", "d"]
    same = spark.createDataFrame([(1, k, kb, "s", s) for k, kb, s in (("a", 1, 0.9), ("b", 2, 0.8), ("c", 1, 0.7))], "query_id long, key string, kb_id int, source string, score double")
    assert [r["key"] for r in ranking.diversify_sources(same).collect()] == ["a"]


def test_flat_scores_and_empty_query(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "query_id long, key string, final_score double")
    assert {r["normalized"] for r in ranking.min_max(rows).collect()} == {1.0}
    assert {r["weight"] for r in ranking.display_weights(rows.withColumnRenamed("final_score", "score")).collect()} == {0.5}


def test_vector_edges(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, vectors.clamped_dot(v(3, 0), v(1, 0))) == 1.0
    assert one(spark, vectors.clamped_dot(v(1), v(1, 0))) == 0.0
    assert [one(spark, vectors.distance_similarity(F.lit(d))) for d in (0.0, 1.0, 2.0)] == [1.0, 0.5, 0.0]


def test_lsh_recall(spark):
    from quarrymill.plans.queries_rank import knn_topk, lsh_knn

    exact = {(r["query_id"], r["chunk_id"]) for r in knn_topk(spark, "/root/testdata/sf0.001").collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in lsh_knn(spark, "/root/testdata/sf0.001").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_dataset_report(spark):
    rows = spark.createDataFrame([(i, "unknown" if i == 0 else "alpaca", ["x"] if i < 12 else []) for i in range(20)], "i long, format string, errors array<string>")
    r = datasets.report(rows, "i").first()
    assert not r["valid"] and r["failed"] == 12 and r["format"] == "unknown" and r["first_errors"].endswith("; ...")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "kb_id int, v string")
    run = sinks.commit_run(df, str(tmp_path / "runs"))
    sinks.commit_run(df, str(tmp_path / "runs"), "failed")
    ledger = spark.createDataFrame([(run, "success"), ("failed", "failed")], "run_id string, status string")
    assert sinks.read_runs(spark, str(tmp_path / "runs"), ledger).count() == 2
    sinks.replace_kbs(df, str(tmp_path / "kb"))
    sinks.replace_kbs(df.where("kb_id = 1").withColumn("v", F.lit("new")), str(tmp_path / "kb"))
    assert {r["v"] for r in spark.read.parquet(str(tmp_path / "kb")).collect()} == {"new", "b"}
    sinks.append_metrics(df, str(tmp_path / "m"))
    sinks.append_metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4


def test_sql_functions(spark):
    sql_functions.register(spark)
    assert spark.sql("SELECT clamped_dot(array(1D, 0D), array(0.5D, 1D)) AS x").first()["x"] == 0.5
    assert spark.sql("SELECT code_entities('N-47 x') AS x").first()["x"] == ["N-47"]
    assert spark.sql("SELECT count(*) AS n FROM VALUES ('some text') AS t(text), LATERAL chunk_text(text, 'text')").first()["n"] == 1


def test_codes_next_to_letters_of_other_scripts(spark):
    """Python's \\b, which the reference uses, and so do the expression and its SQL."""
    import re

    import duckdb

    from quarrymill.functions.text import code_entities
    from quarrymill.plans.queries_text import codes_sql

    texts = ["verhäheit 82, ab 12", "éab 12 x", "12abé 34cd", "ab é12 ab_é12 é_12", "甲N-47 N-47 乙 P_1127", "N\x0b-47", "a_12 ab__12 ²12ab", "ab１2 ab12", ""]
    wanted = [[m.strip(" ") for p in (r"\b[a-zA-Z]{1,4}\s*[-_/]?\s*[0-9]{2,10}[a-zA-Z]{0,2}\b", r"\b[0-9]{2,10}[a-zA-Z]{1,4}\b") for m in re.findall(p, t)] for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", code_entities(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [list(dict.fromkeys(w)) for w in wanted]
    con = duckdb.connect()
    assert [con.execute(f"SELECT {codes_sql('t')} FROM (SELECT ? AS t)", [t]).fetchone()[0] for t in texts] == wanted
    assert con.execute(f"SELECT {codes_sql('t')} FROM (SELECT NULL::VARCHAR AS t)").fetchone()[0] == []


def test_percentages_of_a_context(spark):
    """Two decimals as printf and Python give them: the number itself is rounded, and ties go to the even digit."""
    scores = [0.00125, 0.38885, 0.12125, 0.401251, 1.0, 0.0]
    rows = spark.createDataFrame([(i, 1, "x", s, [], []) for i, s in enumerate(scores)], "query_id long, rank int, content string, score double, channels array<string>, evidence array<string>")
    got = {r["query_id"]: r["context"] for r in ranking.context_text(rows).collect()}
    assert [got[i].split("\n")[0] for i in range(len(scores))] == [f"[文档1] (相似度: {s * 100:.2f}%)" for s in scores]


def test_texts_are_split_in_runs(spark):
    """A task hands on the chunks of about RUN_BYTES of text at a time, and loses no text, null or empty ones included."""
    texts = [("w" * 700 + ".\n\n") * 40, None, "", "one\n\ntwo"] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    split = lambda text: chunking.semantic_split(text, 200, 800)
    made = list(chunking._split_runs(iter([batch]), split))
    assert len(made) > 1 and all(b.column("content").nbytes <= chunking.RUN_BYTES + 40_000 for b in made)
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert rows == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(split(t))]
    docs = spark.createDataFrame([("a", None), ("b", "one\n\ntwo"), (None, "three")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["chunk_index"], r["content"]) for r in chunking.semantic_chunks(docs).collect()) == [("", 0, "three"), ("b", 0, "one\n\ntwo")]
