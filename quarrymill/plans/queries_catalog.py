"""Queries over the catalog and over event streams (their batch twins), with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import collection
from ..sources.scratch import fresh_folder
from ..streaming import jobs
from .inputs import corpus, table
from .registry import query

FILES_SQL = "files AS (SELECT doc_id AS file_id, source AS kb, 'doc' || doc_id || '.txt' AS filename, CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'completed' END AS status, 1 + n_chars // 750 AS chunk_count, n_chars FROM documents)"


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("kb_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.when(F.col("doc_id") % 10 == 0, "error").otherwise("completed").alias("status"), (1 + F.floor(F.col("n_chars") / 750)).cast("long").alias("chunk_count"), "n_chars")


def _kbs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id")).distinct().select("kb_id", F.col("kb_id").alias("name"), F.when(F.col("kb_id").endswith("3"), "model-b").otherwise("model-a").alias("embedding_model"))


@query(f"WITH {FILES_SQL} SELECT file_id, filename, n_chars FROM files WHERE status = 'completed' ORDER BY n_chars DESC, file_id LIMIT 20 OFFSET 40")
def paged_list(spark, sf_dir):
    return catalog.page(_files(spark, sf_dir), [F.desc("n_chars"), "file_id"], 20, 40, status="completed").select("file_id", "filename", "n_chars")


@query(f"WITH {FILES_SQL} SELECT file_id, filename FROM files WHERE file_id IN (SELECT doc_id FROM labels)")
def lookup_by_ids(spark, sf_dir):
    return catalog.by_ids(_files(spark, sf_dir), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id"), "file_id").select("file_id", "filename")


@query(f"WITH {FILES_SQL} SELECT file_id, filename FROM files WHERE file_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, sf_dir):
    return catalog.without_ids(_files(spark, sf_dir), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id"), "file_id").select("file_id", "filename")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE label::VARCHAR END AS label, CASE WHEN vec_id % 3 = 0 THEN '1' END AS version, 'k' || vec_id AS other FROM embeddings")
def update_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("other"), F.concat(F.lit("k"), F.col("vec_id").cast("string"))).alias("metadata"))
    new = e.where("chunk_id % 3 = 0").select("chunk_id", F.create_map(F.lit("label"), F.lit("new"), F.lit("version"), F.lit("1")).alias("metadata"))
    m = catalog.update_metadata(e, new)
    return m.select(F.col("chunk_id").alias("vec_id"), *[F.col("metadata")[k].alias(k) for k in ("label", "version", "other")])


@query("SELECT 'kb_' || (label % 3) AS collection, count(*) AS vectors FROM embeddings GROUP BY label % 3")
def collection_stats(spark, sf_dir):
    return catalog.collection_stats(table(spark, sf_dir, "embeddings").withColumn("kb_id", F.col("label") % 3))


@query(f"WITH {FILES_SQL} SELECT f.file_id, filename, v.vec_id, (v.vec_id % 10)::INTEGER AS chunk_index FROM embeddings v JOIN files f ON v.vec_id // 10 = f.file_id")
def chunk_listing(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("file_id"), "vec_id", (F.col("vec_id") % 10).cast("int").alias("chunk_index"))
    return catalog.chunk_listing(chunks, _files(spark, sf_dir)).select("file_id", "filename", "vec_id", "chunk_index")


@query(f"WITH {FILES_SQL}, k AS (SELECT DISTINCT kb FROM files UNION ALL SELECT 'empty') SELECT k.kb AS kb_id, count(file_id) FILTER (status = 'completed') AS file_count, coalesce(sum(chunk_count) FILTER (status = 'completed'), 0)::BIGINT AS chunk_count FROM k LEFT JOIN files f ON k.kb = f.kb GROUP BY k.kb")
def kb_stats(spark, sf_dir):
    kbs = _kbs(spark, sf_dir).select("kb_id").unionByName(spark.range(1).select(F.lit("empty").alias("kb_id")))
    return catalog.kb_stats(kbs, _files(spark, sf_dir))


@query("""WITH a AS (SELECT c_custkey AS assistant_id, c_nationkey || ', ' || (c_nationkey + 7) % 25 || ',x' AS kb_ids FROM customer), i AS (SELECT assistant_id, trim(p[i]) AS id, i FROM (SELECT assistant_id, string_split(kb_ids, ',') AS p, unnest([1, 2, 3]) AS i FROM a))
SELECT assistant_id, string_agg(n_name, ',' ORDER BY i) AS kb_names FROM i JOIN nation ON n_nationkey = TRY_CAST(id AS INTEGER) GROUP BY assistant_id""")
def assistant_kbs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("assistant_id"), F.concat(F.col("c_nationkey").cast("string"), F.lit(", "), ((F.col("c_nationkey") + 7) % 25).cast("string"), F.lit(",x")).alias("kb_ids"))
    return catalog.assistant_kbs(a, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("name")))


@query("""WITH w AS (SELECT c_custkey AS owner, c_nationkey AS kb_id FROM customer UNION ALL SELECT c_custkey, c_nationkey + c_custkey % 3 FROM customer)
SELECT owner, count(*) FILTER (n_regionkey IS NULL) AS unknown_kbs, count(DISTINCT n_regionkey) AS settings FROM w LEFT JOIN nation ON n_nationkey = kb_id GROUP BY owner HAVING count(*) FILTER (n_regionkey IS NULL) > 0 OR count(DISTINCT n_regionkey) <> 1""")
def embedding_consistency(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_custkey").alias("owner"), F.explode(F.array(F.col("c_nationkey").cast("long"), F.col("c_nationkey") + F.col("c_custkey") % 3)).alias("kb_id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("kb_id"), F.col("n_regionkey").cast("string").alias("model"))
    return catalog.embedding_violations(wanted, n, ["model"])


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)), x AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM gone))
SELECT 'orders' AS level, count(*) AS n FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM x)""")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    left = catalog.cascade(gone, "c_custkey", (table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n")
    return count(left[0], "orders").unionByName(count(left[1], "lineitem"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 4")
def last_n_messages(spark, sf_dir):
    return catalog.last_messages(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role", "place")


@query("SELECT conv_id, count(*) AS message_count, max(turn) AS last FROM conversations GROUP BY conv_id")
def message_counters(spark, sf_dir):
    return catalog.message_counters(table(spark, sf_dir, "conversations"))


@query("""SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'model-a' ELSE 'model-b' END AS model, 'assistant' AS used_by, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL
UNION ALL SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'model-a' ELSE 'model-b' END, 'kb', count(*) FROM supplier GROUP BY ALL""")
def model_usage(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "model-a").otherwise("model-b").alias("llm_model"), F.when(F.col("c_acctbal") > 0, "active").otherwise("off").alias("status"))
    k = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "model-a").otherwise("model-b").alias("embedding_model"))
    return catalog.model_usage(k, a)


@query("""SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2f B', s / 1) WHEN s < 1048576 THEN printf('%.2f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576) ELSE printf('%.2f GB', s / 1073741824) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 4 + 1) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS s FROM documents)""")
def readable_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = F.col("n_chars") * (F.col("doc_id") % 4 + 1) * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1024).otherwise(1048576)
    return d.select("doc_id", catalog.readable_size(s).alias("size"))


PATH_SQL = "'/data/../' || source || '//./~' || doc_id || '/' AS path, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'kb ' || doc_id WHEN 2 THEN '知识库_' || doc_id WHEN 3 THEN repeat('x', 95 + doc_id::INTEGER % 10) ELSE source || '-' || doc_id END AS name"


@query(rf"""SELECT doc_id, '/data/' || source || '/' || doc_id AS path, length(name) <= 100 AND regexp_matches(name, '^[\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9_-]+$') AS valid FROM (SELECT doc_id, source, {PATH_SQL} FROM documents)""")
def checked_names(spark, sf_dir):
    """Which names a knowledge base may have, and paths made safe."""
    d, id_ = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.concat(F.lit("kb "), id_)).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("知识库_"), id_)).when(F.col("doc_id") % 5 == 3, F.repeat(F.lit("x"), (95 + F.col("doc_id") % 10).cast("int"))).otherwise(F.concat("source", F.lit("-"), id_))
    path = F.concat(F.lit("/data/../"), "source", F.lit("//./~"), id_, F.lit("/"))
    return d.select("doc_id", catalog.clean_path(path).alias("path"), catalog.valid_kb_name(name).alias("valid"))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN file_id % 4 = 0 THEN 99 ELSE chunk_count END::BIGINT AS chunk_count, CASE WHEN file_id % 4 = 0 THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at, CASE WHEN file_id % 4 = 0 THEN TIMESTAMP '2024-05-01' END AS processed_at FROM files")
def apply_updates(spark, sf_dir):
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    files = _files(spark, sf_dir).select("file_id", "status", "chunk_count", ntz("2024-01-01").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    updates = files.where("file_id % 4 = 0").select("file_id", F.lit("completed").alias("status"), F.lit(99).cast("long").alias("chunk_count"))
    return catalog.apply_updates(files, updates, "file_id", ntz("2024-05-01"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return catalog.latest_state(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "ts", "event_type")


@query("SELECT doc_id FROM documents WHERE (source, md5(text)) NOT IN (SELECT source, md5(text) FROM documents WHERE doc_id % 2 = 0)")
def new_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), "doc_id", "text")
    stored = d.where("doc_id % 2 = 0").select("kb_id", F.md5(F.col("text").cast("binary")).alias("file_hash"), F.lit("completed").alias("status"), F.lit(1).alias("chunk_count"))
    return catalog.new_files(d, stored).select("doc_id")


_NAME_SQL = "CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id || '.txt' WHEN 1 THEN 'b?.md' WHEN 2 THEN 'con.json' WHEN 3 THEN 'x.exe' ELSE 'c.html' END"


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 3 THEN 'extension' END, CASE WHEN n_chars > 3000 THEN 'size' END, CASE WHEN doc_id % 5 = 1 THEN 'characters' END, CASE WHEN doc_id % 5 = 2 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS errors,
array_to_string(list_filter([CASE WHEN n_chars > 1000 THEN 'query' END, CASE WHEN doc_id % 30 NOT BETWEEN 1 AND 20 THEN 'top_k' END, CASE WHEN doc_id % 3 = 2 THEN 'threshold' END], lambda x: x IS NOT NULL), ',') AS request_errors FROM documents""")
def ingest_validation(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".txt"))).when(k == 1, "b?.md").when(k == 2, "con.json").when(k == 3, "x.exe").otherwise("c.html")
    return d.select("doc_id", F.array_join(catalog.file_errors(name, F.col("n_chars"), 3000), ",").alias("errors"), F.array_join(catalog.request_errors(F.col("text"), F.col("doc_id") % 30, (F.col("doc_id") % 3).cast("double") * 0.6), ",").alias("request_errors"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT kb, count(*) FILTER (status = 'completed') AS f, sum(chunk_count) FILTER (status = 'completed')::BIGINT AS c FROM files GROUP BY kb)
SELECT kb AS kb_id, '{{"kb_id":"' || kb || '","name":"' || kb || '","embedding_model":"' || CASE WHEN kb LIKE '%3' THEN 'model-b' ELSE 'model-a' END || '","total_files":' || f || ',"total_chunks":' || coalesce(c, 0) || '}}' AS info FROM s""")
def kb_snapshot(spark, sf_dir):
    return catalog.kb_snapshot(_kbs(spark, sf_dir), _files(spark, sf_dir))


# --- streams: the same builders over the whole table as one batch ---------------------------------------------------


def _feed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_type").alias("scope"), F.col("value").alias("elapsed"), "user_id", "event_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS scope, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def windowed_monitoring(spark, sf_dir):
    return jobs.windowed_figures(_feed(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    out = jobs.sessions(_feed(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT user_id AS job_id, max(ts) AS ts, arg_max(event_type, ts) AS stage, arg_max(value, ts) AS percent FROM events GROUP BY user_id")
def latest_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return jobs.latest_progress(e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("stage"), F.col("value").alias("percent")))


@query("""SELECT conv_id AS msg_id, string_agg(text, '' ORDER BY turn) AS content FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn < last OR last % 2 = 0 GROUP BY conv_id HAVING any_value(last) % 2 = 1""")
def chunk_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    parts = c.join(last, "conv_id").select(F.col("conv_id").alias("msg_id"), F.col("turn").alias("seq"), F.when((F.col("turn") == F.col("last")) & (F.col("last") % 2 == 1), "done").otherwise("text").alias("type"), F.col("text").alias("data"))
    return jobs.assembled(parts)


# one run of even vectors, added twice, one of odd ones, and one that is taken back
@query("SELECT (label % 3)::INTEGER AS kb_id, count(*) AS chunks, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY label % 3")
def committed_runs(spark, sf_dir):
    path, rows = fresh_folder(spark, "collection"), corpus(spark, sf_dir).select("kb_id", "chunk_id", "vec_id", "embedding")
    for run, half in (("even", 0), ("even", 0), ("odd", 1), ("gone", 1)):
        collection.add_run(rows.where(F.col("vec_id") % 2 == half), path, run)
    collection.remove_run(spark, path, "gone")
    return collection.read_collection(spark, path, "kb_id int, vec_id long").groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("vec_id").alias("ids"))
