"""Queries over streams and calendars, with their SQL counterparts: a stream's result must be that of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, chunking, extraction, graph
from ..operators.vectors import hashed_encoder
from ..sources.scratch import fresh_folder
from ..streaming import jobs, store
from .inputs import table
from .queries_text import WINDOWS_SQL, codes_sql
from .registry import query

MICRO_BATCHES, DIMENSION = 3, 64


def codes_and_neighbours(chunks):
    """Codes as entities, and codes near each other as relations: an extractor for ingest."""
    entities = graph.clean_entities(extraction.rule_entities(chunks))
    return entities, graph.clean_triples(extraction.cooccurrences(entities), entities)


def windows_of_files(docs):
    return chunking.fixed_chunks(docs, 750, 120).select("doc_id", "chunk_index", "content")


def filled_store(spark, sf_dir):
    """All documents put through the ingest stream in three micro-batches, the second of which comes twice, as after a failure of the
    driver between the commit and Spark's own record of it."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("kb_id"), F.col("doc_id").cast("string").alias("file_id"), "text", F.lit("text").alias("doc_type"))
    inbox, n = fresh_folder(spark, "inbox"), MICRO_BATCHES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // MICRO_BATCHES)
    files.repartition(n).write.parquet(inbox)
    kept = store.Store(fresh_folder(spark, "store"))
    commit = store.ingest_batch(kept, windows_of_files, hashed_encoder(DIMENSION), codes_and_neighbours)

    def delivered(batch, batch_id):
        commit(batch, batch_id)
        if batch_id == 1:
            commit(batch, batch_id)

    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", -(-n // MICRO_BATCHES)).parquet(inbox)
    run = stream.writeStream.foreachBatch(delivered).option("checkpointLocation", fresh_folder(spark, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return kept


STORE_SQL = f"""{WINDOWS_SQL.format(size=750, step=630, where='')},
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i, content, sha1(trim(content)) AS fingerprint FROM w WHERE trim(content) <> ''),
tx AS (SELECT fingerprint, max(content) AS content FROM ch GROUP BY fingerprint),
found AS (SELECT fingerprint, {codes_sql('content')} AS l FROM tx),
spread AS (SELECT fingerprint, trim(l[i]) AS name, i FROM (SELECT fingerprint, l, unnest(range(1, len(l) + 1)) AS i FROM found)),
places AS (SELECT fingerprint, name, row_number() OVER (PARTITION BY fingerprint ORDER BY min(i)) - 1 AS seq FROM spread GROUP BY fingerprint, name),
codes AS (SELECT fingerprint, trim(regexp_replace(name, '[\\t-\\r ]+', ' ', 'g')) AS name, min(seq) AS seq FROM places GROUP BY ALL HAVING length(trim(regexp_replace(name, '[\\t-\\r ]+', ' ', 'g'))) >= 2),
near AS (SELECT a.fingerprint FROM codes a JOIN codes b ON a.fingerprint = b.fingerprint AND b.seq > a.seq AND b.seq - a.seq <= 3 AND a.name <> b.name),
m AS (SELECT fingerprint, count(*) AS n FROM codes GROUP BY fingerprint), r AS (SELECT fingerprint, count(*) AS n FROM near GROUP BY fingerprint)"""


@query(f"""WITH {STORE_SQL} SELECT d.source AS kb_id, 'file_' || ch.doc_id || '_chunk_' || i AS chunk_id, ch.fingerprint, {DIMENSION} AS dimension, coalesce(m.n, 0) AS mentions, coalesce(r.n, 0) AS relations
FROM ch JOIN documents d ON d.doc_id = ch.doc_id LEFT JOIN m ON m.fingerprint = ch.fingerprint LEFT JOIN r ON r.fingerprint = ch.fingerprint""")
def ingest_stream(spark, sf_dir):
    """What the store holds of each chunk after the stream."""
    kept = filled_store(spark, sf_dir)
    counted = lambda name: store.of_chunks(spark, kept, name).groupBy("kb_id", "chunk_id").agg(F.count(F.lit(1)).alias(name))
    vectors = store.of_chunks(spark, kept, "vectors").select("kb_id", "chunk_id", "fingerprint", F.size("embedding").alias("dimension"))
    out = vectors.join(counted("mentions"), ["kb_id", "chunk_id"], "left").join(counted("relations"), ["kb_id", "chunk_id"], "left")
    return out.select("kb_id", "chunk_id", "fingerprint", "dimension", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mentions", "relations")])


@query(f"""WITH {WINDOWS_SQL.format(size=750, step=630, where='')}, n AS (SELECT doc_id, count(*) AS n, count(DISTINCT sha1(trim(content))) AS texts FROM w WHERE trim(content) <> '' GROUP BY doc_id)
SELECT source AS kb_id, count(*) AS files, count(*) FILTER (n.n IS NULL) AS failed, coalesce(sum(n.n), 0)::BIGINT AS chunks FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY source""")
def ingest_states(spark, sf_dir):
    """File states by knowledge base after the stream."""
    files = store.current_files(spark, filled_store(spark, sf_dir))
    return files.groupBy("kb_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "error").alias("failed"), F.sum("chunk_count").alias("chunks"))


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 4 HOURS THEN 1 ELSE 0 END AS idle FROM events),
p AS (SELECT *, sum(idle) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM g), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS place FROM p)
SELECT user_id AS session, ts, event_id AS seq, string_agg(event_type, chr(10)) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS history, least(6, place)::INTEGER AS n FROM f""")
def session_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return jobs.session_history(e).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH RECURSIVE l AS (SELECT event_type || user_id AS key, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
kept AS (SELECT key, min(ts) AS ts FROM l GROUP BY key UNION ALL SELECT k.key, (SELECT min(x.ts) FROM l x WHERE x.key = k.key AND x.ts > k.ts + INTERVAL 24 HOURS) FROM kept k WHERE k.ts IS NOT NULL)
SELECT key, ts, event_id FROM kept JOIN l USING (key, ts)""")
def ttl_dedup(spark, sf_dir):
    """Events that a cache of one day, keyed by type and user, doesn't serve."""
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), "ts", "event_id")
    return jobs.first_within(e, "key", 24, tie="event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT date_trunc('month', ts)::TIMESTAMP AS month, event_type AS scope, count(*) AS n, round(avg(value), 4) AS mean, TRUE AS p50_near, TRUE AS p95_near FROM events GROUP BY ALL""")
def quantile_rollup(spark, sf_dir):
    """Sketches by day, stored, and rolled up to months; near means that the exact rank is off by less than one percent."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("scope"), F.col("value").alias("elapsed"))
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz").alias("month")
    path = fresh_folder(spark, "sketches")
    jobs.windowed_sketches(e).write.parquet(path)
    figures = jobs.rolled_up(spark.read.parquet(path), month(F.col("start")), "scope")
    held = e.select(month(F.col("ts")), "scope", "elapsed").join(figures, ["month", "scope"])
    share = lambda test: F.count_if(test) / F.count("elapsed")
    near = lambda c, q: (share(F.col("elapsed") < F.col(c)) <= q + 0.01) & (share(F.col("elapsed") <= F.col(c)) >= q - 0.01)
    return held.groupBy("month", "scope", "n", "mean").agg(near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"))


@query("""WITH now AS (SELECT max(ts) + INTERVAL 1 MONTH AS now FROM events), d AS (SELECT unnest(generate_series(date_trunc('month', now) - INTERVAL 1 MONTH, date_trunc('month', now) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM now)
SELECT day::DATE::VARCHAR AS day, isodow(day)::INTEGER AS weekday, isodow(day) < 6 AS working, count(event_id) AS events FROM d LEFT JOIN events ON ts >= day AND ts < day + INTERVAL 1 DAY GROUP BY day""")
def calendar_events(spark, sf_dir):
    """Events on each day of the last month, a month after the newest event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    days = calendar.days_of_last_month(e.agg((F.max("ts") + F.expr("INTERVAL 1 MONTH")).alias("now")))
    counts = calendar.range_join(e, days, "ts", "start", "end").groupBy("day").agg(F.count(F.lit(1)).alias("events"))
    return days.select("day", "weekday", "working").join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.col("weekday").cast("int").alias("weekday"), "working", F.coalesce("events", F.lit(0)).alias("events"))


@query("""WITH n AS (SELECT user_id, max(ts) AS now, date_trunc('month', max(ts)) - INTERVAL 1 MONTH AS first, date_trunc('month', max(ts)) - INTERVAL 1 DAY AS last FROM events GROUP BY user_id)
SELECT user_id, strftime(now, '%Y-%m-%d %H:%M:%S') AS current_datetime, year(now)::INTEGER AS current_year, month(now)::INTEGER AS current_month, year(first)::INTEGER AS last_year, month(first)::INTEGER AS last_month,
day(last)::INTEGER AS days_in_last_month, len(list_filter(generate_series(first, last, INTERVAL 1 DAY), lambda d: isodow(d) < 6))::INTEGER AS weekdays_in_last_month FROM n""")
def calendar_context(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("now"))
    return newest.select("user_id", calendar.context(F.col("now")).alias("c")).select("user_id", "c.*")
