"""Streams that really run: replays, failures, restarts over one checkpoint, expiry of state, and their batch twins."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import calendar, chunking
from quarrymill.operators.vectors import hashed_encoder
from quarrymill.plans.queries_stream import codes_and_neighbours
from quarrymill.streaming import jobs, store

EVENTS = "/root/testdata/sf0.001/events.parquet"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, checkpoint):
    """The rows that one run adds, from where the checkpoint stands."""
    got = []
    q = stream.writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return [tuple(r) for r in got]


# --- the store ------------------------------------------------------------------------------------------------------


def windows(docs):
    return chunking.fixed_chunks(docs, 40, 10).select("doc_id", "chunk_index", "content")


def files_left(path: Path) -> set[str]:
    return {p.name for p in path.glob("*/attempt=*")}


FILES = "kb_id string, file_id string, text string, doc_type string"


def test_store_commits_whole_batches_once(spark, tmp_path):
    kept = store.Store(str(tmp_path / "store"), 4)
    commit = store.ingest_batch(kept, windows, hashed_encoder(8), codes_and_neighbours)
    first = spark.createDataFrame([("a", "1", "pump N-47 and valve P_1127 of the line, " * 3, "text"), ("a", "2", None, "text"), ("b", "1", "plain words", "text")], FILES)
    commit(first, 0)
    assert store.current_chunks(spark, kept).count() == kept.rows(spark, "chunks").count() > 3
    before = {name: kept.rows(spark, name).count() for name in store.SCHEMAS}
    commit(first, 0)  # the same batch again: nothing
    assert {name: kept.rows(spark, name).count() for name in store.SCHEMAS} == before and len(files_left(tmp_path / "store")) == 1
    assert {(r["file_id"], r["kb_id"]): r["status"] for r in store.current_files(spark, kept).collect()} == {("1", "a"): "completed", ("2", "a"): "error", ("1", "b"): "completed"}
    # the same file under another batch number: its texts are known, nothing is encoded
    commit(first.where("file_id = '1'"), 1)
    line = kept.ledger(spark).where("batch_id = 1").first()
    assert line["encoded"] == 0 and line["changed"] == 0 and line["files"] == 2
    assert store.current_chunks(spark, kept).count() == before["chunks"]
    # a shorter version of a file replaces it; its old chunks aren't current any more
    commit(spark.createDataFrame([("a", "1", "now short X-99", "text")], FILES), 2)
    now = store.current_chunks(spark, kept).where("kb_id = 'a' and file_id = '1'").collect()
    assert [r["content"] for r in now] == ["now short X-99"]
    assert {r["name"] for r in store.of_chunks(spark, kept, "mentions").where("kb_id = 'a'").collect()} == {"X-99"}
    assert store.of_chunks(spark, kept, "vectors").count() == store.current_chunks(spark, kept).count()


def test_store_after_failures(spark, tmp_path):
    kept = store.Store(str(tmp_path / "store"), 4)
    docs = spark.createDataFrame([("a", str(i), f"text number {i} about M-{i:03d}", "text") for i in range(20)], FILES)

    def broken(batches):
        for n, batch in enumerate(hashed_encoder(8)(batches)):
            yield batch
            raise RuntimeError("the encoder stops half-way")

    with pytest.raises(Exception, match="half-way"):
        store.ingest_batch(kept, windows, broken, codes_and_neighbours)(docs, 0)
    assert all(kept.rows(spark, name).count() == 0 for name in store.SCHEMAS)
    assert not files_left(tmp_path / "store")  # the failed attempt took its files away
    # a driver that died leaves files without a line in the ledger: not readable, and swept by the next batch
    kept._write(spark.createDataFrame([("f", [1.0])], "fingerprint string, embedding array<float>"), "vectors", "dead")
    assert kept.rows(spark, "vectors").count() == 0 and files_left(tmp_path / "store") == {"attempt=dead"}
    store.ingest_batch(kept, windows, hashed_encoder(8), codes_and_neighbours)(docs, 0)
    assert "attempt=dead" not in files_left(tmp_path / "store") and kept.rows(spark, "vectors").count() == 20


def test_store_reads_only_its_own_buckets(spark, tmp_path, capsys):
    kept = store.Store(str(tmp_path / "store"), 8)
    docs = spark.createDataFrame([("a", str(i), f"text number {i}", "text") for i in range(64)], FILES)
    store.ingest_batch(kept, windows, hashed_encoder(8), codes_and_neighbours)(docs, 0)
    one = kept.rows(spark, "vectors", [3])
    one.explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert 0 < one.count() < 64 and any(re.search(r"bucket#\d+ = 3", f) for f in filters)


def test_store_of_a_stream_with_a_restart(spark, tmp_path):
    kept = store.Store(str(tmp_path / "store"), 4)
    for part in range(2):
        spark.createDataFrame([("a", f"{part}-{i}", f"text {i} of part {part}", "text") for i in range(5)], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
        q = store.ingest_stream(stream, kept, str(tmp_path / "cp"), windows, hashed_encoder(8), codes_and_neighbours).trigger(availableNow=True).start()
        q.awaitTermination(180)
    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    last.unlink()  # as if the driver had died after the commit of the store: Spark delivers the batch again
    for crc in (tmp_path / "cp" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    store.ingest_stream(stream, kept, str(tmp_path / "cp"), windows, hashed_encoder(8), codes_and_neighbours).trigger(availableNow=True).start().awaitTermination(180)
    assert store.current_chunks(spark, kept).count() == kept.rows(spark, "chunks").count() == 10
    assert kept.ledger(spark).count() == 2


# --- sessions and de-duplication ------------------------------------------------------------------------------------


def messages(rng, sessions, first_day, n):
    rows = [(s, START + timedelta(days=first_day, minutes=rng.randrange(60 * 24)), i, rng.choice(["a", "b", "", None])) for i, s in enumerate(rng.choices(sessions, k=n))]
    return [(s, ts, 1000 * first_day + i, text) for s, ts, i, text in rows]


def state_keys(spark, checkpoint, variable):
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select("key").distinct().collect()
    return {r["key"][0] for r in rows}


def test_session_history_over_restarts(rocks, tmp_path):
    schema = "session long, ts timestamp, seq long, text string"
    rng = random.Random(1)
    days = [messages(rng, [1, 2, 3], 0, 40), messages(rng, [1, 2], 1, 40), messages(rng, [2, 4], 3, 20)]  # 3 is idle from the second day on, 1 from the third
    got = []
    for rows in days:
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got += run(jobs.session_history(stream), str(tmp_path / "cp"))  # each run goes on from the checkpoint
    batch = jobs.session_history(rocks.createDataFrame([r for d in days for r in d], schema))
    assert sorted(got) == sorted(tuple(r) for r in batch.collect()) and len(got) == 100
    assert max(r[4] for r in got) == 6 and min(r[4] for r in got) == 1
    assert state_keys(rocks, str(tmp_path / "cp"), "kept") <= {2, 4}


def plain_first_within(rows, ttl):
    kept, out = {}, []
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in kept or ts - kept[key] > ttl:
            kept[key] = ts
            out.append((key, ts, i))
    return sorted(out)


def test_first_within_in_a_batch(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), START + timedelta(minutes=rng.randrange(60 * 24 * 9)), i) for i in range(400)]
    rows += [("d", START, 1000), ("d", START, 999), ("d", START + timedelta(hours=24), 1001), ("d", START + timedelta(hours=24, milliseconds=1), 1002)]
    df = spark.createDataFrame([*rows, (None, START, 1), ("a", None, 2)], "key string, ts timestamp, id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a key's rows span batches
    got = sorted(tuple(r) for r in jobs.first_within(df, "key", 24, tie="id").collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_first_within(rows, timedelta(hours=24))
    assert jobs.first_within(df.limit(0), "key", 24, tie="id").collect() == []


def test_first_within_over_restarts(rocks, tmp_path):
    schema = "key string, ts timestamp, id long"
    rng = random.Random(3)
    day = lambda d, keys, n: [(rng.choice(keys), START + timedelta(days=d, minutes=rng.randrange(60 * 24)), 1000 * d + i) for i in range(n)]
    parts = [day(0, "abc", 30), day(1, "ab", 30), day(4, "bd", 30), [("a", START, 99999)]]  # the last row is later than the watermark
    got = []
    for rows in parts:
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got += run(jobs.first_within(stream, "key", 36, tie="id"), str(tmp_path / "cp"))
    assert sorted(got) == plain_first_within([r for p in parts[:3] for r in p], timedelta(hours=36))
    assert state_keys(rocks, str(tmp_path / "cp"), "kept") <= {"b", "d"}


# --- figures --------------------------------------------------------------------------------------------------------


def feed(spark):
    return spark.read.parquet(EVENTS).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("scope"), F.col("value").alias("elapsed"))


def test_windows_of_a_stream(spark, tmp_path):
    """Windows that the watermark has closed have the batch's counts and means, and percentiles near the exact ones."""
    events = feed(spark)
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run(jobs.windowed_figures(stream, "7 days"), str(tmp_path / "cp"))
    wanted = {(r["start"], r["scope"]): r for r in jobs.windowed_figures(events, "7 days").collect()}
    values = {}
    for r in events.collect():
        values.setdefault(r["scope"], []).append((r["ts"], r["elapsed"]))
    assert got
    for start, scope, n, mean, p95 in got:
        assert (n, mean) == (wanted[start, scope]["n"], wanted[start, scope]["mean"])
        own = np.array([v for ts, v in values[scope] if start <= ts < start + timedelta(days=7)])
        assert (own < p95).mean() <= 0.96 and (own <= p95 + 1e-6).mean() >= 0.94


def test_sketches_stay_small_and_add_up(spark):
    rng = np.random.default_rng(0)
    sizes = {}
    for n in (20_000, 400_000):
        values = rng.exponential(size=n)
        batch = pa.table({"elapsed": values, "part": rng.integers(0, 5, n)})
        df = spark.createDataFrame(batch.to_pandas()).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(part)) as ts", "'s' as scope", "elapsed")
        sketches = jobs.windowed_sketches(df)
        sizes[n] = max(len(r["sketch"]) for r in sketches.collect())
        r = jobs.rolled_up(sketches, "scope", quantiles=(0.05, 0.5, 0.95)).first()
        assert r["n"] == n and r["mean"] == pytest.approx(values.mean(), abs=1e-3)
        for q in (0.05, 0.5, 0.95):
            assert abs((values <= r[f"p{round(100 * q)}"]).mean() - q) < 0.01
    assert sizes[400_000] < 1.3 * sizes[20_000]
    empty = spark.createDataFrame([(START, "s", None)], "ts timestamp, scope string, elapsed double")
    assert tuple(jobs.rolled_up(jobs.windowed_sketches(empty), "scope").first()) == ("s", 1, None, None, None)


# --- calendar -------------------------------------------------------------------------------------------------------


def test_calendar_context(spark):
    got = {str(r["now"]): r["c"] for r in spark.sql("SELECT * FROM VALUES (timestamp_ntz'2026-03-31 23:59:59'), (timestamp_ntz'2024-03-01'), (timestamp_ntz'2025-01-15') AS t(now)").withColumn("c", calendar.context(F.col("now"))).collect()}
    assert [tuple(c)[1:] for c in got.values()] == [(2026, 3, 2026, 2, 28, 20), (2024, 3, 2024, 2, 29, 21), (2025, 1, 2024, 12, 31, 22)]
    assert got["2026-03-31 23:59:59"]["current_datetime"] == "2026-03-31 23:59:59"


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(5)
    at = lambda: START + timedelta(seconds=rng.randrange(500))
    points = [(i, at(), rng.choice("ab")) for i in range(150)] + [(999, None, "a")]
    spans = [(j, a, a + timedelta(seconds=rng.randrange(-5, 90)), rng.choice("ab")) for j in range(60) for a in [at()]]
    p, s = spark.createDataFrame(points, "p long, ts timestamp, k string"), spark.createDataFrame(spans, "s long, a timestamp, b timestamp, k string")
    wanted = sorted((i, j) for i, ts, k in points for j, a, b, x in spans if ts is not None and a <= ts < b and k == x)
    for seconds in (1, 7, 1000):
        got = calendar.range_join(p, s, "ts", "a", "b", seconds, ("k",))
        assert sorted((r["p"], r["s"]) for r in got.collect()) == wanted
    assert sorted(r["p"] for r in calendar.range_join(p, s, "ts", "a", "b", 10, ("k",), "left_semi").collect()) == sorted({i for i, _ in wanted})
