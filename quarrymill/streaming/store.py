"""A knowledge base as tables that a stream of files fills: chunks, vectors, mentions, relations, file states, and a ledger.

A micro-batch writes its rows of all tables under the id of an attempt, and then one line of the ledger, which is what makes them
visible: readers see all tables of a batch or none. A batch whose number the ledger has is left alone, so a replay adds nothing; the
folders of an attempt that failed are deleted, and those of a driver that died are swept by the next batch.

Tables lie in folders attempt=.../bucket=...: the bucket is a hash of the chunk's id (chunks, files) or of the text's fingerprint
(vectors, mentions, relations), and a batch reads only the buckets that its own ids and fingerprints fall into. A text that
is stored already is neither encoded nor extracted again, whatever chunk holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators import graph
from ..sources.scratch import removed, subfolders

_WHERE = "attempt string, bucket int"
SCHEMAS = {
    "files": "kb_id string, file_id string, version string, status string, chunk_count int, batch_id long",
    "chunks": "kb_id string, file_id string, chunk_id string, chunk_index int, content string, fingerprint string, batch_id long",
    "vectors": "fingerprint string, embedding array<float>",
    "mentions": "fingerprint string, seq int, name string, type string, confidence double",
    "relations": "fingerprint string, seq int, head string, relation string, tail string, confidence double",
}
#: What a table's bucket is a hash of.
BUCKETED = {"files": "file_id", "chunks": "chunk_id", "vectors": "fingerprint", "mentions": "fingerprint", "relations": "fingerprint"}
LEDGER = "batch_id long, attempt string, files long, failed long, chunks long, changed long, texts long, encoded long"

Chunker = Callable[[DataFrame], DataFrame]
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Store:
    """Tables under path; the number of buckets stays as it was at the first batch."""

    path: str
    buckets: int = 16

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One line for each batch that was committed; of a number that came twice, the first attempt."""
        if not subfolders(spark, f"{self.path}/ledger"):
            return spark.createDataFrame([], LEDGER)
        return spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/*")

    def rows(self, spark: SparkSession, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The committed rows of a table, of some buckets only: both limit the folders that are read."""
        schema = f"{SCHEMAS[name]}, {_WHERE}"
        if not subfolders(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], schema).drop("attempt", "bucket")
        found = spark.read.schema(schema).parquet(f"{self.path}/{name}")
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        return found.join(self.ledger(spark).select("attempt"), "attempt", "left_semi").drop("attempt", "bucket")

    def _write(self, df: DataFrame, name: str, attempt: str) -> None:
        """A table's rows of an attempt, one file a bucket."""
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        out = df.select(*columns).withColumn("bucket", self.bucket(BUCKETED[name]))
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/attempt={attempt}")

    def _own(self, spark: SparkSession, name: str, attempt: str) -> DataFrame:
        return spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(f"{self.path}/{name}/attempt={attempt}")

    def drop_attempt(self, spark: SparkSession, attempt: str) -> None:
        for name in SCHEMAS:
            removed(spark, f"{self.path}/{name}/attempt={attempt}")

    def sweep(self, spark: SparkSession) -> int:
        """Deletes what attempts without a line in the ledger have left; only one stream may write to a store."""
        found = {folder.removeprefix("attempt=") for name in SCHEMAS for folder in subfolders(spark, f"{self.path}/{name}")}
        done = {r["attempt"] for r in self.ledger(spark).select("attempt").collect()} if found else set()
        for attempt in found - done:
            self.drop_attempt(spark, attempt)
        return len(found - done)


def _used(df: DataFrame) -> list[int]:
    """The buckets that occur: at most as many as there are."""
    return sorted(r["bucket"] for r in df.select("bucket").distinct().collect())


def ingest_batch(store: Store, chunker: Chunker, encoder: Callable, extractor: Extractor) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls with files(kb_id, file_id, text, doc_type).

    chunker: docs(doc_id, text, doc_type) -> doc_id, chunk_index, content; encoder: batches of (key, text) -> (key, embedding);
    extractor: chunks(chunk_id, content) -> entities(chunk_id, seq, name, type, confidence), triples(chunk_id, seq, head, relation,
    tail, confidence), both clean. Of files with one id in a batch the one with the greatest digest counts. A file that
    gives no chunk is stored as failed.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not store.ledger(spark).where(F.col("batch_id") == batch_id).isEmpty():
            return
        store.sweep(spark)
        attempt = uuid.uuid4().hex
        try:
            _stage(spark, batch, batch_id, attempt)
        except BaseException:
            store.drop_attempt(spark, attempt)
            raise

    def _stage(spark: SparkSession, batch: DataFrame, batch_id: int, attempt: str) -> None:
        version = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
        one = F.row_number().over(Window.partitionBy("kb_id", "file_id").orderBy(F.desc("version")))
        files = batch.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("file_id").cast("string").alias("file_id"), "text", "doc_type", version.alias("version"))
        files = files.withColumn("_one", one).where("_one = 1").drop("_one")
        name = F.to_json(F.struct("kb_id", "file_id"))
        pieces = chunker(files.select(name.alias("doc_id"), "text", "doc_type")).select(F.from_json("doc_id", "kb_id string, file_id string").alias("of"), F.col("chunk_index").cast("int").alias("chunk_index"), "content")
        chunk_id = F.concat(F.lit("file_"), F.col("of.file_id"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
        pieces = pieces.select("of.kb_id", "of.file_id", chunk_id.alias("chunk_id"), "chunk_index", "content", fingerprint(F.col("content")).alias("fingerprint"), F.lit(batch_id).cast("long").alias("batch_id"))
        store._write(pieces, "chunks", attempt)  # all of them; those that are stored as they are go when the table is read
        own = store._own(spark, "chunks", attempt)
        counts = own.groupBy("kb_id", "file_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        state = files.select("kb_id", "file_id", "version").join(counts, ["kb_id", "file_id"], "left")
        state = state.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "status": F.when(F.col("chunk_count").isNull(), "error").otherwise("completed"), "batch_id": F.lit(batch_id).cast("long")})
        store._write(state, "files", attempt)
        stored = store.rows(spark, "chunks", _used(own)).groupBy("kb_id", "chunk_id").agg(F.max_by("fingerprint", "batch_id").alias("fingerprint"))
        changed = graph.changed_chunks(own.drop("fingerprint"), stored).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("texts"))
        texts = own.groupBy("fingerprint").agg(F.max("content").alias("content"))
        homes = _used(texts.select(store.bucket("fingerprint").alias("bucket")))
        fresh = texts.join(store.rows(spark, "vectors", homes).select("fingerprint"), "fingerprint", "left_anti")
        vectors = fresh.select(F.col("fingerprint").alias("key"), F.col("content").alias("text")).mapInArrow(encoder, "key string, embedding array<float>")
        store._write(vectors.withColumnRenamed("key", "fingerprint"), "vectors", attempt)
        # the texts that were new to the vectors are new to the graph as well
        news = texts.join(store._own(spark, "vectors", attempt).select("fingerprint"), "fingerprint", "left_semi").select(F.col("fingerprint").alias("chunk_id"), "content")
        entities, triples = extractor(news)
        store._write(entities.withColumnRenamed("chunk_id", "fingerprint"), "mentions", attempt)
        store._write(triples.withColumnRenamed("chunk_id", "fingerprint"), "relations", attempt)
        told = store._own(spark, "files", attempt).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "error").alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks")).first()
        seen, encoded = changed.first(), store._own(spark, "vectors", attempt).count()
        line = (batch_id, attempt, told["files"], told["failed"], told["chunks"], seen["n"], seen["texts"], encoded)
        spark.createDataFrame([line], LEDGER).coalesce(1).write.parquet(f"{store.path}/ledger/{batch_id:012d}")  # the commit: fails if it is there

    return commit


def ingest_stream(files: DataFrame, store: Store, checkpoint: str, chunker: Chunker, encoder: Callable, extractor: Extractor):
    """files(kb_id, file_id, text, doc_type), streaming -> a writer that fills the store; start it with a trigger."""
    return files.writeStream.foreachBatch(ingest_batch(store, chunker, encoder, extractor)).option("checkpointLocation", checkpoint)


def current_files(spark: SparkSession, store: Store) -> DataFrame:
    """The newest state of each file."""
    newest = F.max_by(F.struct("version", "status", "chunk_count", "batch_id"), "batch_id")
    return store.rows(spark, "files").groupBy("kb_id", "file_id").agg(newest.alias("f")).select("kb_id", "file_id", "f.*")


def current_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """The chunks of the newest version of each file."""
    newest = current_files(spark, store).select("kb_id", "file_id", "batch_id")
    return store.rows(spark, "chunks").join(newest, ["kb_id", "file_id", "batch_id"], "left_semi").drop("batch_id")


def of_chunks(spark: SparkSession, store: Store, name: str) -> DataFrame:
    """Vectors, mentions or relations with the ids of all the chunks that hold their text."""
    return current_chunks(spark, store).select("kb_id", "file_id", "chunk_id", "fingerprint").join(store.rows(spark, name), "fingerprint")
