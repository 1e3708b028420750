"""The catalog: listings, look-ups, roll-ups, cascades and versioned updates over its tables, and stored vectors by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0, **equal) -> DataFrame:
    """Rows that equal the given values, in a total order, from offset on."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(*order).offset(offset).limit(limit)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def update_metadata(vectors: DataFrame, updates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """vectors(metadata map) with the keys of updates(key, metadata) replaced; values are texts."""
    new = updates.select(key, F.col("metadata").alias("_new"))
    merged = F.map_concat(F.map_filter("metadata", lambda k, _: ~F.array_contains(F.map_keys("_new"), k)), F.transform_values("_new", lambda _, v: v.cast("string")))
    out = vectors.join(new, key, "left")
    return out.withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(merged)).select(*vectors.columns)


def collection_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("kb_id").agg(F.count(F.lit(1)).alias("vectors")).select(F.concat(F.lit("kb_"), F.col("kb_id").cast("string")).alias("collection"), "vectors")


def chunk_listing(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks with their file's name, in order of name and position."""
    return chunks.join(files.select("file_id", "filename"), "file_id").orderBy("filename", "chunk_index")


def kb_stats(kbs: DataFrame, files: DataFrame) -> DataFrame:
    """Completed files and their chunks of every knowledge base, 0 for empty ones."""
    done = files.where("status = 'completed'").groupBy("kb_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("chunk_count").alias("chunk_count"))
    return kbs.join(done, "kb_id", "left").withColumns({"file_count": F.coalesce("file_count", F.lit(0)), "chunk_count": F.coalesce("chunk_count", F.lit(0))})


def assistant_kbs(assistants: DataFrame, kbs: DataFrame) -> DataFrame:
    """assistants(assistant_id, kb_ids as comma-separated text) -> assistant_id, kb_names in the order of the ids."""
    ids = assistants.select("assistant_id", F.posexplode(F.split("kb_ids", ",")).alias("i", "id")).withColumn("kb_id", F.expr("try_cast(trim(id) AS int)"))
    named = ids.join(kbs.select("kb_id", "name"), "kb_id")
    return named.groupBy("assistant_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ",").alias("kb_names"))


def embedding_violations(wanted: DataFrame, kbs: DataFrame, settings: list[str]) -> DataFrame:
    """wanted(owner, kb_id), kbs(kb_id, settings...) -> owners with unknown knowledge bases or more than one embedding setting."""
    joined = wanted.join(kbs.select("kb_id", F.concat_ws("/", *settings).alias("setting")), "kb_id", "left")
    checked = joined.groupBy("owner").agg(F.count_if(F.col("setting").isNull()).alias("unknown_kbs"), F.countDistinct("setting").alias("settings"))
    return checked.where("unknown_kbs > 0 OR settings <> 1")


def cascade(parents_gone: DataFrame, parent_key: str, *levels: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What is left of each level when parents go: levels are (table, foreign key to the level above, own key)."""
    left, gone, key = [], parents_gone.select(parent_key).distinct(), parent_key
    for table, foreign, own in levels:
        ids = gone.select(F.col(key).alias(foreign))
        left.append(table.join(ids, foreign, "left_anti"))
        gone, key = table.join(ids, foreign, "left_semi").select(own).distinct(), own
    return left


def last_messages(messages: DataFrame, turns: int, order: str = "turn") -> DataFrame:
    """The newest 2 * turns messages of each conversation, oldest first by place."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(order)))
    kept = messages.withColumn("_place", place).where(F.col("_place") <= 2 * turns)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(order))).drop("_place")


def message_counters(messages: DataFrame, order: str = "turn") -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.max(order).alias("last"))


def model_usage(kbs: DataFrame, assistants: DataFrame) -> DataFrame:
    """model, used_by, n: knowledge bases of any status and active assistants that use a model."""
    uses = kbs.select(F.col("embedding_model").alias("model"), F.lit("kb").alias("used_by")).unionByName(assistants.where("status = 'active'").select(F.col("llm_model").alias("model"), F.lit("assistant").alias("used_by")))
    return uses.groupBy("model", "used_by").agg(F.count(F.lit(1)).alias("n"))


def readable_size(size: Column) -> Column:
    """1536 -> 1.50 KB; units up to PB."""
    shown = lambda i, unit: F.concat(F.format_string("%.2f", F.bround(size / F.lit(1024.0**i), 2)), F.lit(f" {unit}"))
    out = shown(5, "PB")
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(size < 1024.0 ** (i + 1), shown(i, unit)).otherwise(out)
    return out


def valid_kb_name(name: Column) -> Column:
    """Whether a knowledge base may have this name: up to 100 Chinese characters, letters, digits, underscores, hyphens."""
    return F.coalesce(name.rlike(r"^[\u4e00-\u9fa5a-zA-Z0-9_-]{1,100}$"), F.lit(False))


def clean_path(path: Column) -> Column:
    """A path without `..` and `~`, empty and `.` steps taken out."""
    bare = F.replace(F.replace(path, F.lit(".."), F.lit("")), F.lit("~"), F.lit(""))
    steps = F.array_join(F.filter(F.split(bare, "/"), lambda x: (x != "") & (x != ".")), "/")
    root = F.when(bare.rlike("^//($|[^/])"), "//").when(bare.startswith("/"), "/").otherwise("")
    out = F.concat(root, steps)
    return F.when(out == "", ".").otherwise(out)


def apply_updates(table: DataFrame, updates: DataFrame, key: str, now: Column) -> DataFrame:
    """The table with the non-null columns of updates in place, updated_at stamped, processed_at when a row becomes completed."""
    fields = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = table.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields})
    out = out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    if "status" in fields:
        out = out.withColumn("processed_at", F.when(F.col("_hit") & (F.col("_status") == "completed"), now).otherwise(F.col("processed_at")))
    return out.select(*table.columns)


def latest_state(log: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of an append-only log for each key."""
    rest = [c for c in log.columns if c not in (key, at)]
    return log.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("s")).select(key, f"s.{at}", *[f"s.{c}" for c in rest])


def content_duplicates(files: DataFrame) -> DataFrame:
    """files(kb_id, file_id, text) with file_hash, first_id (the smallest id with the same content) and is_first."""
    hashed = files.withColumn("file_hash", F.md5(F.col("text").cast("binary")))
    first = hashed.groupBy("kb_id", "file_hash").agg(F.min("file_id").alias("first_id"))
    return hashed.join(first, ["kb_id", "file_hash"]).withColumn("is_first", F.col("file_id") == F.col("first_id"))


def new_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content isn't stored as completed with chunks in the same knowledge base."""
    known = stored.where("status = 'completed' AND chunk_count > 0").select("kb_id", "file_hash").distinct()
    return files.withColumn("file_hash", F.md5(F.col("text").cast("binary"))).join(known, ["kb_id", "file_hash"], "left_anti")


#: File types that are accepted, names that are reserved.
EXTENSIONS = ("txt", "md", "markdown", "html", "htm", "json", "jsonl", "pdf", "doc", "docx")
RESERVED = ("con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)))


def file_errors(name: Column, size: Column, most: int = 100 * 1024 * 1024) -> Column:
    """array<string> of what is wrong with a file, empty if nothing is."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    checks = [("extension", ~ext.isin(*EXTENSIONS)), ("size", (size > most) | (size <= 0)), ("characters", name.rlike(r'[<>:"/\\|?*\x00-\x1f]')), ("reserved", stem.isin(*RESERVED)), ("empty", F.trim(name) == "")]
    return F.array_compact(F.array(*[F.when(bad, F.lit(label)) for label, bad in checks]))


def request_errors(query: Column, top_k: Column, threshold: Column) -> Column:
    checks = [("query", ~F.length(query).between(1, 1000)), ("top_k", ~top_k.between(1, 20)), ("threshold", ~threshold.between(0, 1))]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(label)) for label, bad in checks]))


def kb_snapshot(kbs: DataFrame, files: DataFrame) -> DataFrame:
    """One JSON text a knowledge base: id, name, model, files, chunks."""
    rolled = kb_stats(kbs, files)
    return rolled.select("kb_id", F.to_json(F.struct("kb_id", "name", "embedding_model", F.col("file_count").alias("total_files"), F.col("chunk_count").alias("total_chunks"))).alias("info"))
