"""The property graph as tables: cleaning and merging of extractions, upserts, look-up, traversal, maintenance, statistics.

entities(kb_id, canonical_name, name, type, labels, aliases, normalized_name, confidence, mention_count, chunk_ids, ...),
relations(kb_id, source, target, type, confidence, evidence_count, chunk_ids, ...), mentions(kb_id, chunk_id, canonical_name,
count), chunks(kb_id, chunk_id, file_id, fingerprint, ...), facts(kb_id, fact_id, ...), fact_support(kb_id, fact_id, chunk_id, weight),
runs(run_id, kb_id, status, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HYBRID
from ..functions.text import code_keys, fallbacks, fingerprint, lookup_key, result_key
from ..sources.scratch import among, settled

UNKNOWN = "unknown"


# --- cleaning and merging -------------------------------------------------------------------------------------------


def clean_entities(raw: DataFrame) -> DataFrame:
    """raw(chunk_id, seq, name, type, confidence): spaces collapsed, two characters at least, the first of a name in a chunk,
    confidence within [0, 1] and 0.7 if missing."""
    name = F.trim(F.regexp_replace("name", r"(?U)\s+", " "))
    first = F.row_number().over(Window.partitionBy("chunk_id", "name").orderBy("seq"))
    out = raw.withColumn("name", name).where(F.length("name") >= 2).withColumn("_first", first).where("_first = 1").drop("_first")
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)))))


def clean_triples(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """raw(chunk_id, seq, head, relation, tail, confidence): no blanks, no self-loops, both ends among the chunk's entities."""
    tidy = raw.select("chunk_id", "seq", *[F.trim(F.regexp_replace(c, r"(?U)\s+", " ")).alias(c) for c in ("head", "relation", "tail")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.6)))).alias("confidence"))
    tidy = tidy.where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != "") & (F.col("head") != F.col("tail")))
    names = entities.select("chunk_id", "name").distinct()
    for end in ("head", "tail"):
        tidy = tidy.join(names.withColumnRenamed("name", end), ["chunk_id", end], "left_semi")
    return tidy.select("chunk_id", "seq", "head", "relation", "tail", "confidence")


def rebind(cached: DataFrame, chunks: DataFrame) -> DataFrame:
    """Payloads from the cache (fingerprint, payload) with the ids of the chunks (chunk_id, fingerprint) that need them."""
    return chunks.join(cached, "fingerprint").select("chunk_id", "payload")


def _with_ids(figures: DataFrame, ids: DataFrame, keys: list[str], chunks: int | None) -> list[DataFrame]:
    """figures, and next to it rows with chunk_ids and n_chunks of ids(keys, _id), whose rows are distinct."""
    if chunks == 0:
        return [figures]
    kept = ids
    if chunks is not None:
        kept = ids.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_id"))).where(F.col("_n") <= chunks)
    lists = kept.where("_id is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("_id").cast("string"))).alias("chunk_ids"), F.count("_id").alias("n_chunks"))
    if chunks is None:
        return [figures, lists]
    return [figures, lists.drop("n_chunks"), ids.groupBy(*keys).agg(F.count("_id").alias("n_chunks"))]


def _beside(tables: list[DataFrame], keys: list[str], columns: dict[str, Column | None]) -> DataFrame:
    """One row a key out of tables that each have some of the columns; a missing value is the one given. Null keys are keys."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table, allowMissingColumns=True)
    first = lambda c, none: F.first(c, ignorenulls=True) if none is None else F.coalesce(F.first(c, ignorenulls=True), none)
    return every.groupBy(*keys).agg(*[first(c, none).alias(c) for c, none in columns.items() if c in every.columns])


def merge_entities(rows: DataFrame, attributes: bool = True, chunks: int | None = None) -> DataFrame:
    """rows(kb_id, seq, canonical_name, name, type, labels, aliases, confidence, mention_count, chunk_ids, attributes) -> one row
    an entity: mentions added up, best confidence, united lists, the first known type, of each attribute the first value;
    n_chunks is the number of chunk_ids.

    chunks: of the ids only so many, the least in text order, stay in chunk_ids (n_chunks still counts all); 0 leaves both out.
    Rows are first added up by all that is told of an entity alike, with plain numbers only, so that a frequent entity is few
    rows before anything is exchanged. Ids and attributes are scans of their own: leave them out where nobody asks for them.
    """
    keys = ["kb_id", "canonical_name"]
    known = F.coalesce("type", F.lit(UNKNOWN)) != UNKNOWN
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    told = rows.groupBy(*keys, "name", "type", "labels", "aliases").agg(F.min("seq").alias("seq"), F.max("confidence").alias("confidence"), F.sum("mention_count").alias("mention_count"))
    merged = told.groupBy(*keys).agg(
        F.min(F.struct("seq", "name"))["name"].alias("name"),
        F.coalesce(F.min(F.when(known, F.struct("seq", "type")))["type"], F.lit(UNKNOWN)).alias("type"),
        united("labels").alias("labels"),
        united("aliases").alias("aliases"),
        F.round(F.max("confidence"), 4).alias("confidence"),
        F.sum("mention_count").cast("long").alias("mention_count"),
    )
    tables = _with_ids(merged, rows.select(*keys, F.explode(F.col("chunk_ids").cast("array<string>")).alias("_id")).distinct(), keys, chunks)
    if attributes:
        entries = rows.select(*keys, "seq", F.explode("attributes").alias("_key", "_value"))
        first = entries.groupBy(*keys, "_key").agg(F.min_by("_value", F.struct("seq", "_value")).alias("_value"))
        tables.append(first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_value").alias("value"))))).alias("attributes")))
    columns = dict.fromkeys(c for c in merged.columns if c not in keys)
    return _beside(tables, keys, columns | {"chunk_ids": F.array().cast("array<string>"), "n_chunks": F.lit(0).cast("long"), "attributes": F.create_map().cast("map<string,string>")})


def merge_relations(rows: DataFrame, entities: DataFrame, chunks: int | None = None) -> DataFrame:
    """rows(kb_id, seq, source, target, type, confidence, evidence_count, chunk_ids[, attributes]) -> one row a (source, type, target)
    whose ends are in entities(kb_id, canonical_name, ...); no self-loops. The best confidence, all evidence, the distinct ids, and the
    attributes of the first row that has any. n_chunks is the number of ids; chunks is as in merge_entities.

    Ids are distinct rows before they become a list, and ends are looked up once a relation, not once a row.
    """
    kept = rows.where("source != target")
    keys = ["kb_id", "source", "target", "type"]
    told = [F.min_by("attributes", F.when(F.size("attributes") > 0, F.col("seq"))).alias("attributes")] if "attributes" in rows.columns else []
    merged = kept.groupBy(*keys).agg(F.round(F.max("confidence"), 4).alias("confidence"), F.sum("evidence_count").cast("long").alias("evidence_count"), *told)
    tables = _with_ids(merged, kept.select(*keys, F.explode("chunk_ids").alias("_id")).distinct(), keys, chunks)
    out = merged
    if len(tables) > 1:
        columns = dict.fromkeys(["confidence", "evidence_count", *(["attributes"] if told else [])])
        out = _beside(tables, keys, columns | {"chunk_ids": F.array().cast("array<string>"), "n_chunks": F.lit(0).cast("long")})
    names = entities.select("kb_id", "canonical_name").distinct()
    for end in ("source", "target"):
        out = out.join(names.withColumnRenamed("canonical_name", end), ["kb_id", end], "left_semi")
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def reclassify_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(canonical_name, new_type): entities of unknown type take the new one, which also becomes a label."""
    new = F.when((F.coalesce("type", F.lit(UNKNOWN)) == UNKNOWN) & F.col("new_type").isNotNull(), F.col("new_type"))
    out = entities.join(mapping.select("canonical_name", "new_type"), "canonical_name", "left").withColumn("_new", new)
    return out.withColumns({"type": F.coalesce("_new", "type"), "labels": F.when(F.col("_new").isNotNull(), F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array("_new"))).otherwise(F.col("labels"))}).select(*entities.columns)


def reclassify_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(source, target, type, new_type)."""
    out = relations.join(mapping.select("source", "target", "type", "new_type"), ["source", "target", "type"], "left")
    return out.withColumn("type", F.coalesce("new_type", "type")).select(*relations.columns)


def extraction_metrics(df: DataFrame) -> DataFrame:
    """df(kb_id, entities, relations, cached, failed) -> sums and flags by knowledge base."""
    return df.groupBy("kb_id").agg(F.sum("entities").cast("long").alias("entities"), F.sum("relations").cast("long").alias("relations"), F.count_if("cached").alias("cache_hits"), F.bool_or("failed").alias("any_failed"), F.bool_and("cached").alias("all_cached"))


# --- cache, delta, upsert -------------------------------------------------------------------------------------------


def live_cache(lines: DataFrame, now: Column, ttl_hours: int = 168) -> DataFrame:
    """lines(key, payload, cached_at): the last line of each key that isn't older than the TTL; empty payloads are never served."""
    fresh = lines.where((F.col("cached_at") >= now - F.make_interval(hours=F.lit(ttl_hours))) & (F.coalesce("payload", F.lit("")) != ""))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cached_at"), F.desc("payload")))
    return fresh.withColumn("_last", last).where("_last = 1").drop("_last")


def changed_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming(kb_id, chunk_id, content): those whose fingerprint differs from the stored one, or that are new."""
    old = stored.select("kb_id", "chunk_id", F.col("fingerprint").alias("_old"))
    marked = incoming.withColumn("fingerprint", fingerprint(F.col("content"))).join(old, ["kb_id", "chunk_id"], "left")
    return marked.where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")


def _newer(old: str, new: str) -> Column:
    """Two maps of texts as one, where a key of the new one wins; null if both are."""
    none = F.create_map().cast("map<string,string>")
    before, after = F.coalesce(old, none), F.coalesce(new, none)
    joined = F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k)), after)
    return F.when(F.col(old).isNotNull() | F.col(new).isNotNull(), joined)


def upsert_entities(old: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    """Full outer merge: new values win over old ones, mentions count per distinct chunk, lists are united; of attributes the new
    value of a key, or the old one where there is none."""
    keys = ["kb_id", "canonical_name"]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, keys, "full_outer")
    lists = {c: F.array_sort(F.array_union(F.coalesce(f"o.{c}", F.array().cast("array<string>")), F.coalesce(f"n.{c}", F.array().cast("array<string>")))) for c in ("labels", "aliases", "chunk_ids")}
    known = F.when(F.coalesce("n.type", F.lit(UNKNOWN)) != UNKNOWN, F.col("n.type"))
    attributes = [_newer("o.attributes", "n.attributes").alias("attributes")] if "attributes" in old.columns and "attributes" in new.columns else []
    return both.select(
        *keys,
        F.coalesce("n.name", "o.name", "canonical_name").alias("name"),
        F.coalesce(known, F.col("o.type"), F.lit(UNKNOWN)).alias("type"),
        *[e.alias(c) for c, e in lists.items()],
        F.coalesce("n.confidence", "o.confidence").alias("confidence"),
        F.size(lists["chunk_ids"]).cast("long").alias("mention_count"),
        *attributes,
        F.coalesce("o.first_run_id", F.lit(run_id)).alias("first_run_id"),
        F.when(F.col("n.confidence").isNotNull(), F.lit(run_id)).otherwise(F.col("o.last_run_id")).alias("last_run_id"),
    )


def upsert_relations(old: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    """Full outer merge: evidence adds up once a run, ids are united; the new attributes, or the old ones where there are none."""
    keys = ["kb_id", "source", "target", "type"]
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    empty = F.array().cast("array<string>")
    attributes = [F.coalesce("n.attributes", "o.attributes").alias("attributes")] if "attributes" in old.columns and "attributes" in new.columns else []
    return both.select(*keys, *attributes, F.coalesce("n.confidence", "o.confidence").alias("confidence"), (F.coalesce("o.evidence_count", F.lit(0)) + F.coalesce("n.evidence_count", F.lit(0))).cast("long").alias("evidence_count"), F.array_sort(F.array_union(F.coalesce("o.chunk_ids", empty), F.coalesce("n.chunk_ids", empty))).alias("chunk_ids"), F.coalesce("o.first_run_id", F.lit(run_id)).alias("first_run_id"))


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str, run_id: str) -> DataFrame:
    """Mentions and fact support: the count grows by the new rows' count; the first run stays."""
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return both.select(*keys, (F.coalesce(f"o.{count}", F.lit(0)) + F.coalesce(f"n.{count}", F.lit(0))).cast("long").alias(count), F.coalesce("o.first_run_id", F.lit(run_id)).alias("first_run_id"))


def facts_of(relations: DataFrame) -> DataFrame:
    """One fact a relation, named source|type|target."""
    return relations.select("kb_id", F.concat_ws("|", "source", "type", "target").alias("fact_id"), "source", "target", "type", "confidence", "evidence_count")


def rollback(table: DataFrame, run_id: str) -> DataFrame:
    """table without the rows that the run was the first to write."""
    return table.where(~F.col("first_run_id").eqNullSafe(F.lit(run_id)))


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The last status of each run of an append-only ledger (run_id, kb_id, status, at, ...)."""
    last = F.row_number().over(Window.partitionBy("run_id", "kb_id").orderBy(F.desc("at"), F.desc("status")))
    return ledger.withColumn("_last", last).where("_last = 1").drop("_last")


def match_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations with the canonical names of their ends: by canonical name, what is left by name or alias; unmatched ends
    drop the relation. Only equi-joins."""
    out = relations
    forms = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    canonical = entities.select(F.col("kb_id").alias("_ck"), F.col("canonical_name").alias("_c")).distinct()
    other = entities.select(F.col("kb_id").alias("_ok"), "canonical_name", forms.alias("_n")).groupBy("_ok", "_n").agg(F.min("canonical_name").alias("_via"))
    for end in ("source", "target"):
        out = out.join(canonical, (F.col("kb_id") == F.col("_ck")) & (F.col(end) == F.col("_c")), "left")
        out = out.join(other, F.col("_c").isNull() & (F.col("kb_id") == F.col("_ok")) & (F.col(end) == F.col("_n")), "left")
        out = out.withColumn(end, F.coalesce("_c", "_via")).drop("_ck", "_c", "_ok", "_n", "_via").where(F.col(end).isNotNull())
    return out


# --- look-up and traversal ------------------------------------------------------------------------------------------


def neighbours(relations: DataFrame, entities: DataFrame, most: int | None = None) -> DataFrame:
    """entities(kb_id, canonical_name) with the distinct outgoing (target, type) and incoming (source, type) relations, sorted, the first
    `most` if given, and their numbers n_outgoing and n_incoming, null if there are none.

    Pairs are distinct rows before they become a list; where only the numbers are selected, Spark leaves the lists out.
    """
    of, around = ["kb_id", "canonical_name"], entities.select("kb_id", "canonical_name")
    for own, other, name in (("source", "target", "outgoing"), ("target", "source", "incoming")):
        pairs = relations.select("kb_id", F.col(own).alias("canonical_name"), other, "type").distinct()
        if most is not None:
            pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*of).orderBy(other, "type"))).where(F.col("_n") <= most)
        sides = pairs.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct(other, "type"))).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
        around = around.join(sides, of, "left")
    return around


def lookup(names: DataFrame, entities: DataFrame, ascii_only: bool = False) -> DataFrame:
    """names(query_id, kb_id, query_entity) -> the entity of each name: by name, canonical name or alias; by normalised key (also of
    the parts of the name); by a part itself; by a code that the entity's key contains. The first stage that hits counts,
    then mentions, confidence, the shorter name, the name.

    Three stages are equi-joins. The fourth only takes names that are codes, and meets entities on trigrams; where an earlier stage
    hits, what it finds doesn't count.
    """
    pick = ["kb_id", "canonical_name", "name", "mention_count", "confidence"]
    parts = names.withColumn("_parts", F.array_distinct(F.filter(F.concat(F.array(F.trim("query_entity")), fallbacks(F.col("query_entity"))), lambda x: x != "")))
    surface = entities.select(*pick, F.explode(F.array_distinct(F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_form"))
    keyed = entities.withColumn("_key", lookup_key(F.col("name"), ascii_only))
    ask = names.select("query_id", "kb_id", "query_entity")
    exact = ask.join(surface.withColumnRenamed("_form", "query_entity"), ["kb_id", "query_entity"]).withColumns({"stage": F.lit(1), "match_stage": F.lit("exact")})
    part = parts.select("query_id", "kb_id", "query_entity", F.explode("_parts").alias("_part"))
    keys = part.withColumn("_key", lookup_key(F.col("_part"), ascii_only)).where("_key != ''")
    normal = keys.join(keyed.select(*pick, "_key"), ["kb_id", "_key"]).withColumns({"stage": F.lit(2), "match_stage": F.lit("normalized")})
    split = part.join(surface.withColumnRenamed("_form", "_part"), ["kb_id", "_part"]).withColumns({"stage": F.lit(3), "match_stage": F.lit("split")})
    columns = ["query_id", "query_entity", *pick, "stage", "match_stage"]
    codes = keys.select("query_id", "kb_id", "query_entity", F.explode(code_keys(F.array("_key"))).alias("_code")).withColumn("_gram", F.substring("_code", 1, 3))
    n = F.length("_key")
    grams = F.array_distinct(F.transform(F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substring("_key", i, F.lit(3))))
    contains = keyed.select(*pick, "_key", F.explode(grams).alias("_gram")).join(codes, ["kb_id", "_gram"]).where(F.contains("_key", "_code")).withColumns({"stage": F.lit(4), "match_stage": F.lit("code_contains")})
    every = exact.select(columns).unionByName(normal.select(columns)).unionByName(split.select(columns)).unionByName(contains.select(columns))
    best = F.row_number().over(Window.partitionBy("query_id", "kb_id", "query_entity").orderBy("stage", F.desc("mention_count"), F.desc("confidence"), F.length("name"), "canonical_name"))
    return every.withColumn("_best", best).where("_best = 1").drop("_best", "stage")


def entity_report(names: DataFrame, hit: DataFrame) -> DataFrame:
    """names(query_id, kb_id, query_entity), hit: what lookup gives for them -> by query the extracted names, their lookup keys, the
    matched and the unmatched ones, details (kb_id, query_entity, matched_entity, match_stage, fallback_candidates) and fallback_used:
    whether any name has parts to fall back to. Lists are sorted; a name is matched if a knowledge base has it. A query's names are
    few, so its lists are short."""
    key = ["query_id", "kb_id", "query_entity"]
    every = names.select(*key).distinct().join(hit.select(*key, F.col("name").alias("_found"), "match_stage"), key, "left")
    every = every.withColumns({"_key": lookup_key(F.col("query_entity")), "_parts": fallbacks(F.col("query_entity"))})
    detail = F.struct("kb_id", "query_entity", F.col("_found").alias("matched_entity"), F.coalesce("match_stage", F.lit("none")).alias("match_stage"), F.col("_parts").alias("fallback_candidates"))
    listed = lambda c, when=F.lit(True): F.array_sort(F.collect_set(F.when(when, F.col(c))))
    out = every.groupBy("query_id").agg(listed("query_entity").alias("extracted_entities"), listed("_key", F.col("_key") != "").alias("normalized_entities"), listed("query_entity", F.col("_found").isNotNull()).alias("matched_entities"), F.array_sort(F.collect_list(detail)).alias("match_details"), F.bool_or(F.size("_parts") > 0).alias("fallback_used"))
    return out.withColumn("unmatched_entities", F.array_except("extracted_entities", "matched_entities"))


def paths(starts: DataFrame, relations: DataFrame, hops: int = 2, limit: int | None = 5, most_evidence: int = 5, evidence: DataFrame | None = None) -> DataFrame:
    """starts(query_id, kb_id, entity) -> query_id, kb_id, entity, target, relations, evidence, hop: undirected paths of up to `hops`
    relations that use none twice and don't end where they start. Equal rows count once; the first `limit` a start, by hop
    and name. A start with enough rows after a hop goes no farther: the order is by hop.

    With a limit, a step only needs a node's first neighbours by name: `limit` of them, and one more for each relation that the
    path has used and for the start. So a hub hands on as many rows as any node, and the rows of a hop are bounded by the
    starts, the limit and the relations between two nodes; the cut is made before rows are exchanged.

    evidence(kb_id, source, target, type, chunk_id), rows that may repeat: the relations come without chunk_ids, which are looked up
    for the relations that a step has reached only.
    """
    edge, none = ["kb_id", "source", "target", "type"], F.array().cast("array<string>")
    # a path shows the least ids of its relations, which are among the least of each
    least = F.slice(F.array_sort(F.array_distinct(F.coalesce("chunk_ids", none))), 1, most_evidence) if evidence is None else F.struct(*edge)
    keyed = relations.select(*edge, least.alias("chunk_ids"), F.xxhash64("kb_id", "source", "type", "target").alias("edge"))
    both = keyed.select("kb_id", F.col("source").alias("at"), F.col("target").alias("to"), "type", "chunk_ids", "edge").unionByName(keyed.select("kb_id", F.col("target").alias("at"), F.col("source").alias("to"), "type", "chunk_ids", "edge"))
    if limit is not None:
        place = F.dense_rank().over(Window.partitionBy("kb_id", "at").orderBy("to"))
        both = both.withColumn("_place", place).where(F.col("_place") <= limit + hops).drop("_place")
    front = starts.select("query_id", "kb_id", "entity").distinct().withColumns({"at": F.col("entity"), "edges": F.array().cast("array<bigint>"), "relations": F.array().cast("array<string>"), "ids": F.array().cast("array<string>")})
    order = Window.partitionBy("query_id", "kb_id", "entity").orderBy("hop", "target", F.array_join("relations", ","), F.array_join("evidence", ","))
    out = None
    for hop in range(1, hops + 1):
        step = front.join(both, ["kb_id", "at"]).where(~F.array_contains("edges", F.col("edge")))
        if evidence is not None:
            step = settled(step.select("*", *[F.col("chunk_ids")[c].alias(f"_{c}") for c in edge]).drop("chunk_ids"), "step")
            reached = settled(step.select(*[F.col(f"_{c}").alias(c) for c in edge]).distinct(), "reached")
            ids = among(evidence.select(*edge, F.col("chunk_id").cast("string").alias("_id")).where("_id is not null"), reached, edge).distinct()
            first = ids.withColumn("_n", F.row_number().over(Window.partitionBy(*edge).orderBy("_id"))).where(F.col("_n") <= most_evidence)
            lists = first.groupBy(*[F.col(c).alias(f"_{c}") for c in edge]).agg(F.collect_list("_id").alias("_ids"))
            step = step.join(lists, [f"_{c}" for c in edge], "left").withColumn("chunk_ids", F.coalesce("_ids", none))
        front = step.select("query_id", "kb_id", "entity", F.col("to").alias("at"), F.concat("edges", F.array("edge")).alias("edges"), F.concat("relations", F.array("type")).alias("relations"), F.concat("ids", "chunk_ids").alias("ids"))
        rows = front.where("at != entity").select("query_id", "kb_id", "entity", F.col("at").alias("target"), "relations", F.slice(F.array_sort(F.array_distinct("ids")), 1, most_evidence).alias("evidence"), F.lit(hop).alias("hop")).distinct()
        out = rows if out is None else out.unionByName(rows)
        if limit is not None and hop < hops:
            enough = rows.groupBy("query_id", "kb_id", "entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
            front = front.join(enough, ["query_id", "kb_id", "entity"], "left_anti")
    if limit is None:
        return out
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def graph_score(hop: Column, confidence: Column, evidence: Column, mentions: Column, direct: Column, config=HYBRID) -> Column:
    base = F.when(direct, config.direct_base).otherwise(F.greatest(F.lit(0.0), config.hop_base - F.greatest(F.lit(0), hop - 1) * config.hop_decay))
    score = base + config.confidence_weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) + config.evidence_weight * F.least(F.lit(1.0), evidence / 5.0) + config.mention_weight * F.least(F.lit(1.0), mentions / 8.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


#: What a match of each stage is worth.
STAGE_WEIGHT = {"exact": 1.0, "normalized": 0.97, "split": 0.92, "code_contains": 0.84}


def graph_channel(names: DataFrame, entities: DataFrame, relations: DataFrame, top_k: int, hops: int = 2, ascii_only: bool = False, config=HYBRID, hit: DataFrame | None = None, mentioned: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """names(query_id, kb_id, query_entity), hit: what lookup gives for them, if it is written already -> query_id, kb_id, key, source, entity, hop, score: the matched entities and what is
    related to them, one row a key, the top_k best.

    mentioned(kb_id, canonical_name, chunk_id), with hit, and evidence as in paths: rows that may repeat, from which the chunks of
    the matched entities and of the relations on a path are counted and listed; the tables come without them then."""
    hit = lookup(names, entities, ascii_only) if hit is None else hit
    weight = F.create_map(*[F.lit(x) for pair in STAGE_WEIGHT.items() for x in pair])[F.col("match_stage")]
    of = ["kb_id", "canonical_name"]
    if mentioned is None:
        facts = entities.select(*of, (F.col("n_chunks") if "n_chunks" in entities.columns else F.size("chunk_ids")).alias("evidence"))
        direct = hit.join(facts, of)
    else:
        facts = among(mentioned.select(*of, "chunk_id"), hit, of).distinct().groupBy(*of).agg(F.count("chunk_id").alias("evidence"))
        direct = hit.join(facts, of, "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    direct = direct.select("query_id", "kb_id", F.concat(F.lit("entity::"), "name", F.lit("::graph_direct")).alias("key"), F.lit("graph_direct").alias("source"), F.col("canonical_name").alias("entity"), F.lit(0).alias("hop"), "match_stage", F.round(weight * graph_score(F.lit(0), F.col("confidence"), F.col("evidence"), F.col("mention_count"), F.lit(True), config), 6).alias("score"))
    starts = hit.select("query_id", "kb_id", F.col("canonical_name").alias("entity"))
    walked = paths(starts, relations, hops, evidence=evidence)
    ends = entities.select("kb_id", F.col("canonical_name").alias("target"), F.col("confidence").alias("c"), F.col("mention_count").alias("m"))
    related, none = walked.join(ends, ["kb_id", "target"]), F.lit(None).cast("string")
    related = related.select("query_id", "kb_id", result_key(none, none, none, F.col("entity"), F.col("target"), F.col("relations"), F.col("hop"), F.col("evidence"), none).alias("key"), F.lit("graph_related").alias("source"), F.col("target").alias("entity"), "hop", F.lit("").alias("match_stage"), F.round(graph_score(F.col("hop"), F.col("c"), F.size("evidence"), F.col("m"), F.lit(False), config), 6).alias("score"))
    every = direct.unionByName(related)
    one = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "kb_id", "entity"))
    every = every.withColumn("_one", one).where("_one = 1").drop("_one")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return every.withColumn("rank", rank).where(F.col("rank") <= top_k)


# --- maintenance and statistics -------------------------------------------------------------------------------------


def delete_file(kb_id, file_id, chunks: DataFrame, mentions: DataFrame, entities: DataFrame, relations: DataFrame, fact_support: DataFrame) -> dict[str, DataFrame]:
    """The tables without a file's chunks: its ids leave the relations, relations of the knowledge base without evidence go (those of
    other files too, as in the original), then facts without support, then entities without mentions."""
    in_kb = F.col("kb_id") == F.lit(kb_id)
    gone = chunks.where(in_kb & (F.col("file_id") == F.lit(file_id))).select("kb_id", "chunk_id")
    left_chunks = chunks.join(gone, ["kb_id", "chunk_id"], "left_anti")
    left_mentions = mentions.join(gone, ["kb_id", "chunk_id"], "left_anti")
    # one row a chunk of a relation: no list of all deleted chunks, and a relation that loses none isn't rebuilt
    edge = ["kb_id", "source", "target", "type"]
    held = relations.where(in_kb).select(*edge, F.explode("chunk_ids").alias("chunk_id"))
    lost = held.join(gone, ["kb_id", "chunk_id"], "left_semi").groupBy(*edge).agg(F.collect_set("chunk_id").alias("_gone"))
    left_relations = relations.join(lost, edge, "left").withColumn("chunk_ids", F.when(F.col("_gone").isNotNull(), F.array_except("chunk_ids", "_gone")).otherwise(F.col("chunk_ids"))).drop("_gone")
    left_relations = left_relations.where(~in_kb | (F.size("chunk_ids") > 0))
    left_support = fact_support.join(gone, ["kb_id", "chunk_id"], "left_anti")
    left_facts = facts_of(left_relations).join(left_support.select("kb_id", "fact_id").distinct(), ["kb_id", "fact_id"], "left_semi")
    alive = left_mentions.select("kb_id", "canonical_name").distinct()
    left_entities = entities.where(~in_kb).unionByName(entities.where(in_kb).join(alive, ["kb_id", "canonical_name"], "left_semi"))
    return {"chunks": left_chunks, "mentions": left_mentions, "relations": left_relations, "facts": left_facts, "fact_support": left_support, "entities": left_entities}


def counts_left(kb_id, file_id, rows: DataFrame, told: Callable[[Column], Column], per_task: int = 250_000) -> DataFrame:
    """How many chunks each entity and each relation has left when a file goes, those that have none left out: delete_file, counted
    from extractions instead of tables with lists.

    rows(kb_id, chunk_id, file_id, ...): a chunk's rows are all of one file. told: a row -> array<struct<kind, name>>, the entities and
    relations that it speaks of, null where it is none. Rows meet by chunk, where names become distinct, so ids are neither
    exchanged with every name nor made a list; then only counts are exchanged. A task sorts about per_task rows.
    """
    gone = (F.col("kb_id") == F.lit(kb_id)) & (F.col("file_id") == F.lit(file_id))
    left, by = rows.where(~gone).drop("file_id"), ["kb_id", "chunk_id"]
    parts = -(-rows.count() // per_task)
    placed = left.repartition(parts, *by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else left.repartition(*by)
    own = placed.groupBy(*by).agg(F.collect_set(F.struct(*[c for c in left.columns if c not in by])).alias("own"))
    names = own.select("kb_id", F.explode(F.array_distinct(F.flatten(F.transform("own", told)))).alias("told")).where("told is not null")
    return names.groupBy("kb_id", F.col("told.kind").alias("kind"), F.col("told.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def delete_kb(table: DataFrame, kb_id) -> DataFrame:
    return table.where(~F.col("kb_id").eqNullSafe(F.lit(kb_id)))


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kb_id, measure, name, n: nodes, edges, and their counts by type."""
    parts = [
        entities.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).select("kb_id", F.lit("nodes").alias("measure"), F.lit("").alias("name"), "n"),
        relations.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).select("kb_id", F.lit("edges").alias("measure"), F.lit("").alias("name"), "n"),
        entities.groupBy("kb_id", "type").agg(F.count(F.lit(1)).alias("n")).select("kb_id", F.lit("entity_type").alias("measure"), F.col("type").alias("name"), "n"),
        relations.groupBy("kb_id", "type").agg(F.count(F.lit(1)).alias("n")).select("kb_id", F.lit("relation_type").alias("measure"), F.col("type").alias("name"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def preview_graph(entities: DataFrame, relations: DataFrame, nodes: int = 80, edges: int = 160) -> tuple[DataFrame, DataFrame]:
    """The entities with the most mentions, and the relations between them with the most evidence. Limits are clamped."""
    nodes, edges = max(10, min(300, nodes)), max(20, min(800, edges))
    top = entities.orderBy(F.desc("mention_count"), "canonical_name", "kb_id").limit(nodes)
    inside = relations
    for end in ("source", "target"):
        inside = inside.join(top.select("kb_id", F.col("canonical_name").alias(end)), ["kb_id", end], "left_semi")
    return top, inside.orderBy(F.desc("evidence_count"), "source", "target", "type", "kb_id").limit(edges)


def with_lookup_keys(entities: DataFrame, ascii_only: bool = False) -> DataFrame:
    """normalized_name filled where it is missing."""
    return entities.withColumn("normalized_name", F.when(F.coalesce("normalized_name", F.lit("")) == "", lookup_key(F.col("name"), ascii_only)).otherwise(F.col("normalized_name")))


def with_evidence(relations: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """relations with the previews of up to `most` of their chunks."""
    wanted = relations.select("kb_id", "source", "target", "type", F.posexplode(F.slice("chunk_ids", 1, most)).alias("i", "chunk_id"))
    found = wanted.join(chunks.select("kb_id", "chunk_id", "preview"), ["kb_id", "chunk_id"]).groupBy("kb_id", "source", "target", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "preview"))), lambda x: x["preview"]).alias("previews"))
    return relations.join(found, ["kb_id", "source", "target", "type"], "left")


def build_kpis(entities: DataFrame, relations: DataFrame, raw_mentions: int | Column) -> DataFrame:
    """Share of unknown types, mean confidence, density, merged mentions: one row a knowledge base."""
    e = entities.groupBy("kb_id").agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg((F.coalesce("type", F.lit(UNKNOWN)) == UNKNOWN).cast("int")), 4).alias("unknown_ratio"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), (F.sum("mention_count") - F.count(F.lit(1))).cast("long").alias("merged"))
    r = relations.groupBy("kb_id").agg(F.count(F.lit(1)).alias("relations"))
    out = e.join(r, "kb_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    return out.withColumn("density", F.when(F.col("entities") > 1, F.round(F.col("relations") / (F.col("entities") * (F.col("entities") - 1)), 4)).otherwise(0.0))


def entity_text(entities: DataFrame, around: DataFrame) -> DataFrame:
    """entities joined with around (from neighbours): kb_id, canonical_name, text: the name and type, then as far as there are any: the
    attributes, five chunks, three outgoing and three incoming relations."""
    joined = entities.join(around, ["kb_id", "canonical_name"], "left")
    line = lambda head, items, sign=", ": F.when(F.size(items) > 0, F.concat(F.lit(f"\n{head}: "), F.array_join(items, sign))).otherwise("")
    own = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")))
    attributes = F.when(F.size(own) > 0, F.concat(F.lit("\n属性: {"), F.array_join(own, ", "), F.lit("}"))).otherwise("") if "attributes" in entities.columns else F.lit("")
    out = F.transform(F.slice("outgoing", 1, 3), lambda r: F.concat(r["type"], F.lit("->"), r["target"]))
    in_ = F.transform(F.slice("incoming", 1, 3), lambda r: F.concat(r["source"], F.lit("-"), r["type"], F.lit("->此实体")))
    head = F.format_string("实体: %s (类型: %s)", "name", F.coalesce("type", F.lit(UNKNOWN)))
    text = F.concat(head, attributes, line("证据块", F.slice(F.array_distinct("chunk_ids"), 1, 5)), line("关系", out), line("相关", in_))
    return joined.select("kb_id", "canonical_name", text.alias("text"))


def relation_text(source: Column, target: Column, kind: Column, relations: Column, hop: Column, evidence: Column) -> Column:
    """How a related entity is told: the path of relations, its type and distance, and five chunks of evidence."""
    path = F.when(F.size(relations) > 0, F.concat(F.lit(" 通过 ["), F.array_join(relations, " -> "), F.lit("]"))).otherwise("")
    chunks = F.when(F.size(evidence) > 0, F.concat(F.lit("\n证据块: "), F.array_join(F.slice(evidence, 1, 5), ", "))).otherwise("")
    return F.concat(source, path, F.lit(" 关联到 "), target, F.lit(" (类型: "), F.coalesce(kind, F.lit(UNKNOWN)), F.lit(", "), hop.cast("string"), F.lit("跳)"), chunks)


def evidence_graph(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results(query_id, source, entity, target, relations, hop) of the graph channel -> nodes (query_id, node, kind), where direct beats
    related, and edges (query_id, source, target, relation, hop, parallel), each once, with an index among parallel ones."""
    ends = results.select("query_id", F.col("entity").alias("node"), F.when(F.col("source") == "graph_direct", 0).otherwise(1).alias("k")).unionByName(results.where("target is not null").select("query_id", F.col("target").alias("node"), F.lit(1).alias("k")))
    nodes = ends.groupBy("query_id", "node").agg(F.when(F.min("k") == 0, "direct").otherwise("related").alias("kind"))
    edges = results.where("target is not null").select("query_id", F.col("entity").alias("source"), "target", F.array_join("relations", ",").alias("relation"), "hop").distinct()
    pair = Window.partitionBy("query_id", F.least("source", "target"), F.greatest("source", "target")).orderBy("source", "relation", "hop")
    return nodes, edges.withColumn("parallel", F.row_number().over(pair) - 1)
