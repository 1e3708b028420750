"""Queries over texts: normalisation, tokens, chunks, keyword search, training data, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import STOP_WORDS
from ..functions import text as tx
from ..operators import chunking, datasets, evaluate, keyword
from ..sources import files
from ..sources.scratch import among, settled
from ..functions.text import let
from . import retrieval
from .inputs import table, text_chunks, text_queries
from .registry import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def normal_sql(text: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), chr(160), ' '), '[\t\f\x0B]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, md5({normal_sql('text')}) AS text_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normalise(F.col("text")).cast("binary")).alias("text_md5"))


@query(r"""SELECT doc_id, coalesce(regexp_matches(text, '(?m)^#{1,6}\s') OR regexp_matches(text, '(?m)^[-*]\s') OR regexp_matches(text, '(?m)^\d+\.\s') OR regexp_matches(text, '(?m)^\|.*\|') OR regexp_matches(text, '(?m)^```') OR regexp_matches(text, '\n##\s'), FALSE) AS is_markdown FROM documents""")
def detect_markdown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.looks_like_markdown(F.col("text")).alias("is_markdown"))


NUMBERED = "concat_ws(chr(10), '第三章 ' || source, '  二、' || lang, '（三)', '(四) x', doc_id || '.2 section', '12 apples', '3. listed', text)"


@query(rf"""WITH t AS (SELECT doc_id, {NUMBERED} AS text FROM documents), l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM t),
h AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^第[一二三四五六七八九十百0-9]+章') OR regexp_matches(x, '^[一二三四五六七八九十]+、') OR regexp_matches(x, '^\(?[一二三四五六七八九十]+\)') OR regexp_matches(x, '^\d+(\.\d+){{0,2}}\s+') THEN '## ' || x ELSE x END), chr(10)) AS text FROM l)
SELECT doc_id, md5({normal_sql('text')}) AS text_md5, len(regexp_extract_all(text, '(?m)^## ')) AS headings FROM h""")
def inferred_headings(spark, sf_dir):
    """Documents below lines that look like titles, some of them really, with the headings inferred."""
    lines = [F.concat(F.lit("第三章 "), "source"), F.concat(F.lit("  二、"), "lang"), F.lit("（三)"), F.lit("(四) x"), F.concat(F.col("doc_id").cast("string"), F.lit(".2 section")), F.lit("12 apples"), F.lit("3. listed"), F.col("text")]
    d = _docs(spark, sf_dir).select("doc_id", tx.infer_headings(F.concat_ws("\n", *lines)).alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.size(F.regexp_extract_all("t", F.lit("(?m)^(## )"))).cast("long").alias("headings"))


@query("""SELECT doc_id, source AS kb_id, md5(text) AS file_hash, min(doc_id) OVER (PARTITION BY source, md5(text)) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY source, md5(text)) AS is_first FROM documents""")
def doc_dedup(spark, sf_dir):
    from ..operators.catalog import content_duplicates

    d = _docs(spark, sf_dir).select(F.col("source").alias("kb_id"), F.col("doc_id").alias("file_id"), "text")
    return content_duplicates(d).select(F.col("file_id").alias("doc_id"), "kb_id", "file_hash", "first_id", "is_first")


WINDOWS_SQL = "w AS (SELECT doc_id, start, substr(text, start + 1, {size}) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS start FROM documents {where}))"


@query(f"WITH {WINDOWS_SQL.format(size=750, step=630, where='')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS chunk_index, start::INTEGER AS start, md5(content) AS content_md5 FROM w WHERE trim(content) <> ''")
def fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(_docs(spark, sf_dir), 750, 120).select("doc_id", "chunk_index", "start", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {WINDOWS_SQL.format(size=750, step=630, where='')}, c AS (SELECT doc_id, length(content) AS n FROM w WHERE trim(content) <> ''),
a AS (SELECT doc_id, list(n ORDER BY n) AS l FROM c GROUP BY doc_id)
SELECT doc_id, len(l) AS chunks, round(list_avg(l), 2) AS avg_length, l[1]::INTEGER AS min_length, l[-1]::INTEGER AS max_length, 0::BIGINT AS empty, l[greatest(0, least(len(l) - 1, floor(len(l) * 0.95)::INTEGER - 1)) + 1]::INTEGER AS p95_length FROM a""")
def chunk_quality(spark, sf_dir):
    return chunking.chunk_quality(chunking.fixed_chunks(_docs(spark, sf_dir), 750, 120))


@query("SELECT doc_id, sha1(trim(text)) AS fingerprint, substr(replace(trim(text), chr(10), ' '), 1, 220) AS preview, length(text) AS char_length FROM documents")
def fingerprints(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"), tx.preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("char_length"))


@query(f"""WITH {WINDOWS_SQL.format(size=3200, step=2900, where='WHERE length(text) > 3200')}, u AS (SELECT doc_id, start, content FROM w UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 3200),
t AS (SELECT doc_id, start, trim(content) AS content FROM u) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS layer, md5(content) AS content_md5 FROM t WHERE content <> ''""")
def layer_windows(spark, sf_dir):
    return chunking.layered_windows(_docs(spark, sf_dir)).select("doc_id", "layer", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(r"""SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS pieces FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\n([一二三四五六七八九十]、|\d+\.|[A-Z]\.)', chr(10) || chr(10) || '\1', 'g'), '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""")
def paragraphs(spark, sf_dir):
    p = _docs(spark, sf_dir).select("doc_id", tx.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("pieces"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)) AS l FROM documents),
p AS (SELECT doc_id, l, 1 AS i, l[1] AS held, 0 AS k FROM l WHERE len(l) > 0 UNION ALL
  SELECT doc_id, l, i + 1, CASE WHEN held + l[i + 1] + 2 <= 800 THEN held + l[i + 1] + 2 ELSE l[i + 1] END, CASE WHEN held + l[i + 1] + 2 <= 800 THEN k ELSE k + 1 END FROM p WHERE i < len(l))
SELECT doc_id, k AS chunk_index, max(held)::INTEGER AS chunk_size FROM p GROUP BY doc_id, k""")
def packed_paragraphs(spark, sf_dir):
    """Lines packed into blocks of up to 800 characters."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = _docs(spark, sf_dir).select("doc_id", chunking.pack_paragraphs(lines, 800).alias("chunks"))
    return chunking.as_rows(d).select("doc_id", "chunk_index", "chunk_size")


@query()
def recursive_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("doc_type", F.lit("text"))
    return chunking.recursive_chunks(d).select("doc_id", "chunk_index", "chunk_size", "chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def semantic_chunks(spark, sf_dir):
    return chunking.semantic_chunks(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_size", "chunk_id")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'json' ELSE 'text' END AS doc_type, CASE page_id % 4 WHEN 0 THEN 700 WHEN 1 THEN 700 WHEN 2 THEN 650 ELSE 750 END AS chunk_size, CASE page_id % 4 WHEN 2 THEN 100 ELSE 120 END AS overlap FROM pages""")
def chunk_profiles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("page."), F.element_at(F.array(*map(F.lit, ("html", "MD", "jsonl", "csv"))), (F.col("page_id") % 4 + 1).cast("int")))
    return chunking.with_profile(p.select("page_id", chunking.document_type(name).alias("doc_type")))


_BREAK = tx.TOKEN_BREAK.removeprefix("(?U)")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(source: str, key: str, text: str) -> str:
    """Rows (key, token, place) of the distinct tokens."""
    return f"""SELECT {key}, token, min(i) AS place FROM (SELECT {key}, lower(trim(p[i])) AS token, i FROM (SELECT {key}, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT {key}, regexp_split_to_array({text}, '{_BREAK}') AS p FROM {source})))
  WHERE token <> '' AND token NOT IN ({_STOP}) AND (length(token) > 1 OR regexp_matches(token, '^[一-鿿]+$')) GROUP BY {key}, token"""


@query(f"WITH t AS ({tokens_sql('documents', 'doc_id', 'text')}) SELECT d.doc_id, count(token) AS n, md5(coalesce(string_agg(token, ' ' ORDER BY place), '')) AS tokens_md5 FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id")
def tokenize(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"""WITH t AS ({tokens_sql('benchmark', 'item_id', 'text')}), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id)
SELECT item_id, floor(greatest(10 * 4, 50) * least(1.8, greatest(1.0, 1.0 + CASE WHEN n >= 10 THEN 0.5 WHEN n >= 6 THEN 0.25 ELSE 0 END + CASE WHEN n >= 6 THEN 0.2 ELSE 0 END)))::INTEGER AS hybrid_k, least(120, greatest(30, round_even(5 * 8 * greatest(0.85, least(1.6, 800.0::DOUBLE / greatest(200, 500 + item_id))), 0)))::INTEGER AS vector_k, n >= 6 AS complex FROM n""")
def recall_k(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", tx.hybrid_recall(F.col("text"), F.lit(10)).alias("hybrid_k"), tx.vector_recall(F.lit(5), 500 + F.col("item_id")).alias("vector_k"), tx.is_complex(F.col("text")).alias("complex"))


@query(f"""WITH t AS ({tokens_sql('benchmark', 'item_id', 'text')}), j AS (SELECT item_id, string_agg(token, ' ' ORDER BY place) AS joined FROM t GROUP BY item_id),
v AS (SELECT b.item_id, unnest([trim(text), regexp_replace(trim(text), '\\s+', ' ', 'g'), joined, joined || ' 定义 作用 场景']) AS form, unnest([0, 1, 2, 3]) AS i FROM benchmark b JOIN j ON b.item_id = j.item_id),
f AS (SELECT item_id, form, min(i) AS i FROM v GROUP BY item_id, form), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM f)
SELECT item_id, (place - 1)::INTEGER AS place, form FROM r WHERE place <= 3""")
def query_variants(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.posexplode(tx.variants(F.col("text"), intent=True)).alias("place", "form"))


def codes_sql(text: str) -> str:
    """The codes of a text, as a list. RE2's \\b knows ASCII words only and it has no look-around: each letter or digit of another
    script becomes two underscores first, which are of a word and in no code."""
    whole = rf"regexp_replace(coalesce({text}, ''), '[^\P{{L}}\x00-\x7F]|[^\P{{N}}\x00-\x7F]', '__', 'g')"
    forms = (r"(\b[a-zA-Z]{1,4}[\t-\r ]*[-_/]?[\t-\r ]*\d{2,10}[a-zA-Z]{0,2}\b)", r"(\b\d{2,10}[a-zA-Z]{1,4}\b)")
    return f"list_concat({', '.join(f"regexp_extract_all({whole}, '{form}', 1)" for form in forms)})"


@query(f"""WITH m AS (SELECT doc_id, list_distinct(list_transform({codes_sql('text')}, lambda x: trim(x))) AS codes FROM documents)
SELECT doc_id, len(codes) AS n, array_to_string(list_sort(codes), '|') AS codes FROM m""")
def code_entities(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", tx.code_entities(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.array_join(F.array_sort("c"), "|").alias("codes"))


@query(r"""SELECT s_suppkey, regexp_replace(lower(trim(s_name)), '[\s\-_/\\|·•,，。！？!?:：;；''"“”‘’()（）\[\]{}<>《》、]+', '', 'g') AS lookup_key, CASE WHEN regexp_matches(s_name, '\b[a-zA-Z]{1,4}\s*[-_/]?\s*\d{2,10}[a-zA-Z]{0,2}\b') THEN 2 WHEN length(s_name) <= 8 THEN 3 ELSE 5 END AS min_length FROM supplier""")
def lookup_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", tx.lookup_key(F.col("s_name")).alias("lookup_key"), tx.min_extraction_length(F.col("s_name")).alias("min_length"))


BM25_SQL = r"""cw AS (SELECT 'docs' AS kb_id, doc_id::VARCHAR AS chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '') AS words FROM documents),
tf AS (SELECT kb_id, chunk_id, token, count(*) AS tf, any_value(length) AS length FROM (SELECT kb_id, chunk_id, len(words) AS length, unnest(words) AS token FROM cw) GROUP BY ALL),
st AS (SELECT kb_id, count(*) AS n, avg(len(words)) AS mean FROM cw GROUP BY kb_id), df AS (SELECT kb_id, token, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, 'docs' AS kb_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS token FROM benchmark),
bm AS (SELECT query_id, kb_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS ft_score FROM qt JOIN tf USING (kb_id, token) JOIN df USING (kb_id, token) JOIN st USING (kb_id) GROUP BY ALL)"""


@query(f"WITH {BM25_SQL} SELECT query_id, kb_id, chunk_id, ft_score FROM bm")
def bm25(spark, sf_dir):
    return keyword.bm25(text_queries(spark, sf_dir), text_chunks(spark, sf_dir))


@query(f"WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ft_score DESC, chunk_id) AS r FROM bm) SELECT query_id, kb_id, chunk_id, ft_score FROM r WHERE r <= 10")
def bm25_top(spark, sf_dir):
    """The best ten by pruned postings."""
    q, c = text_queries(spark, sf_dir), text_chunks(spark, sf_dir)
    return keyword.bm25_top(q, keyword.impacts(c, q), 10)


@query(f"WITH t AS ({tokens_sql('benchmark', 'item_id', 'text')}) SELECT DISTINCT item_id AS query_id, 'docs' AS kb_id, doc_id::VARCHAR AS chunk_id FROM t JOIN documents ON contains(lower(text), token)")
def keyword_contains(spark, sf_dir):
    return keyword.containing(text_queries(spark, sf_dir), text_chunks(spark, sf_dir))


SCORE_SQL = f"""t AS ({tokens_sql('benchmark', 'item_id', 'text')}), nt AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ft_score DESC, chunk_id) AS r FROM bm),
cand AS (SELECT query_id, chunk_id, ft_score, lower(text) AS low, length(text) AS len FROM best JOIN documents ON chunk_id = doc_id::VARCHAR WHERE r <= 80),
hit AS (SELECT query_id, chunk_id, any_value(ft_score) AS ft, any_value(len) AS len, any_value(n) AS n, count(*) FILTER (c > 0) AS hits, sum(least(3, c)) AS tf FROM (
  SELECT query_id, chunk_id, ft_score, len, n, (length(low) - length(replace(low, token, ''))) // length(token) AS c FROM cand JOIN t ON t.item_id = query_id JOIN nt ON nt.item_id = query_id) GROUP BY query_id, chunk_id),
raw AS (SELECT *, (0.7 * hits / n + 0.3 * (tf / (tf + 2.0::DOUBLE))) * greatest(0.6, least(1.0, 300.0::DOUBLE / greatest(300, len))) AS x FROM hit WHERE hits > 0),
mixed AS (SELECT query_id, chunk_id, CASE WHEN ft > 0 THEN x * 0.75 + least(1.0, ft / (ft + 5.0)) * 0.25 ELSE x END AS x FROM raw),
scored AS (SELECT query_id, chunk_id, round(x / max(x) OVER (PARTITION BY query_id), 6) AS score FROM mixed),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM scored)"""


@query(f"WITH {BM25_SQL}, {SCORE_SQL} SELECT query_id, 'docs' AS kb_id, chunk_id, score, rank FROM kw WHERE rank <= 10")
def keyword_score(spark, sf_dir):
    return keyword.search(text_queries(spark, sf_dir), text_chunks(spark, sf_dir), 10)


FRAGMENTS_SQL = """(SELECT item_id, substr(w, 2, 7) AS text FROM (SELECT item_id, regexp_extract(text, '[a-z]{9,}') AS w FROM benchmark) WHERE length(w) >= 9)"""


@query(f"""WITH {BM25_SQL.replace('FROM benchmark', 'FROM ' + FRAGMENTS_SQL)}, f AS {FRAGMENTS_SQL}, bare AS (SELECT item_id AS query_id, text AS token FROM f WHERE item_id NOT IN (SELECT query_id FROM bm)),
cand AS (SELECT query_id, chunk_id, ft_score, token, lower(d.text) AS low, length(d.text) AS len FROM (
  SELECT bm.query_id, chunk_id, ft_score, f.text AS token, row_number() OVER (PARTITION BY bm.query_id ORDER BY ft_score DESC, chunk_id) AS r FROM bm JOIN f ON item_id = query_id) x JOIN documents d ON x.chunk_id = d.doc_id::VARCHAR WHERE r <= 80
  UNION ALL SELECT query_id, doc_id::VARCHAR, 0, token, lower(text), length(text) FROM bare JOIN documents ON contains(lower(text), token)),
hit AS (SELECT *, least(3, (length(low) - length(replace(low, token, ''))) // length(token)) AS tf FROM cand),
raw AS (SELECT *, (0.7 + 0.3 * (tf / (tf + 2.0::DOUBLE))) * greatest(0.6, least(1.0, 300.0::DOUBLE / greatest(300, len))) AS x FROM hit WHERE tf > 0),
mixed AS (SELECT query_id, chunk_id, CASE WHEN ft_score > 0 THEN x * 0.75 + least(1.0, ft_score / (ft_score + 5.0)) * 0.25 ELSE x END AS x FROM raw),
scored AS (SELECT query_id, chunk_id, round(x / max(x) OVER (PARTITION BY query_id), 6) AS score FROM mixed),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM scored)
SELECT query_id, 'docs' AS kb_id, chunk_id, score, rank FROM kw WHERE rank <= 10""")
def keyword_fragments(spark, sf_dir):
    """Seven letters from inside a word of each benchmark passage as queries: those that are no word themselves are found as parts."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("docs").alias("kb_id"), F.regexp_extract("text", "([a-z]{9,})", 1).alias("w"))
    q = b.where(F.length("w") >= 9).select("query_id", "kb_id", F.substring("w", 2, 7).alias("query_text"))
    return keyword.search(q, text_chunks(spark, sf_dir), 10)


@query(f"""WITH {BM25_SQL}, {SCORE_SQL}, r AS (SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
total AS (SELECT item_id AS query_id, greatest(1, count(chunk_id)) AS total FROM benchmark LEFT JOIN r ON item_id = query_id GROUP BY item_id),
h AS (SELECT kw.query_id, rank, r.chunk_id IS NOT NULL AS hit FROM kw LEFT JOIN r USING (query_id, chunk_id) WHERE rank <= 10),
g AS (SELECT query_id, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY query_id)
SELECT query_id, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(total, 10)::INTEGER + 1) x(i)), 6) AS ndcg FROM total LEFT JOIN g USING (query_id)""")
def keyword_relevance(spark, sf_dir):
    """How well keyword search finds the documents that hold a benchmark passage."""
    q, c = text_queries(spark, sf_dir), text_chunks(spark, sf_dir)
    # the labels are keys alone, so no content is looked at
    found = keyword.search(q, c, 10).withColumns({"key": F.col("chunk_id"), "content": F.lit(None).cast("string")})
    holds = _holders(q, c)
    rel = q.select("query_id").join(holds.groupBy("query_id").agg(F.collect_list("chunk_id").alias("keys"), F.count(F.lit(1)).alias("total")), "query_id", "left")
    rel = rel.select("query_id", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), F.array().cast("array<string>").alias("keywords"), F.coalesce("total", F.lit(1)).alias("total"))
    hits = evaluate.label_hits(found, rel.drop("total"), 10)
    return evaluate.ir_metrics(hits.select("query_id", "rank", "hit"), rel.select("query_id", "total"), 10)


#: Rows that short query texts are packed into; words of a query text that its mark takes at most.
PACKS, MARKED = 64, 4


def _holders(queries, chunks):
    """Which chunks contain a whole query text, of any length.

    The words between a text's first and last one stand whole in a chunk that contains it: both meet on a hash of the first four of
    them, or as many as there are, then that is checked. A text of fewer than three words may lie inside a word or between two:
    every chunk is searched for these, packed in a few rows, and nothing but what is found is exchanged.
    """
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    at = lambda w, i, m: F.xxhash64(F.slice(w, i, m))
    n = F.size("w")
    q = queries.where("query_text is not null and kb_id is not null").withColumn("w", words(F.col("query_text")))
    long = q.where(n > 2).withColumn("m", F.least(F.lit(MARKED), n - 2)).withColumn("mark", at(F.col("w"), F.lit(2), F.col("m"))).select("query_id", "kb_id", "query_text", "m", "mark")
    long = settled(long, "long")
    sizes = [r["m"] for r in long.select("m").distinct().collect()]  # numbers up to MARKED
    runs = lambda m: F.transform(F.when(n >= m, F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>")), lambda i: at(F.col("w"), i, F.lit(m)))
    marks = F.array_distinct(F.flatten(F.array(*map(runs, sizes)))) if sizes else F.array().cast("array<bigint>")
    marked = chunks.select("kb_id", "chunk_id", words(F.col("content")).alias("w")).select("kb_id", "chunk_id", F.explode(marks).alias("mark"))
    pairs = settled(among(marked, long, ["kb_id", "mark"]).join(long.select("query_id", "kb_id", "mark"), ["kb_id", "mark"]), "marked")
    met = among(chunks.select("kb_id", "chunk_id", "content"), pairs, ["kb_id", "chunk_id"]).join(pairs, ["kb_id", "chunk_id"]).join(long.select("query_id", "query_text"), "query_id")
    found = met.where(F.contains("content", "query_text")).select("query_id", "chunk_id")
    packs = q.where(n < 3).groupBy(F.pmod(F.xxhash64("query_id"), F.lit(PACKS)).alias("pack")).agg(F.collect_list(F.struct("query_id", "kb_id", "query_text")).alias("asked"))
    inside = F.filter("asked", lambda x: (x["kb_id"] == F.col("kb_id")) & F.contains(F.col("content"), x["query_text"]))
    short = chunks.select("kb_id", "chunk_id", "content").crossJoin(packs.select("asked")).select("chunk_id", F.explode(inside).alias("x")).select("x.query_id", "chunk_id")
    return found.unionByName(short).distinct()


@query(f"""WITH {BM25_SQL}, {SCORE_SQL.replace('r <= 80', 'r <= 400')}, few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'chunk::' || chunk_id) AS r FROM kw WHERE rank <= 50),
f AS (SELECT query_id, 'chunk::' || chunk_id AS key, chunk_id, round(0.5 / (60 + r), 8) AS fs FROM few),
m AS (SELECT *, min(fs) OVER (PARTITION BY query_id) AS lo, max(fs) OVER (PARTITION BY query_id) AS hi FROM f),
ct AS (SELECT doc_id, count(DISTINCT token) AS own, item_id FROM (SELECT d.doc_id, d.token, t.item_id FROM ({tokens_sql('documents', 'doc_id', 'text')}) d JOIN t ON d.token = t.token) GROUP BY doc_id, item_id),
o AS (SELECT m.*, coalesce(own, 0) / n AS ov FROM m JOIN nt ON nt.item_id = query_id LEFT JOIN ct ON ct.doc_id::VARCHAR = chunk_id AND ct.item_id = query_id),
s AS (SELECT *, 0.7 * CASE WHEN hi <= lo THEN 1 ELSE (fs - lo) / (hi - lo) END + 0.3 * ov AS x FROM o),
fin AS (SELECT query_id, key, round(greatest(0, least(1, CASE WHEN ov < 0.05 THEN x * 0.68 ELSE x END)), 6) AS final_score FROM s),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, key)::INTEGER AS rank FROM fin)
SELECT query_id, key, final_score, 'keyword' AS channels, 'keyword' AS source, rank FROM top WHERE rank <= 5""")
def hybrid_keyword_search(spark, sf_dir):
    """The hybrid pipeline with its keyword channel alone, over documents."""
    found = retrieval.hybrid_search(text_queries(spark, sf_dir), text_chunks(spark, sf_dir), 5, channels=("keyword",))
    return found.select("query_id", "key", "final_score", "channels", "source", "rank")


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'human') THEN '### Human:' || chr(10) WHEN lower(role) IN ('assistant', 'gpt') THEN '### Assistant:' || chr(10) END || text AS line FROM conversations WHERE trim(text) <> '')
SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn, line) AS text FROM l WHERE line IS NOT NULL GROUP BY conv_id""")
def conversation_text(spark, sf_dir):
    return datasets.conversation_text(table(spark, sf_dir, "conversations"))


HISTORY_SQL = """hist AS (SELECT * FROM conversations WHERE conv_id % 5 <> 0),
last4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM hist),
summ AS (SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END, chr(10) ORDER BY turn) AS summary FROM last4 WHERE p <= 4 GROUP BY conv_id)"""


def _history(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id % 5 <> 0")


@query(f"WITH {HISTORY_SQL} SELECT conv_id, summary FROM summ")
def history_summary(spark, sf_dir):
    return datasets.history_summary(_history(spark, sf_dir))


def _filled_sql(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name in ("summary", "context", "query"):
        out = f"replace({out}, '{{{name}}}', {name})" if f"{{{name}}}" in template else out
    return out


@query(f"""WITH {HISTORY_SQL}, asked AS (SELECT DISTINCT conv_id, 'what about ' || conv_id AS query, CASE WHEN conv_id % 3 <> 0 THEN 'passage ' || conv_id ELSE '' END AS context, CASE WHEN conv_id % 2 = 0 THEN 'be brief' END AS system FROM conversations),
k AS (SELECT asked.*, summary FROM asked LEFT JOIN summ USING (conv_id)),
m AS (SELECT conv_id, 0 AS part, 0 AS turn, 'system' AS role, CASE WHEN summary IS NOT NULL THEN coalesce(system, '{datasets.DEFAULT_SYSTEM}') || '{datasets.HISTORY_RULE}' ELSE system END AS content FROM k UNION ALL
  SELECT conv_id, 1, turn, role, text FROM hist UNION ALL
  SELECT conv_id, 2, 0, 'user', CASE WHEN context <> '' AND summary IS NOT NULL THEN {_filled_sql(datasets.WITH_HISTORY)} WHEN context <> '' THEN {_filled_sql(datasets.WITH_CONTEXT)} ELSE query END FROM k)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn)::INTEGER AS place, role, content FROM m WHERE part = 1 OR content IS NOT NULL""")
def prompt_messages(spark, sf_dir):
    c, conv = table(spark, sf_dir, "conversations").select("conv_id").distinct(), F.col("conv_id").cast("string")
    asked = c.select("conv_id", F.concat(F.lit("what about "), conv).alias("query"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("passage "), conv)).otherwise("").alias("context"), F.when(F.col("conv_id") % 2 == 0, "be brief").alias("system"))
    return datasets.prompt_messages(asked, _history(spark, sf_dir))


_PAIRS_SQL = "WITH p AS (SELECT a.conv_id, a.turn, a.text AS instruction, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return a.join(b, ["conv_id", "turn"])


@query("SELECT CASE WHEN count(*) > 0 THEN 'conversation' END AS format FROM conversations")
def dataset_format(spark, sf_dir):
    none, c = F.lit(None).cast("string"), table(spark, sf_dir, "conversations")
    return datasets.dataset_format(c.select("conv_id", datasets.record_format(none, none, F.col("text")).alias("format")), "conv_id")


@query(f"{_PAIRS_SQL} SELECT conv_id, turn, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text FROM p")
def alpaca_text(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", datasets.alpaca_text(F.col("instruction"), F.lit(""), F.col("output")).alias("text"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role NOT IN ('user', 'assistant', 'system')) AS bad, count(*) FILTER (trim(text) = '') AS blank FROM conversations GROUP BY conv_id)
SELECT count(*) FILTER (bad > 0 OR blank > 0) = 0 AND count(*) BETWEEN 1 AND 10000 AS valid, 'conversation' AS format, count(*) AS samples, count(*) FILTER (bad > 0 OR blank > 0) AS failed,
coalesce((SELECT string_agg(conv_id || ': ' || CASE WHEN bad > 0 AND blank > 0 THEN 'role,content' WHEN bad > 0 THEN 'role' ELSE 'content' END, '; ' ORDER BY conv_id) FROM (SELECT * FROM c WHERE bad > 0 OR blank > 0 ORDER BY conv_id LIMIT 10)), '') || CASE WHEN count(*) FILTER (bad > 0 OR blank > 0) > 10 THEN '; ...' ELSE '' END AS first_errors FROM c""")
def dataset_report(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    rows = rows.select("conv_id", datasets.record_format(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("m")).alias("format"), datasets.conversation_errors(F.col("m")).alias("errors"))
    return datasets.report(rows, "conv_id")


@query(f"{_PAIRS_SQL} SELECT conv_id, turn, 'alpaca' AS format, CASE WHEN trim(instruction) = '' THEN 'instruction' ELSE '' END || CASE WHEN trim(output) = '' THEN 'output' ELSE '' END AS errors FROM p")
def alpaca_validation(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", datasets.record_format(F.col("instruction"), F.col("output"), F.lit(None).cast("array<string>")).alias("format"), F.array_join(datasets.alpaca_errors(F.col("instruction"), F.lit(""), F.col("output")), "").alias("errors"))


@query()
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.html_to_text("html").alias("text"))


@query("SELECT event_id, 'k: ' || (props->>'k') AS text FROM events")
def json_record_text(spark, sf_dir):
    """Event properties rendered as JSON files are."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", files.render(F.col("props").cast("binary"), F.lit("json")).alias("text"))
