"""The ten operators and the pipeline against plain versions, on small tables with nulls, empty and repeated rows, ties, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import same, tables
from pyspark.sql import functions as F

from quarrymill.llm import bpe, chat, components, langid, line_dedup, mixing, near_dedup, oracles, quality, queries, topk, toxicity, unigram

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string, node string, key string"
RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 7))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def changed(rng, text, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split(" "))


def small_docs(spark, extra=()):
    """Copies, near copies at every distance, blanks, nulls, repeated rows, one long text, in a table with clashing columns."""
    rng = random.Random(1)
    base = prose(rng, 120)
    texts = [base, base, base.upper(), base + "\n" + base, None, "", "  \n\t ", "a", "a b", "a b", "A B c", prose(rng, 30_000), "\n\n\n", "é ñ \U0001f600 漢字", base.replace(" ", "\n")]
    texts += [changed(rng, base, s / 200) for s in range(40)] + [prose(rng, 50) for _ in range(20)]
    texts += list(extra)
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", "", None][i % 4], len(t or ""), "x", "y", "z", "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, base, "en", "s0", 1, "x", "y", "z", "k"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(items, similar):
    parent = {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(items)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if similar(items[i], items[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def alike(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup_is_exact(spark, k):
    docs = small_docs(spark)
    sets = {r["doc_id"]: shingle_set(r["text"], k) for r in docs.collect() if r["doc_id"] is not None}
    wanted = brute_components(sets, alike)
    rows = near_dedup.near_duplicates(docs, words=k).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), wanted[r["doc_id"]], wanted[r["doc_id"]] == r["doc_id"])
    kept = near_dedup.keep_one(docs, words=k)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({i for i in wanted if wanted[i] == i})


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_duplicates(small_docs(spark).limit(0)).count() == 0


def test_buckets_stream(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted(((rng.randrange(40) ** 2, rng.randrange(60)) for _ in range(400)), key=lambda r: r[0])
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + size]], pa.int64()) for c in (0, 1)], ["key", "node"]) for i in range(0, len(rows), size)]
        got = {(k, n) for out in components._shared(iter(batches)) for k, n in zip(out.column("key").to_pylist(), out.column("node").to_pylist())}
        held = {}
        for k, n in rows:
            held.setdefault(k, set()).add(n)
        assert got == {(k, n) for k, own in held.items() if len(own) > 1 for n in own}


def test_a_large_group_of_near_lines_gives_few_candidates(spark):
    """5000 near lines: candidates and pairs of blocks grow with the group, and all end up in one component."""
    base = prose(random.Random(7), 60).split(" ")
    lines = [" ".join([*base[:30], f"w{i}", *base[30:]]) for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    bands = docs.mapInArrow(lambda it: line_dedup._bands(it, line_dedup.BANDS, line_dedup.ROWS, line_dedup.SHINGLE), "node long, key long")
    shared = components.buckets(bands)
    assert components.stars(shared).count() <= line_dedup.BANDS * 5000
    assert {r["first_doc_id"] for r in line_dedup.repeated_lines(docs).collect()} == {0}


def test_ids_of_any_size_and_shared_ids(spark):
    line = prose(random.Random(8), 40)
    rows = [(2**61, line, "a"), (-(2**62), line, "b"), (7, line, "c"), (7, "own words of the other text\n" + line, "d"), (7, line, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumns({"_dropped": F.lit(1), "_mark": F.lit(2)})
    edited = line_dedup.edit_documents(docs)
    assert edited.columns == docs.columns
    assert {(r["_id"], r["text"]) for r in edited.collect()} == {("b", line), ("d", "own words of the other text")}


def test_clashing_columns(spark):
    docs = small_docs(spark).withColumns({c: F.lit(c) for c in ("_gone", "_order", "_id", "_row", "_source", "_size", "_times", "_copy")})
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    renamed = docs.withColumns({"n_tokens": F.lit("x"), "ids_sha256": F.lit("y"), "wanted": F.lit("z")})
    assert bpe.digests(renamed, queries.tokenizer("word_bpe_49k.json")).count() == docs.count()
    assert unigram.token_counts(renamed, [("<unk>", 0.0), ("a", -1.0)]).count() == docs.count()


def test_empty_tables(spark):
    docs = small_docs(spark).limit(0)
    assert langid.identify(docs).count() == 0 and quality.quality(docs).count() == 0
    assert unigram.token_counts(docs, [("<unk>", 0.0), ("a", -1.0)]).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert toxicity.keep_clean(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_repeated_rows_are_encoded_alike(spark):
    docs = small_docs(spark).where("doc_id < 9")
    twice = docs.union(docs)
    for of in (lambda d: bpe.digests(d, queries.tokenizer("word_bpe_49k.json")), lambda d: unigram.token_counts(d, [("<unk>", 0.0), ("a", -1.0), ("b", -2.0)])):
        once = Counter(map(str, of(docs).collect()))
        assert Counter(map(str, of(twice).collect())) == Counter({k: 2 * n for k, n in once.items()})


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    rows += [(0, rows[0][1]), (20, [float(x) for x in rng.normal(size=4)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q in (0, 20):
        asked = min((v.tolist() for i, v in whole if i == q))
        assert got[q] == [(-s, v) for s, v in sorted((-int(np.array(asked) @ x), v) for v, x in whole if v != q)][:10]


def test_top_k_meets_in_groups_and_broadcasts_nothing(spark, monkeypatch):
    """Many lots and parts, vectors of two lengths: the result of all pairs, without copies of the queries in a broadcast."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "PART", 5, raising=False)
    monkeypatch.setattr(topk, "LOT", 2, raising=False)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=3 + i % 2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    made = topk.top_k(df, df.where("vec_id % 4 = 0"), 6)
    got = {}
    for r in made.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    score = lambda a, b: int(sum(1024 * x * 1024 * y for x, y in zip(a, b)))
    for q, v in rows[::4]:
        assert got[q] == [(-s, i) for s, i in sorted((-score(v, x), i) for i, x in rows if i != q and len(x) == len(v))][:6]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Broadcast" not in plan


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (300, 200), (300, 100)], "a long, b long")
    assert {r["label"] for r in components.components(links).where("node <= 60").collect()} == {0}
    assert {r["label"] for r in components.components(links).where("node >= 100").collect()} == {100}


def line_sets(rows):
    out = {}
    for r in rows:
        if r["doc_id"] is not None:
            for i, line in enumerate((r["text"] or "").split("\n")):
                if line.strip(" \t\n\v\f\r"):
                    out[(r["doc_id"], i)] = {line[j : j + 8] for j in range(max(1, len(line) - 7))} if len(line) >= 8 else {line}
    return out


@pytest.mark.parametrize("small", [128, 2])
def test_line_dedup_is_exact(spark, monkeypatch, small):
    """small = 2 deals every bucket out in many blocks."""
    monkeypatch.setattr(components, "BLOCK", small)
    rng = random.Random(2)
    line = prose(rng, 40)
    many = ["\n".join(changed(rng, line, s / 150) for s in range(k, k + 6)) for k in range(0, 30, 3)]
    docs = small_docs(spark, [*many, "short\nshort\nshor", f"{line}\n\n{line}", f"{line}\nown words here"]).where("length(text) < 100000 or text is null")
    rows = docs.collect()
    wanted = brute_components(line_sets(rows), alike)
    gone = {(r["doc_id"], r["position"]) for r in line_dedup.repeated_lines(docs).collect()}
    assert gone == {i for i in wanted if wanted[i] != i}
    for r in line_dedup.dedup_lines(docs).collect():
        source = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        if r["doc_id"] is not None and source is not None:
            assert r["text"] == "\n".join(x for i, x in enumerate(source.split("\n")) if (r["doc_id"], i) not in gone)
    edited = line_dedup.edit_documents(docs)
    assert edited.columns == docs.columns
    left = {r["doc_id"]: r for r in edited.collect()}
    assert None in left and 4 in left and 5 in left and 1 not in left  # nulls and blanks stay, a copy goes
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.values() if r["n_chars"] is not None and r["doc_id"] is not None)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_python_and_spark_hash_lines_alike(spark):
    import xxhash

    lines = ["a", "é漢\U0001f600", "x" * 1000, "tail \r"]
    got = [r["h"] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(F.xxhash64("t").alias("h")).collect()]
    assert got == [int(np.array(xxhash.xxh64_intdigest(x.encode(), 42), np.uint64).view(np.int64)) for x in lines]


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), tables(SF).execute(oracles.ORACLE_SQL[name]).df())


def test_mixing(spark):
    docs = small_docs(spark)
    rows = mixing.repeats(docs).collect()
    again = mixing.repeats(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sum({(r["source_size"], r["target"]) for r in rows} and [t for _, t in {(r["source_size"], r["target"]) for r in rows}]) == pytest.approx(sum(r["size"] for r in rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.repeats(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def plain_mix(rows):
    """How often each (doc_id, source, size) is taken, all its rows together, by loops over lists; how often a row is at least."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")), md5(f"17:{r['doc_id'] if r['doc_id'] is not None else md5(r['text'] or '')}")[:16]) for r in rows]
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    target, free, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        level = free / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3.0 * sizes[s] <= weight[s] * level}
        target |= {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in open_}
        free, open_ = free - sum(target[s] for s in full), open_ - full
        if not full or not open_:
            break
    whole = {s: int(target[s] // sizes[s]) if sizes[s] else 0 for s in names}
    taken = Counter()
    for s in names:
        rest, left = target[s] - whole[s] * sizes[s], []
        for doc, x, n, draw in rows:
            if x == s:
                taken[(doc, s, n)] += whole[s]
                left.append((draw, doc is not None, doc or 0, n))
        left.sort()
        for _ in range(3):
            total, over, limit = 0, [], rest
            for x in [x for x in left if 0 < limit and x[3] <= limit]:
                total += x[3]
                if total <= limit:
                    taken[(x[2] if x[1] else None, s, x[3])] += 1
                    rest -= x[3]
                else:
                    over.append(x)
            left = over
    return +taken, whole


def with_null_ids(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 else i, prose(rng, 15 + rng.randrange(12)), "en", f"s{i % 7 % 4}" if i % 7 else None) for i in range(120)]
    rows += [(7000, prose(rng, 20), "en", "s1") for _ in range(5)] + [(None, None, "en", "s1"), rows[1], rows[1]]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "k") for r in rows], DOCS)


@pytest.mark.parametrize("make", [small_docs, with_null_ids])
def test_mix_takes_every_row_as_planned(spark, make):
    rows = [r.asDict() for r in make(spark).collect()]
    wanted, whole = plain_mix(rows)
    assert any(doc is None and n for doc, _, n in wanted)
    mixed = [r.asDict() for r in mixing.mix(make(spark)).collect()]
    assert Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mixed) == wanted
    given, got = Counter(map(str, rows)), Counter(map(str, mixed))
    assert set(got) <= set(given)
    for r in rows:
        assert whole[r["source"]] <= got[str(r)] / given[str(r)] <= whole[r["source"]] + 1
    repeats = mixing.repeats(make(spark)).collect()
    assert sum(r["taken"] for r in repeats) == sum(len(WORD.findall(r["text"] or "")) for r in mixed)


def test_rows_without_ids_fall_into_many_slices(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "s") for i in range(1000)] + [(None, "same", "s")] * 500, "doc_id long, text string, source string")
    groups = mixing.drawn(docs).groupBy("draw").count().collect()
    assert len(groups) == 1001 and len({r["draw"][: mixing.SLICE_DIGITS] for r in groups}) > 800
    assert mixing.planned(docs).count() == 1001  # copies are one row with a number


def test_repeated_rows_come_back_in_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOT", 3)
    docs = spark.createDataFrame([(1, "a b", "s")] * 10 + [(2, "c", "t")] * 7, "doc_id long, text string, source string")
    rows = mixing.repeats(docs).collect()
    assert len(rows) == 17 and Counter(r["doc_id"] for r in rows) == {1: 10, 2: 7}
    assert mixing.mix(docs).count() == sum(r["times"] for r in rows)


def test_water_filling_clamps_and_reshares(spark):
    table = spark.createDataFrame([("a", 10, 5, 1), ("b", 100, 2, 2), ("c", 1000, 1, 3)], "source string, source_size long, weight int, place int")
    got = {r["source"]: r["target"] for r in mixing.water_fill(table).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": pytest.approx(780.0)}


def test_quality_edges(spark):
    docs = small_docs(spark, ["# | # | " * 60, "the of and " * 40, "the " + prose(random.Random(3), 80)])
    rows = {}
    for r in quality.quality(docs).collect():
        rows.setdefault(r["doc_id"], r)
    for d in docs.where("doc_id is not null").collect():
        words = WORD.findall(d["text"] or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
        lines = [x for x in (d["text"] or "").split("\n") if WORD.search(x)]
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["kept"] and r["base_failed"])
    assert "Python" not in quality.quality(docs)._jdf.queryExecution().executedPlan().toString()


def test_top_k_edges(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id long, embedding array<float>, score string")
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q in (i for i in whole if i % 20 == 0):
        assert got[q] == [(-s, v) for s, v in sorted((-int(whole[q] @ x), v) for v, x in whole.items() if v != q)][:10]
    assert topk.top_k(df.limit(0), df.limit(0), 10).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 10).count() == 2


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    odd = langid.identify(small_docs(spark)).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd if r["doc_id"] in (4, 5, 6, 12))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in odd)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in odd if r["doc_id"] is not None)
    nothing = small_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(nothing).collect()} == {"und"}


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney over 4-grams with a cut-off of two, by dictionaries: a function of a gram."""
    counts = {4: Counter()}
    for text in texts:
        symbols = []
        for char in text:
            code = ord(char.lower()[0]) if unicodedata.category(char)[0] in "LM" else 0
            if code or (symbols and symbols[-1]):
                symbols.append(code)
        padded = [0, 0, 0, *symbols]
        counts[4].update(tuple(padded[i : i + 4]) for i in range(len(symbols)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        one, two = (sum(n == i for n in counts[k].values()) for i in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.95) if one + two else 0.5

    d = {k: discount(k) for k in counts}

    def probability(gram):
        if not gram:
            return 1 / 65536
        after = {g: n for g, n in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return probability(gram[1:])
        own = {g: max(n - d[len(gram)], 0) for g, n in after.items() if len(gram) < 4 or n >= 2}
        return own.get(gram, 0) / total + (1 - sum(own.values()) / total) * probability(gram[1:])

    return probability


def test_kneser_ney_equals_plain_version(spark):
    texts = {"en": ["the cat sat on the mat, and the dog sat on the log", "the cat ran to the other mat"], "ru": ["кот сидел на коврике и собака сидела", "кот кот коврик"], "zh": ["我喜欢喝茶，你喜欢喝茶", "喝茶"]}
    model = langid.fit(spark.createDataFrame([(t, lang) for lang, own in texts.items() for t in own], "text string, lang string"))
    assert model.langs == sorted(texts)
    for text in [t for own in texts.values() for t in own] + ["zebra кот 喜欢 the xx \U0001d400"]:
        raw = text.encode()
        codes, _, _ = langid.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for code, logs in zip(codes.tolist(), model.logs(codes)):
            gram = tuple((code >> (16 * j)) & 0xFFFF for j in (3, 2, 1, 0))
            for lang, log in zip(model.langs, logs):
                assert np.exp(log) == pytest.approx(plain_kneser_ney(texts[lang])(gram), abs=1e-6)


def test_every_text_teaches_and_long_ones_calibrate(spark):
    """Each text has a letter of its own, which the model knows, and texts of any length set the limits."""
    rows = [(i, chr(0x4E00 + i) + " one two three four" * 5300, "en") for i in range(60)] + [(100 + i, chr(0x5E00 + i) + " eins zwei drei", "de") for i in range(60)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = {int(g) & 0xFFFF for g in model.levels[1].grams}
    assert {ord(text[0]) for _, text, _ in rows} <= known
    assert np.isfinite(model.limits).all()


def test_languages_of_one_script_are_told_apart(spark):
    words = {
        "ru": "этот большой дом стоит у старой реки где вода всегда быстрая и холодная",
        "uk": "цей великий будинок стоїть біля старої річки де вода завжди швидка і холодна",
        "bg": "тази голяма къща стои до старата река където водата винаги е бърза и студена",
        "el": "αυτό το μεγάλο σπίτι στέκεται δίπλα στο παλιό ποτάμι όπου το νερό είναι κρύο",
        "zh": "这座 大 房子 站在 古老 的 河边 那里 的 水 总是 又快 又冷",
        "ja": "この 大きな 家 は 古い 川 の そば に 立って いて 水 は いつも 冷たい",
        "da": "dette store hus står ved den gamle å hvor vandet altid er hurtigt og koldt",
        "sv": "detta stora hus står vid den gamla ån där vattnet alltid är snabbt och kallt",
    }
    rng = random.Random(3)
    rows = [(i * len(words) + j, " ".join(rng.choices(own.split(), k=8)), lang) for i in range(60) for j, (lang, own) in enumerate(words.items())]
    held = [r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r["held_out"]]
    true = {i: lang for i, _, lang in rows}
    for lang in words:
        own = [r["lang_pred"] == lang for r in held if true[r["doc_id"]] == lang]
        assert sum(own) >= 0.95 * len(own), lang


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"] += rng.normal(size=net.p["word"].shape) * 0.3
    words, index, first = toxicity.read_words(np.frombuffer(b"one two three four five six seven", np.uint8), np.array([0, 33]))
    at, mask = np.array([[0, 1, 2, 3, 4], [5, 6, 1, 0, 0]]), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    target = np.array([1.0, 0.0])

    def loss():
        x = net.logits(net.inputs(net.embed(words)), at, mask).astype(float)
        return float((np.logaddexp(0, x) - target * x).mean())

    grads = net.gradients(words, at, mask, target)
    for name in ("uf", "xb", "aw", "av", "ow", "cf"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            before, step = flat[i], 1e-3
            flat[i] = before + step
            up = loss()
            flat[i] = before - step
            down = loss()
            flat[i] = before
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vilewort", "snarlfoo", "grubzax"]
    rows = []
    for i in range(400):
        words = prose(rng, rng.randrange(5, 200)).split(" ")
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    net = toxicity.train([t for _, t, _ in rows[:300]], [y for _, _, y in rows[:300]])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[300:]] + [(900, None), (901, ""), (902, prose(rng, 20_000) + " " + bad[0]), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, net).collect()}
    right = sum(got[i]["predicted"] == y for i, _, y in rows[300:])
    assert right >= 95 and got[900]["score"] == 0 and got[901]["score"] == 0 and got[902]["predicted"] == 1
    assert toxicity.score(docs.limit(0), net).count() == 0
    untrained = toxicity.train(["a b", "c d"], [0, 0])
    assert {r["score"] for r in toxicity.score(docs, untrained).collect()} == {0.0}


def plain_logit(net, words):
    """A window's logit by loops over words and units."""
    embed = [net.p["word"][s] + np.mean([net.p["gram"][g] for g in own], axis=0) for s, own in words]
    hidden, states = toxicity.HIDDEN, [[], []]
    for side, d in enumerate("fb"):
        h = np.zeros(hidden)
        for x in embed if d == "f" else embed[::-1]:
            a, g = x @ net.p[f"x{d}"] + net.p[f"c{d}"], h @ net.p[f"u{d}"]
            z, r = (1 / (1 + np.exp(-(a[i : i + hidden] + g[i : i + hidden]))) for i in (0, hidden))
            h = z * h + (1 - z) * np.tanh(a[2 * hidden :] + r * g[2 * hidden :])
            states[side].append(h)
    both = [np.concatenate(x) for x in zip(states[0], states[1][::-1])]
    e = np.array([np.tanh(s @ net.p["aw"] + net.p["ac"]) @ net.p["av"] for s in both])
    w = np.exp(e - e.max())
    return float(sum(wi * s for wi, s in zip(w / w.sum(), both)) @ net.p["ow"] + net.p["oc"][0])


def test_scores_equal_plain_forward_pass(spark):
    rng = np.random.default_rng(2)
    net = toxicity.Network.fresh(3)
    net.p["word"] += rng.normal(size=net.p["word"].shape).astype(np.float32)
    net.p["gram"] += rng.normal(size=net.p["gram"].shape).astype(np.float32)
    net.trained, net.slope, net.shift = True, 1.3, -0.2
    texts = [prose(random.Random(i), n) for i, n in enumerate((1, 7, 48, 49, 100, 130))]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, text in enumerate(texts):
        words, index, first = toxicity.read_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        own = [(words.slots[w], words.grams[words.bounds[w] : words.bounds[w + 1]]) for w in index]
        starts = [0] if len(own) <= 48 else [*range(0, len(own) - 48, 40), len(own) - 48]
        best = max(plain_logit(net, own[s : s + 48]) for s in starts)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(1.3 * best - 0.2))), abs=1e-4)


def test_verdict_comes_through_the_network(spark):
    """Words that are harmless alone are toxic in one order: no sum of word odds can tell."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        words = prose(rng, 14).split(" ")
        at = rng.randrange(12)
        words[at : at + 2] = ["alpha", "omega"] if i % 2 else ["omega", "alpha"]
        rows.append((i, " ".join(words), i % 2))
    net = toxicity.train([t for _, t, _ in rows[:700]], [y for _, _, y in rows[:700]])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([r[:2] for r in rows[700:]], "doc_id long, text string"), net).collect()}
    positive, negative = ([got[i] for i, _, y in rows[700:] if y == label] for label in (1, 0))
    assert np.mean([p > n for p in positive for n in negative]) > 0.9


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 88, 89, 500):
        start, size, _ = toxicity.windows(np.array([3, 3 + n]))
        assert {i for s, z in zip(start, size) for i in range(s, s + z)} == set(range(3, 3 + n))


def fuzz(n):
    rng = random.Random(9)
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x400), 0x1C, 0x85, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0xFB01, 0x915]]
    return ["".join(rng.choice(letters if rng.random() < 0.5 else "abcdefgh 'st re123!!..\n<|endoftext|>") for _ in range(rng.randrange(120))) for _ in range(n)] + ["<|startoftext|>a<|endoftext|> b<|ENDOFTEXT|>", "it's we'll THEY'RE 'S", "ΑΣ ΣΑΣ", "", " ", "a" * 3000]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), fuzz(400)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "doc_id long, text string")
    for r in bpe.digests(docs, path).collect():
        text = texts[r["doc_id"]] if r["doc_id"] < len(texts) else ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoder = bpe.Encoder(bpe.TokenizerFile.read(path))
    for r in bpe.encode(docs.limit(50), path).collect():
        assert encoder.decode(list(r["ids"])) == r["decoded"]
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = unigram.vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always")])
    texts = [t.replace(unigram.MARK, "") for t in fuzz(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "doc_id long, text string")
    for r in unigram.token_counts(docs, vocab).collect():
        text = texts[r["doc_id"]] if r["doc_id"] < len(texts) else ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    ties = unigram.PieceCounter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -5.0)])
    assert ties.pieces("ab") == 1 and ties.pieces("xxab") == 2  # the earlier start wins a tie; unknowns are one piece


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", None), (5, 0, None, ""), (None, 0, "user", "x")]
    rows = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("h1", F.lit(1))).collect()}
    assert set(rows) == {3, 5} and rows[3]["n_turns"] == 3
    assert rows[3]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"


def test_equal_turn_numbers_are_ordered_by_role_and_text(spark):
    """{user xN} is a prefix of {user xN, user yN} whatever the hashes and the order of rows are."""
    rows = []
    for i in range(8):
        rows += [(2 * i, 0, "user", f"x{i}"), (2 * i + 1, 0, "user", f"y{i}"), (2 * i + 1, 0, "user", f"x{i}")]
    for df in (rows, rows[::-1]):
        got = chat.format_chats(spark.createDataFrame(df, "conv_id long, turn long, role string, text string").repartition(3)).collect()
        assert sorted(r["conv_id"] for r in got) == [2 * i + 1 for i in range(8)]
        assert all(r["text"].index(f"x{r['conv_id'] // 2}") < r["text"].index(f"y{r['conv_id'] // 2}") for r in got)


def test_chats_of_nothing_and_of_repeated_rows(spark):
    schema = "conv_id long, turn long, role string, text string, h1 string, n string, position string"
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, "u", "a", "x", "y", "z")] * 3 + [(2, 0, "u", "a", "x", "y", "z")] * 2 + [(3, None, None, None, "x", "y", "z"), (None, 1, "u", "a", "x", "y", "z")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 3, 3: 1}


def test_top_k_of_extreme_vectors(spark):
    """Scores beyond floats are exact, and those beyond a long count as its limits; other rows don't suffer."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(30)]
    rows += [(100, [4e6] * 8), (101, [-4e6] * 8), (102, [3e6] * 8), (103, [1e30] * 8), (104, [2.0**20 + 1] * 8), (105, [1e5, -1e5] * 4)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(*[spark.createDataFrame(rows, "vec_id long, embedding array<double>")] * 2, k=7).collect()}
    most = 2**63 - 1
    whole = {i: [max(-(2**63), min(most, int(np.floor(1024 * x)))) for x in v] for i, v in rows}
    for q in whole:
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q)
        assert [got[(q, r + 1)] for r in range(7)] == [(c, -s) for s, c in scores[:7]]


def test_copies_do_not_starve_the_training(spark, monkeypatch):
    """500 copies of one long toxic text are one text: the bytes of a label are left to the others."""
    rng = random.Random(3)
    long = prose(rng, 9000)
    rows = [(i, long) for i in range(500)] + [(1000 + i, prose(rng, 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 1200) as toxic")

    def fake(batches):
        import pickle

        import pyarrow as pa

        n = Counter(x for b in batches for x in b.column("toxic").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(n))], pa.binary())], ["net"])

    monkeypatch.setattr(toxicity, "_train", fake)
    kept = [r for r in rows if r[0] >= 1000 and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert toxicity.learn(docs, labels) == {1: 1 + sum(r[0] < 1200 for r in kept), 0: sum(r[0] >= 1200 for r in kept)}


def test_pipeline(spark):
    """Every stage against a plain version of its work on what the stage before it kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    docs = small_docs(spark, ["\n".join([prose(random.Random(i % 3), 30), prose(random.Random(50 + i), 20)]) for i in range(6)]).where("length(text) < 100000 or text is null")
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and plain(clean) <= plain(docs)
    lined = stages["line_dedup"](spark, docs, SF)
    rows = docs.collect()
    wanted = brute_components(line_sets(rows), alike)
    left = Counter()
    for r in rows:
        lines = (r["text"] or "").split("\n")
        text = "\n".join(x for i, x in enumerate(lines) if wanted.get((r["doc_id"], i), (r["doc_id"], i)) == (r["doc_id"], i)) if r["doc_id"] is not None and r["text"] is not None else r["text"]
        if text == r["text"] or WORD.search(text):
            left[(r["doc_id"], text)] += 1
    assert plain(lined) == left
    near = stages["near_dedup"](spark, lined, SF)
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in lined.collect() if r["doc_id"] is not None}
    heads = {i for i, head in brute_components(sets, alike).items() if i == head}
    assert Counter(r["doc_id"] for r in near.collect() if r["doc_id"] is not None) == Counter(heads)
    assert near.where("doc_id is null").count() == lined.where("doc_id is null").count()
    assert all(stages[n](spark, docs.limit(0), SF).count() == 0 for n in ("toxicity", "line_dedup", "near_dedup", "mixing", "bpe"))


def test_pipeline_equals_plain_mix_and_library(spark, tmp_path):
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    with_null_ids(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, str(tmp_path))
    rows = [r.asDict() for r in left.collect()]
    wanted, _ = plain_mix(rows)
    assert any(doc is None and n for doc, _, n in wanted)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == sum((Counter({doc: k}) for (doc, _, _), k in wanted.items()), Counter())
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    digest = lambda r: hashlib.sha256(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert {(r["doc_id"], r["ids_sha256"]) for r in out} <= {(r["doc_id"], digest(r)) for r in rows}
