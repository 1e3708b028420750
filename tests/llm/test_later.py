"""Whitening, quality trees and the prefix trie against plain versions, with nulls, ties, repeated rows, clashing columns, extremes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same, tables

from quarrymill.llm import gbt, oracles, queries, trie, turns, whitening

SF = "/root/testdata/sf0.001"


# --- whitening ------------------------------------------------------------------------------------------------------


def plain_whitening(rows, k=4):
    """(vec_id, component) -> n, deviation, |whitened|, explained, by LAPACK and Python's integers."""
    fine = []
    for vec_id, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) and abs(256.0 * c) < 2.0**63 for c in v):
            fine.append((vec_id, tuple(math.floor(256.0 * c) for c in v)))
    out = []
    for dim in {len(x) for _, x in fine}:
        own = [(i, x) for i, x in fine if len(x) == dim]
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([s / n for s in sums])
        z = np.array(fit, float) - mean
        e, vectors = np.linalg.eigh(z.T @ z / n)
        for vec_id, x in own:
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for j in range(min(k, dim)):
                value, axis = e[-1 - j], vectors[:, -1 - j]
                live = value > 1e-9 * max(e[-1], 1e-300)
                out.append((vec_id, j + 1, n, deviation if deviation < 2**63 else None, abs((np.array(x, float) - mean) @ axis) / math.sqrt(value) if live else 0.0, value / e.sum() if live else 0.0))
    return out


def check_whitening(rows, got, rel=1e-6):
    wanted = plain_whitening(rows)
    assert len(got) == len(wanted)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], str(r[3]), r[4])
    for a, b in zip(sorted(wanted, key=order), sorted([(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got], key=order), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=rel, abs=rel)


def test_whitening_of_the_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_embedding_whitening(spark, SF).collect()
    check_whitening(rows, got)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(0, [3, 2, 1, 0.5, 0.2], 5)]) for i in range(60)]
    rows += [(3, rows[3][1]), (100, rows[5][1]), (None, [1.0, 2.0, 0.0, 1.0, 0.0])]  # repeated rows, equal vectors, no id
    rows += [(101, None), (102, []), (103, [1.0, None, 0.0, 0.0, 0.0]), (104, [float("nan")] * 5), (105, [float("inf")] * 5), (106, [1e30] * 5)]
    rows += [(200, [0.5, -0.5]), (201, [1.5, 0.25]), (202, [1.5, 0.25]), (203, [-2.0, 0.125])]  # another length
    rows += [(300, [7.0, 7.0, 7.0])]  # one vector alone: no variance
    rows += [(400 + i, [float(2**40 * (i - 1)), 3.0 * i, 0.0, 0.0]) for i in range(4)]  # sums beyond floats, dimensions without variance
    rows = [(i, v, "x", "y", "z") for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n string, component string")
    got = whitening.whiten(df).collect()
    check_whitening([r[:2] for r in rows], got)
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert {r["whitened"] for r in got if r["vec_id"] == 300} == {0.0}
    assert {r["deviation"] for r in got if r["vec_id"] == 403} == {None}
    assert whitening.whiten(df.limit(0)).collect() == []
    again = whitening.whiten(df.repartition(7)).collect()  # whatever the partitions
    key = lambda r: (r["vec_id"] or -1, r["component"], r["deviation"] or 0)
    assert [r["whitened"] for r in sorted(got, key=key)] == [r["whitened"] for r in sorted(again, key=key)]


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 40):
        a = rng.standard_normal((n, n))
        a += a.T
        assert whitening.inertia(a) == ((np.linalg.eigvalsh(a) > 0).sum(), 0)
    assert whitening.inertia(np.array([[0.0, 2.0], [2.0, 0.0]])) == (1, 0)
    assert whitening.inertia(np.diag([3.0, 0.0, -1.0, 0.0])) == (1, 2)


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 1, 1], [3, 3, 2, 2, 0, 0], [1, 1, 1, 1, 1, 1], [9, 0, 0, 0, 0, 0], [4, 4 - 1e-13, 2, 1, 1, 1], [1e12, 1, 1e-3, 0, 0, 0]])
def test_leading_eigenvalues_that_repeat(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((6, 6)))
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, vectors = whitening.leading(v, 4)
    assert e == pytest.approx(sorted(values, reverse=True)[:4], abs=1e-12 * max(values))
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-12
    assert np.abs(vectors @ v - e[:, None] * vectors).max() < 1e-12 * max(values)


# --- quality --------------------------------------------------------------------------------------------------------


def plain_statistics(text):
    """A few of the statistics, from the text as a whole."""
    raw = (text or "").encode()
    words = [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    lower = [w.lower() for w in words]
    n = max(1, len(words))
    triples = [tuple(lower[i : i + 3]) for i in range(len(lower) - 2)] or ([tuple(lower)] if lower else [])
    lines = [x.lower() for x in raw.split(b"\n") if x]
    counts = Counter(raw)
    return {
        "log_bytes": math.log1p(len(raw)),
        "log_words": math.log1p(len(words)),
        "log_lines": math.log1p(len(lines)),
        "mean_word": sum(map(len, words)) / n,
        "entropy": -sum(c / len(raw) * math.log2(c / len(raw)) for c in counts.values()) if raw else 0.0,
        "upper": sum(65 <= b < 91 for b in raw) / max(1, len(raw)),
        "symbol": sum(b in b"#*$%&|<>" for b in raw) / max(1, len(raw)),
        "distinct_words": len(set(lower)) / n,
        "top_word": max(Counter(lower).values(), default=0) / n,
        "same_as_before": sum(a == b for a, b in zip(lower, lower[1:])) / n,
        "repeated_triples": 1 - len(set(triples)) / len(triples) if triples else 0.0,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "ends_in_stop": sum(w[-1] in b".!?" for w in words) / n,
        "starts_upper": sum(65 <= w[0] < 91 for w in words) / n,
    }


TEXTS = ["", None, " \n\t", "a", "a a a b", "One two. One two. One two!\nOne two. One two. One two!\n\n", "é ñ 漢字 \U0001f600", "x" * 5000, "The end\n\nThe end\nthe END", "#a$ %b& " * 50, "w " * 40_000]


def test_statistics_equal_plain_ones(spark):
    got = {r["doc_id"]: r["x"] for r in gbt.measured(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for i, text in enumerate(TEXTS):
        x = dict(zip(gbt.STATISTICS, got[i], strict=True))
        for name, value in plain_statistics(text).items():
            assert x[name] == pytest.approx(value, abs=1e-9), (text and text[:20], name)
        assert all(math.isfinite(v) for v in x.values())


def test_long_texts_are_read_whole():
    raw = np.frombuffer(b"word " * 1_000_000 + b"Z!", np.uint8)
    x = dict(zip(gbt.STATISTICS, gbt.statistics(raw, np.array([0, len(raw)]))[0], strict=True))
    assert x["ends_in_stop"] == pytest.approx(1 / 1_000_001) and x["log_words"] == pytest.approx(math.log1p(1_000_001))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 6)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    trees = gbt.boost(x, y, trees=20)

    def walk(row):
        total = trees.start
        for feature, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > bound[at] else 1)
            total += leaf[at - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert trees.scores(x) == pytest.approx([walk(r) for r in x])
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.9


def test_first_split_is_the_best_one():
    """The root's split against every split of every statistic."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (80, 3)).astype(float), (rng.random(80) < 0.4).astype(float)
    tree = gbt.boost(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    slope, bend = p - y, np.full(len(y), p * (1 - p))

    def gain(mask):
        if min(bend[mask].sum(), bend[~mask].sum()) < gbt.LEAST:
            return 0
        return sum(slope[m].sum() ** 2 / (bend[m].sum() + gbt.SHRINK) for m in (mask, ~mask))

    best = max(gain(x[:, f] <= v + 0.5) for f in range(3) for v in range(8))
    assert gain(x[:, tree.feature[0, 0]] <= tree.bound[0, 0]) == pytest.approx(best)


def test_quality_is_told_on_texts_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null").collect()
    told = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and len(told) > 50 and sum(told) / len(told) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_quality_edges(spark):
    rng = random.Random(1)
    good = ["Good words " + " ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(60)) + "." for _ in range(40)]
    bad = ["BAD$$$ " * 30 + str(i) for i in range(40)]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(good + bad + [None, "", " ", good[0], bad[0]])] + [(None, bad[1], "x", "y", "z"), (0, good[0], "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, copy string, score string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(1, 0, 0), (None, 1, 0), (80, None, 0), (81, 7, 0)], "doc_id long, quality int, toxic int")
    got = gbt.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        by_id[r["doc_id"]].append(r["score"])
    assert len(set(by_id[0])) == 1 and by_id[0] == by_id[83] * 2 and by_id[40] == by_id[84]
    assert by_id[80] == by_id[81]
    assert min(by_id[i][0] for i in range(40)) > 0.7 > max(by_id[i][0] for i in range(40, 80))
    assert {r["score"] for r in gbt.classify(docs, labels.limit(0)).collect()} == {0.5}
    ones = gbt.classify(docs, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in ones}) == 1 and ones[0]["score"] > 0.9
    assert gbt.classify(docs.limit(0), labels).collect() == []


def test_copies_teach_once(spark):
    docs = spark.createDataFrame([(i, "same $$$ text " * 20) for i in range(500)] + [(1000 + i, f"other words number {i} " * 10) for i in range(30)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id >= 1000) as quality")
    rows = gbt.measured(docs)
    assert rows.select("copy").distinct().count() == 31
    trees = gbt.learn(rows, labels)
    assert trees.start == pytest.approx(math.log((sum(zlib.crc32(str(1000 + i).encode()) % 4 != 2 for i in range(30)) + 1) / 2))


# --- trie -----------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + said[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [(m, cs) for m, cs in members.items() if m[:d] == node]
        has_child = {m[:-1] for m in members if m}
        ends = ",".join(str(c) for c in convs if len(built[c]) == d)
        out.append((convs[0], d, members[node[:-1]][0] if d else None, len(convs), sum(len(m) == d + 1 for m, _ in below), sum(m not in has_child for m, _ in below), sum((len(cs) - 1) * len(m[-1][1]) for m, cs in below if m), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string, depth string, owner string, leaf string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check_trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(3)
    got = trie.prefix_trie(df)
    assert got.columns == NAMES and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def conversations(rng, ids, most, texts):
    rows = []
    for c in ids:
        rows += [(c, t, rng.choice(["user", "assistant"]) if t % 3 else "user", rng.choice(texts)) for t in range(rng.randrange(1, most))]
    return rows


def test_trie_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_trie(spark, rows)
    same(queries.op13_prefix_trie(spark, SF).toPandas(), tables(SF).execute(oracles.ORACLE_SQL["op13_prefix_trie"]).df())


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_shared_prefixes(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "HEIGHT", 2 + seed)
    monkeypatch.setattr(turns, "STRETCH", 3)
    monkeypatch.setattr(trie, "RUN", 2)
    rng = random.Random(seed)
    check_trie(spark, conversations(rng, [*range(60), *range(100, 130), *range(905, 930), -7, -250], 9, ["a", "", "é漢", "b\n"]))


def test_trie_edges(spark):
    rows = [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(5, None, None, None), (5, None, "", ""), (5, 2, "b", "x"), (5, 2, "a", "y"), (5, 2, "a", "y")]  # nulls are empty, ties by role and text, repeated rows
    rows += [(200 + i, t, "u", "same") for i in range(8) for t in range(3)]
    rows += [(700 + i, 0, "u", "gone") for i in range(1, 20)]  # their head is absent: some are left without turns
    check_trie(spark, rows)
    check_trie(spark, [(c, 0, "u", "x") for c in range(801, 830)])
    check_trie(spark, [(3, 0, "u", "x")])
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "t", "x", "y", "z")], TURNS)).collect() == []


def test_trie_of_a_deep_conversation(spark):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(700)] + [(c, t, "user", f"turn {t % 7}") for c in range(101, 120) for t in range(c % 5 * 9)]
    rows += [(150, None, "user", "again")] * 300  # equal rows are spread over tasks
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)).collect()}
    wanted = {r[:2]: r for r in plain_trie_quick(rows)}
    assert {k: tuple(r) for k, r in got.items()} == wanted


def plain_trie_quick(rows):
    """plain_trie for deep tries: sums go up the chain of parents."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + said[zlib.crc32(str(c).encode()) % 6 :] for c, said in own.items()}
    ids, info, at_end = {}, {0: [None, None, 0, []]}, {}
    for c in sorted(built):
        node = 0
        info[0][3].append(c)
        for turn in built[c]:
            parent, node = node, ids.setdefault((node, turn), len(ids) + 1)
            info.setdefault(node, [parent, turn, 0, []])[3].append(c)
        at_end.setdefault(node, []).append(c)
    children = Counter(v[0] for k, v in info.items() if k)
    depth = {0: 0}
    for k in sorted(info):
        if k:
            depth[k] = depth[info[k][0]] + 1
    leaves, saved = Counter(), Counter()
    for k in sorted(info, reverse=True):
        leaves[k] += children[k] == 0
        saved[k] += (len(info[k][3]) - 1) * len(info[k][1][1]) if k else 0
        if k:
            leaves[info[k][0]] += leaves[k]
            saved[info[k][0]] += saved[k]
    return [(v[3][0], depth[k], info[v[0]][3][0] if k else None, len(v[3]), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, at_end.get(k, []))).encode()).hexdigest()) for k, v in info.items()]


def test_a_band_explodes_to_its_height_at_most(spark):
    """A chain of 64 nodes in bands of 8: each node meets at most 8 ancestors."""
    rows = spark.createDataFrame([(1, d, 1, int(d == 63), 1) for d in range(64)], "conv_id long, depth long, owner long, leaf long, saved long")
    paths = trie._paths(rows).collect()
    assert max(len(r["up"]) for r in paths) == trie.HEIGHT == 8 and len(paths) == 64
    totals = {r["depth"]: (r["leaf"], r["saved"]) for r in trie.rollup(rows).collect()}
    assert totals == {d: (1, 64 - d) for d in range(64)}
