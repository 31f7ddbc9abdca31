"""Toxicity, whitening and ranked search against plain versions, held-out accuracy, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygrid.llm import ranked, toxicity, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, rank int"
ODD = [None, "", " ", "a", "\n\n", "###", "x" * 300_000, "naïve  café\t　中文😀", "\x00\x7f", "7", "tie tie tie", "tie tie tie"]


def frame(spark, texts, first=0):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), 7, 0.1, 3) for i, t in enumerate(texts)], DOCS)


# --- toxicity -------------------------------------------------------------------------------------------------------


def plain_form(text):
    return " ".join(re.findall(r"[a-z0-9\x80-\xff]+", re.sub(r"[0-9]", "0", (text or "").encode().decode("latin-1").translate({c: c + 32 for c in range(65, 91)}))))


def plain_grams(text):
    form = plain_form(text)
    shown = " " * 5 + form + " "
    return [shown[i : i + 6] for i in range(len(shown) - 5)] if form else []


def number(gram):
    return int.from_bytes(gram.encode("latin-1"), "big")


def test_grams_equal_a_plain_version():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [t for t in ODD if t is None or len(t) < 1000] + ["".join(rng.choice("abC 9.,é\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    keys, places = toxicity.grams(*toxicity.tk.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert keys[places[i] : places[i + 1]].tolist() == [number(g) for g in plain_grams(t)]


def test_log_ratios_equal_plain_kneser_ney(spark):
    rng = random.Random(4)
    words = ["the", "them", "they", "bad", "bat", "cat", "catty", "nasty"]
    texts = [" ".join(rng.choice(words[: 8 if i % 3 == 0 else 6]) for _ in range(rng.randrange(1, 12))) for i in range(60)]
    labels = [i % 3 == 0 if i % 4 else -1 for i in range(60)]
    rows = spark.createDataFrame([(t, int(y)) for t, y in zip(texts, labels, strict=True)], "text string, label int")
    counts = toxicity.gram_counts(rows)
    by = {1: Counter(), 0: Counter(), -1: Counter()}
    for t, y in zip(texts, labels, strict=True):
        by[int(y)].update(set(plain_grams(t)))
    every = set(by[1]) | set(by[0]) | set(by[-1])
    assert {r["key"]: (r["toxic"], r["ordinary"]) for r in counts.collect()} == {number(g): (by[1][g], by[0][g]) for g in every}

    def discount(values):
        one, two = (sum(v == k for v in values) for k in (1, 2))
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    level, p = every, {}
    levels = {}
    for n in range(5, 0, -1):
        levels[n] = Counter(g[1:] for g in level)
        level = set(levels[n])
    for n in range(1, 6):
        d, total, types = discount(levels[n].values()), Counter(), Counter()
        for g, c in levels[n].items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        for g, c in levels[n].items():
            p[g] = (max(c - d, 0) + d * types[g[:-1]] * (p[g[1:]] if n > 1 else 1 / 256)) / total[g[:-1]]
    known = set(by[1]) | set(by[0])
    d = {k: discount([by[k][g] for g in known]) for k in (0, 1)}

    def probability(g, k):
        after = {x: by[k][x] for x in by[k] if x[:-1] == g[:-1]}
        if not after:
            return p[g[1:]]
        return max(by[k][g] - d[k], 0) / sum(after.values()) + d[k] * len(after) / sum(after.values()) * p[g[1:]]

    found, _ = toxicity.log_ratios(counts)
    shown = {r["key"]: r["ratio"] for r in found.collect()}
    assert set(shown) == {number(g) for g in known}
    for g in known:
        assert shown[number(g)] == pytest.approx(math.log(probability(g, 1) / probability(g, 0)), abs=1e-5)


def test_shared_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("a cat, the cat and the hat. that bat", 1), ("at that", 0)], "text string, label int")
    shared = toxicity.shared_probabilities(toxicity.gram_counts(rows))
    sums = shared.groupBy(F.shiftright("key", 8)).agg(F.sum("p").alias("s")).collect()
    assert all(0 < r["s"] <= 1 + 1e-9 for r in sums)  # what is missing goes to bytes that the context never had


def test_lookup_of_many_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 50_000))
    values = rng.random(len(keys)).astype(np.float32)
    table = toxicity.Lookup(keys, values)
    assert np.array_equal(table(keys), values)
    other = rng.integers(0, 1 << 48, 10_000)
    assert np.isnan(table(other[~np.isin(other, keys)])).all()
    assert np.isnan(toxicity.Lookup(keys[:0], values[:0])(other)).all()


def toxic_corpus(spark, n=500):
    rng = random.Random(8)
    parts = ["ra", "to", "lin", "me", "so", "kar", "ved", "pi"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    texts, truth = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grolk", "zwibbe", "fnurd"])
        texts.append(" ".join(words))
        truth.append(int(i % 5 == 0))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    return texts, truth, labels


def test_toxic_texts_of_held_out_rows(spark):
    texts, truth, labels = toxic_corpus(spark, 1500)
    rows = {r["doc_id"]: r for r in toxicity.classify(frame(spark, texts), labels).collect()}
    held = [i for i in rows if rows[i]["held_out"]]
    assert len(held) > 50 and len(rows) == len(texts)
    right = sum(rows[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.97 * len(held)


def test_held_out_labels_are_not_learnt(spark):
    texts, truth, labels = toxic_corpus(spark, 120)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.classify(frame(spark, texts), x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_edge_cases(spark):
    texts, truth, labels = toxic_corpus(spark, 60)
    docs = frame(spark, texts + ODD).unionByName(frame(spark, ["tie tie tie"], 5)).withColumn("doc_id", F.when(F.col("doc_id") != 70, F.col("doc_id")))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (9999, 1, 1)], labels.schema))
    rows = toxicity.classify(docs, more).collect()
    assert len(rows) == len(texts) + len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    empty = [r["score"] for r in rows if r["doc_id"] in range(60, 65) and r["doc_id"] != 63]
    assert len(set(empty)) == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(frame(spark, ["a b", "c"]), labels.limit(0)).collect()} == {0.5}


def test_ratios_that_tasks_do_not_hold_count_too(spark):
    """Whatever part of the log ratios tasks hold (none, some, all contexts but not all grams), every row is measured by all of them."""
    texts, truth, labels = toxic_corpus(spark, 300)
    texts += ["unlabelled wordings qxj", "tie tie tie", *ODD]
    docs = frame(spark, texts).unionByName(frame(spark, ["tie tie tie"], 5)).withColumn("doc_id", F.when(F.col("doc_id") != 300, F.col("doc_id")))
    found, contexts = toxicity.log_ratios(toxicity.gram_counts(docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label"))))
    assert contexts.count() < found.count() - 1
    model, rest = toxicity.fit(docs, labels)
    assert rest is None
    measures = lambda df: sorted((r["doc_id"] or -1, r["a"], r["b"], r["c"]) for r in df.collect())
    want = measures(toxicity.measured(docs, model, rest))
    assert len(want) == docs.count()
    for most in (0, contexts.count()):
        part, rest = toxicity.fit(docs, labels, most=most)
        assert sum((own >= 0).sum() for _, own, _ in part.grams.levels) <= most and rest.count() > 0
        got = measures(toxicity.measured(docs, part, rest))
        assert [r[0] for r in got] == [r[0] for r in want]
        assert np.allclose([r[1:] for r in got], [r[1:] for r in want], rtol=0, atol=1e-9) and np.allclose(part.weights, model.weights)
    scores = sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.classify(docs, labels, 100).collect())
    # repeated ids: in the order of their measures there, of their scores here
    assert sorted(s for _, s in scores) == pytest.approx(sorted(toxicity.logistic(np.array([r[1:] for r in want]) @ model.weights[:3] + model.weights[3])), abs=1e-9)


# --- whitening ------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5) for i, v in rows], "vec_id long, embedding array<double>, label int, n int")


def plain_whitening(rows):
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for _, v in rows]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    y = u - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    keep = np.argsort(-e)[:16]
    keep = keep[e[keep] > 1e-9 * e.max()]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


@pytest.mark.parametrize(("count", "d", "rank"), [(300, 24, 24), (200, 30, 7), (40, 3, 3)])
def test_whitening_equals_eigenvectors(spark, count, d, rank):
    rng = np.random.default_rng(count)
    a = rng.standard_normal((count, rank)) * np.linspace(3, 0.5, rank) @ rng.standard_normal((rank, d)) if rank < d else rng.standard_normal((count, d)) * np.linspace(5, 1, d)
    rows = [(i, v.tolist()) for i, v in enumerate(a)]
    rows += [(1000 + i, rows[0][1]) for i in range(count // 2)]  # a third of the rows are copies
    out = whitening.whiten(vectors(spark, rows)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = plain_whitening(sorted(rows))
    k = white.shape[1]
    shown = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert shown.shape == (len(rows), min(16, k)) and (out["n"] == n).all()
    assert out[out["component"] == 1]["deviation"].tolist() == deviation.tolist()
    sign = np.sign((shown * white).sum(0))
    assert np.abs(shown - sign * white).max() < 1e-6
    assert np.allclose(out["explained"].to_numpy()[: min(16, k)], explained, rtol=1e-6) and out["identity_error"].iloc[0] < 1e-6


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (5, 5), (9, 4), (33, 33)):
        b = rng.standard_normal((d, r)) * 10.0 ** np.linspace(0, -5, r)
        a = b @ b.T
        factor, order = whitening.pivoted_cholesky(a)
        assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-10) and np.allclose(factor, np.tril(factor))
        turned = whitening.one_sided_jacobi(factor)
        g = turned.T @ turned
        size = np.sqrt(np.diag(g))
        assert np.abs(g / np.outer(size, size) - np.eye(len(g))).max() < 1e-10
        value, vec = whitening.components(a)
        e, q = np.linalg.eigh(a)
        assert np.allclose(value, e[::-1][: len(value)], rtol=1e-6)
        assert np.allclose(vec.T @ vec, np.eye(len(value)), atol=1e-8)


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(10, [0.5, 1.0]), (11, [0.25, -1.0]), (11, [0.25, -1.0]), (None, [3.0, 2.0]), (13, [0.0, 0.0])]
    out = whitening.whiten(vectors(spark, bad + good)).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in out) == sorted((i or -1, c) for i, _ in good for c in (1, 2))
    assert {r["n"] for r in out} == {4}
    assert whitening.whiten(vectors(spark, bad[:5])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 2.0]), (2, [-1e300, 5.0]), (3, [7.0, 1.0])])).collect()
    assert len(huge) >= 3 and huge[0]["deviation"] is None


def test_deviations_are_exact_beyond_doubles():
    white = whitening.Whitening(3, np.array([3_000_001, 2_999_999]), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[1_000_000 + 700_000_000, 1_000_000], [1_000_000, 999_999]])
    assert white.deviations(x) == [sum((3 * int(v) - s) ** 2 for v, s in zip(row, (3_000_001, 2_999_999), strict=True)) for row in x.tolist()]


# --- ranked search --------------------------------------------------------------------------------------------------


def plain_search(items, docs, k=10):
    pattern = re.compile(ranked.TERM_PATTERN)
    terms = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for place, (doc, c) in enumerate(found):
            m = 100 - 90 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, place, doc))
        out += [(i, r + 1, s[-1], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")


def searched(spark, items, docs, **more):
    shown = spark.createDataFrame([(i, t, 1, 2, 0.5) for i, t in docs], "doc_id long, text string, row int, rank int, score double")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(items_frame(spark, items), shown, **more).collect()), key=str)


@pytest.mark.parametrize(("owners", "bundle", "bits", "terms"), [(4, 256, 12, 1_000_000), (3, 7, 4, 1_000_000), (5, 2, 6, 40), (2, 256, 5, 25)])
def test_search_equals_plain_scores(spark, monkeypatch, owners, bundle, bits, terms):
    monkeypatch.setattr(ranked, "BUNDLE", bundle)
    monkeypatch.setattr(ranked, "BLOCK_BITS", bits)
    monkeypatch.setattr(ranked, "PASS_TERMS", terms)
    rng = random.Random(owners)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(300)] + ["Tie", "é", "中"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(150)] + [(200 + i, t) for i, t in enumerate(ODD) if t is None or len(t) < 1000]
    docs += [(300 + i, docs[0][1]) for i in range(70)] + [(5, "w1 tie"), (5, "w1 tie"), (None, docs[0][1])]
    items = [(i, text(rng.randrange(1, 15))) for i in range(20)] + [(50, docs[0][1]), (51, None), (52, ""), (53, "nowhereatall"), (54, "tie TIE tie"), (1, "w2 w3")]
    assert searched(spark, items, docs, owners=owners) == sorted(plain_search(items, docs), key=str)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], [(1, "a" + " b" * 200_000), (2, "a")]) == sorted(plain_search([(1, "a")], [(1, "a" + " b" * 200_000), (2, "a")]), key=str)


def test_owners_pass_on_little():
    df = np.array([1, 2, 3, 500, 400, 20], np.int64)
    o = ranked.Owners(df, np.ones(6, np.int64), np.zeros(6, np.int64), np.arange(6), 1000, 10_000, 4)
    assert (np.diff(o.owner[np.argsort(df)]) >= 0).all() and o.owner.max() == 3
    assert df[o.owner < 3].sum() * ranked.GROWTH <= df.sum()
