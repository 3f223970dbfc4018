"""Invariants of the measures, and the iterative fits against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuslink.operators import corpus as C
from corpuslink.operators import graph as G
from corpuslink.operators import meaning as ME
from corpuslink.operators import models as M
from corpuslink.operators import rank_tests as T
from corpuslink.operators import raters as R
from corpuslink.operators import relations as RE


def test_equal_raters_agree(spark):
    rows = spark.createDataFrame([(u, r, u % 5) for u in range(50) for r in ("a", "b")], "unit long, rater string, grade int")
    patterns = R.patterns(rows)
    out = R.agreement(R.pair_tables(patterns), ["a", "b"]).head()
    assert (out["kappa"], out["wkappa"], out["agree"], out["order"]) == (1.0, 1.0, 1.0, 0.0)
    assert R.alpha_of(R.coincidences(patterns), []).head()["alpha"] == pytest.approx(1.0)


def test_intervals_hold_the_value(spark):
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 5, 400)
    rows = [(u, r, int(np.clip(truth[u] + rng.integers(-1, 2), 0, 4))) for u in range(400) for r in ("a", "b")]
    patterns = R.patterns(spark.createDataFrame(rows, "unit long, rater string, grade int"))
    out = R.agreement_intervals(R.pair_tables(patterns), replicates=60).head()
    assert out["kappa_low"] <= out["kappa"] <= out["kappa_high"]


def test_dawid_skene_finds_the_careless_rater(spark):
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 5, 500)
    rows = [(u, r, int(truth[u]) if rng.random() < keep else int(rng.integers(0, 5))) for u in range(500) for r, keep in (("a", .9), ("b", .9), ("c", .3))]
    patterns = R.patterns(spark.createDataFrame(rows, "unit long, rater string, grade int"))
    model = R.dawid_skene(patterns)
    right = {r: sum(model.prior[k] * t[k][k] for k in range(5)) for r, t in model.theta.items()}
    assert right["c"] < min(right["a"], right["b"]) and sum(model.prior) == pytest.approx(1)
    assert R.with_posterior(patterns, model).select(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1).alias("d")).agg(F.max("d")).head()[0] < 1e-9


def test_equal_counts_have_no_concentration(spark):
    counts = spark.range(40).select(F.col("id").alias("person_id"), F.lit(7).alias("links"))
    row = C.concentration(counts).head()
    assert row["gini"] == pytest.approx(0) and row["half_by"] == 20


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (1, 3, 1), (4, 1, 2)], "src long, dst long, weight long")
    ranks = {r[0]: r[1] for r in G.pagerank(edges, iterations=20).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == 3


def test_diagonal_table_is_one(spark):
    cells = spark.createDataFrame([(i, i, 5) for i in range(4)], "row int, col int, n int")
    row = R.kendall(cells, []).head()
    assert row["tau"] == pytest.approx(1) and row["gamma"] == pytest.approx(1)


def test_ordinal_fit_is_a_maximum(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (800, 2)).astype(float)
    eta = x @ np.array([0.8, -0.5])
    u = rng.logistic(size=800) + eta
    y = np.digitize(u, [0.0, 1.5])
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    fit = M.fit_ordinal(df, 3)
    _ll, score, _outer, observed = M._sums(df, fit.params, fit.k)
    assert fit.converged and np.abs(score).max() < 0.01
    step = 1e-4  # the observed information against differences of the score
    for i in range(len(fit.params)):
        up, down = fit.params.copy(), fit.params.copy()
        up[i] += step
        down[i] -= step
        slope = -(M._sums(df, up, fit.k)[1] - M._sums(df, down, fit.k)[1]) / (2 * step)
        assert np.allclose(slope, observed[i], rtol=1e-3, atol=1e-2)
    assert fit.slopes == pytest.approx([0.8, -0.5], abs=0.25)


def test_stuart_maxwell_of_two_grades_is_mcnemar(spark):
    cells = spark.createDataFrame([("a", "b", 0, 1, 20), ("a", "b", 1, 0, 10), ("a", "b", 0, 0, 30)], "a string, b string, i int, j int, n int")
    row = T.stuart_maxwell(cells, 5).head()
    assert row["chi2"] == pytest.approx((20 - 10) ** 2 / 30) and row["df"] == 1


def test_partial_correlation_of_three(spark):
    rng = np.random.default_rng(4)
    z = rng.permutation(200)
    rows = [(int(v), int(v + rng.integers(0, 60)), int(v + rng.integers(0, 60))) for v in z]
    df = spark.createDataFrame(rows, "z int, a int, b int")
    rho = {(r["a"], r["b"]): r["rho"] for r in T.spearman(df, ["z", "a", "b"]).collect()}
    zab = rho[("a", "b")] if ("a", "b") in rho else rho[("b", "a")]
    za, zb = rho[("z", "a")], rho[("z", "b")]
    expected = (zab - za * zb) / np.sqrt((1 - za ** 2) * (1 - zb ** 2))
    found = {frozenset((r["a"], r["b"])): r["rho"] for r in T.partial_correlations(df, ["z", "a", "b"]).collect()}
    assert found[frozenset("ab")] == pytest.approx(expected, abs=1e-6)


def test_concepts_are_the_singular_vectors(spark):
    rng = np.random.default_rng(5)
    a = np.abs(rng.normal(size=(40, 12))) * (rng.random((40, 12)) < 0.5)
    matrix = spark.createDataFrame([(i, f"w{j:02d}", float(a[i, j])) for i in range(40) for j in range(12) if a[i, j]], "doc long, word string, w double")
    found = {r["word"]: r["v"] for r in ME.concepts(matrix, dims=3, steps=8, extra=8).collect()}
    v = np.array([found[f"w{j:02d}"] for j in range(12)])
    _u, _s, vt = np.linalg.svd(a)
    assert np.abs(np.abs((vt[:3] * v.T).sum(axis=1)) - 1).max() < 1e-6


def test_contained_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    sets = [sorted({f"w{int(x)}" for x in rng.integers(0, 40, rng.integers(2, 14))}) for _ in range(60)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sets[:30])], "a long, words array<string>")
    others = spark.createDataFrame([(i, s) for i, s in enumerate(sets[30:])], "b long, words array<string>")
    got = {(r["a"], r["b"]) for r in RE.contained_pairs(items, others, 0.5).collect()}
    want = {(i, j) for i, s in enumerate(sets[:30]) for j, t in enumerate(sets[30:]) if len(set(s) & set(t)) / min(len(s), len(t)) >= 0.5}
    assert got == want


def test_models_read_every_rater(spark):
    import __spark_entry__ as entry
    from corpuslink.queries.corpus import report_ratings
    folder = "/root/testdata/sf0.001"
    odd = entry.queries()["models_surprises"](spark, folder).collect()
    assert {r["rater"] for r in odd} == {r["rater"] for r in report_ratings(spark, folder).collect()}
    by = {}
    for r in odd:
        by.setdefault((r["side"], r["report_id"]), set()).add(r["rater"])
    shared = {(r["side"], r["report_id"]): r["raters"] for r in entry.queries()["models_shared_surprises"](spark, folder).collect()}
    want = {k: len(v) for k, v in by.items() if len(v) >= 2}
    assert len(want) <= 80 and shared == want and any(not by[k] & {1, 2} for k in want)


def test_products_with_the_matrix_shuffle_nothing_by_document(spark, monkeypatch):
    r = np.random.default_rng(3)
    dense = r.random((40, 12)) * (r.random((40, 12)) < 0.4)
    dense[:, 0] = 1.0
    long = spark.createDataFrame([(d, f"w{w:02d}", float(dense[d, w])) for d in range(40) for w in range(12) if dense[d, w]], "doc long, word string, w double")
    z = r.random((12, 5))
    rows = ME.numbered(ME.by_document(long), [f"w{w:02d}" for w in range(12)])
    block = spark.createDataFrame([(i, z[i].tolist()) for i in range(12)], "id int, a array<double>").select("id", array_to_vector("a").alias("v"))
    for numbers, entries in ((4_000_000, 100_000), (24, 7)):  # in one slice, and in slices of two columns, two or so documents a batch
        monkeypatch.setattr(ME, "SLICE_NUMBERS", numbers)
        monkeypatch.setattr(ME, "ENTRIES", entries)
        there = {x["doc"]: x["v"].toArray() for x in ME._products(rows, block, 12, 5, False).collect()}
        back = {x["id"]: x["v"].toArray() for x in ME._products(rows, block, 12, 5, True).collect()}
        assert np.allclose(np.stack([there[d] for d in range(40)]), dense @ z)
        assert np.allclose(np.stack([back[w] for w in range(12)]), dense.T @ dense @ z)
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (2, "z", 1), (3, "z", 1)], "doc long, word string, tf long")
    vocabulary = spark.createDataFrame([("a", 2.0), ("b", 1.5)], "word string, idf double")
    rows, words = ME.weighted_rows(counts, vocabulary)
    got = ME.long_rows(rows).join(words.select(F.col("id").alias("word"), F.col("word").alias("name")), "word").select("doc", "name", F.round("w", 12))
    assert sorted(got.collect()) == sorted(ME.tfidf(counts, vocabulary).select("doc", "word", F.round("w", 12)).collect())
