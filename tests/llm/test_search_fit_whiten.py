"""The operators 11 to 13 held against plain Python, with nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns of clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuslink.llm import best_fit, lexical_search, whitening

DOCS = "doc_id bigint, text string, source string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n, vocabulary):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [None, "", " \t!?", "one", "One ONE one", "École école é日本 日本", "a-b_c", "x" * 3000, "w1 " * 500, prose(rng, 20_000, 900), "don't w1w2 w1 w2",
             "  two  blanks \n\n\n lines\t", "<|endoftext|> and <|endoftext|>", " " * 700 + "far", "no_break　wide \x1c \x85 ."]
    return [(i, t) for i, t in enumerate(texts)] + [(100 + i, prose(rng, rng.randrange(1, 60), 80)) for i in range(120)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Repeated rows, a null id and clashing extra columns included."""
    extra = [*rows, rows[4], rows[4], rows[30], (None, rows[31][1]), (None, "one two")]
    frame = spark.createDataFrame([(i, t, "s") for i, t in extra], DOCS).repartition(4)
    return frame.select("*", *(F.lit(-5).alias(c) for c in ("n_terms", "terms", "tfs", "row", "size", "key", "bin", "x")))


@pytest.fixture(scope="module")
def every(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# 11

ITEMS = [(1, "w1 w2 W3 w3"), (2, None), (3, "  "), (4, "one"), (4, "one"), (5, "école 日本 nowhere"), (6, "x" * 3000 + " w5"), (None, "w7 w8"), (7, "nowhere at all"),
         (8, " ".join(f"w{i}" for i in range(80)))]


def ranked(every, items, top=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counted = [(i, Counter(TERM.findall(lower(t)))) for i, t in every]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, all_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"slice_pairs": 20}, {"slice_chars": 300, "slice_pairs": 50, "long": 2, "top": 3}])
def test_search(spark, docs, every, how):
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, rank int")
    got = lexical_search.search(docs, items, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(every, ITEMS, how.get("top", 10))


def test_search_of_nothing(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")).count() == 0


def test_search_with_text_ids(spark):
    docs = spark.createDataFrame([("b", "tie"), ("a", "tie"), ("c", "tie tie"), (None, "tie"), ("d", "else")], "doc_id string, text string")
    got = lexical_search.search(docs, spark.createDataFrame([("q", "tie")], "item_id string, text string"), top=4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["c", "a", "b", None]


# 12

def ids_of(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    return [model.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def best_fit_bins(lengths, size):
    """Sequences of best-fit decreasing, one piece at a time."""
    free = Counter()
    opened = 0
    for n in sorted(lengths, reverse=True):
        fits = [g for g in free if g >= n and free[g]]
        if fits:
            g = min(fits)
            free[g] -= 1
        else:
            g = size
            opened += 1
        free[g - n] += 1
    return opened


@pytest.mark.parametrize(("size", "range_rows"), [(1024, 100_000), (64, 30), (16, 7)])
def test_best_fit(docs, every, monkeypatch, size, range_rows):
    monkeypatch.setattr(best_fit, "RANGE_ROWS", range_rows)
    cut = best_fit.pieces(docs, TOKENIZER, size=size, ids=True)
    got = [r.asDict() for r in best_fit.packed(cut, size).collect()]
    ids = ids_of([t for _, t in every])
    wanted = Counter()
    for (name, _), own in zip(every, ids, strict=True):
        first = len(own) % size or size
        cuts = [0, *range(first, len(own) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            data = np.array(own[a:b], "<u4").tobytes()
            wanted[name, k, a, b - a, zlib.crc32(data), data] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == wanted
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    lengths = [r["length"] for r in got]
    assert len(sequences) <= best_fit_bins(lengths, size) * 1.03 + 3


def test_best_fit_of_nothing(nothing):
    assert best_fit.packed(best_fit.pieces(nothing, TOKENIZER)).count() == 0


def test_best_fit_of_many_equal(spark):
    """A hot length and a hot id: a third of all pieces alike, over many ranges."""
    lengths = [500] * 300 + [300] * 300 + [24] * 300 + [7] * 200
    cut = spark.createDataFrame([(1, 0, 0, n, 0) for n in lengths], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = best_fit.packed(cut, 1024)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("s")).agg(F.max("s")).head()[0] <= 1024
    assert got.select("sequence_id").distinct().count() <= best_fit_bins(lengths, 1024) + 3


def test_needed_and_claims():
    assert best_fit.needed({10: 3}, {}, 16) == 2
    assert best_fit.needed({10: 3}, {12: 3}, 16) == 0
    assert best_fit.needed({10: 3, 2: 1}, {9: 100}, 16) == 2
    # range 0 left gaps of 90 or more, range 1 of 50 or more; range 2 could not place 5 pieces of up to 30
    assert best_fit.claims([(0, False, 2, 90), (1, False, 1, 50), (2, True, 5, 30)]) == [(2, 0, 1, 1, 0, 1), (2, 1, 5, 0, 0, 3)]


def test_ids_are_the_librarys():
    rng = random.Random(9)
    pool = [*"abehiorstnTHES \n\t'.,!0123é日ñ 　\x1c\x85", "  ", "<|endoftext|>", "'s", "'ll", "the", "ing"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 50))) for _ in range(2000)] + [" " * 200_000, "A" * 20_000]
    model = best_fit.ByteIds(TOKENIZER)
    assert model.fast is not None
    assert [np.frombuffer(model.ids(t), "<u4").tolist() for t in texts] == [x[:-1] for x in ids_of(texts)]


# 13

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).withColumn("n", F.lit("mine"))


@pytest.mark.parametrize("d", [5, 40, 70])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    usable = rng.standard_normal((300, d)) * np.linspace(1, 3, d)
    usable[7] = usable[8]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(usable)] + [(None, [1.0] * d)]
    odd = [(900, None), (901, []), (902, [1.0] * (d - 1) + [None]), (903, [1.0] * (d - 1) + [float("nan")]), (904, [float("-inf")] * d), (905, [1.0] * (d + 1))]
    got = whitening.whitened(vectors(spark, rows + odd)).toPandas()
    k = min(32, d)
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values, q = np.linalg.eigh(covariance)
    values, q = values[::-1], q[:, ::-1]
    expected = centred @ q[:, :k] / np.sqrt(values[:k])
    assert len(got) == n * k and set(got.n) == {n}
    got["vec_id"] = got.vec_id.fillna(-1).astype(int)
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    ids = [-1 if r[0] is None else r[0] for r in rows]
    signs = np.sign((table.loc[ids].to_numpy() * expected).sum(axis=0))
    assert np.abs(table.loc[ids].to_numpy() * signs - expected).max() < 1e-7
    deviation = got.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert deviation.loc[ids].tolist() == [sum(int(y) ** 2 for y in n * row - sums) for row in x]
    explained = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(explained, values[:k] / np.trace(covariance), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(vectors(spark, [(i, [float(i), 2.0, 2.0]) for i in range(4)])).select("component").distinct().count() == 1
    far = whitening.whitened(vectors(spark, [(i, [float(i) * 1e30, 1.0]) for i in range(3)]))
    assert far.where("component = 1 and deviation is not null").count() == 0 and far.where("component = 1").count() == 3


class Known:
    """A covariance whose products are counted."""

    def __init__(self, matrix):
        self.matrix, self.passes = matrix, 0

    def times(self, q):
        self.passes += 1
        return self.matrix @ q


@pytest.mark.parametrize("spectrum", ["gap", "flat", "low rank", "equal"])
def test_leading_is_certified(spectrum):
    rng = np.random.default_rng(1)
    d = 200
    values = {"gap": np.r_[np.linspace(100, 50, 40), np.linspace(10, 1, 160)], "flat": np.linspace(2, 1, d),
              "low rank": np.r_[np.linspace(5, 1, 10), np.zeros(190)], "equal": np.ones(d)}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = Known(q * values @ q.T)
    found, vectors_, residual = whitening.leading(v, d)
    assert np.allclose(found, np.sort(values)[::-1][:32], atol=1e-9)
    assert residual < 1e-11 and np.abs(vectors_.T @ vectors_ - np.eye(32)).max() < 1e-12
    assert np.abs(v.matrix @ vectors_ - vectors_ * found).max() < 1e-9


def test_filter_damps_the_unwanted():
    values = np.r_[10.0, 9.0, np.linspace(1, 0, 30)]
    out = whitening.filtered(Known(np.diag(values)), np.eye(32), 0.0, 1.0, 10.0, 8)
    assert abs(out[0, 0] - 1) < 1e-9 and out[1, 1] > 0.1 and np.abs(np.diag(out)[2:]).max() < 1e-8
