"""Column functions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslink.functions import names as N
from corpuslink.functions import pvalues as V
from corpuslink.functions import rules as R
from corpuslink.functions import text as T
from corpuslink.functions.registration import register_functions


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).head()[0]


def test_fold_matches_its_rule(spark):
    text = "Mu'adh Müslim NIYET nîyet Straße ﬁne ½ الأَعْمَالُ مَكْتَبَة ٣ İstanbul ﷺ"
    assert one(spark, text, T.normalize) == "".join(T.fold_character(c) for c in text)


def test_fold_is_idempotent(spark):
    text = "Ünlü Größe الإِسْلام"
    again = one(spark, text, lambda c: T.normalize(T.normalize(c)))
    assert again == one(spark, text, T.normalize)


@pytest.mark.parametrize("text,tokens", [("بالنيات والنية النيات", ["نيات", "نيه", "نيات"]), ("öğrenmenin 12 a", ["ogren"])])
def test_tokens(spark, text, tokens):
    assert one(spark, text, lambda c: T.tokens(T.normalize(c))) == tokens


def test_tokens_at_once_are_those_word_by_word(spark):
    # the last "digits" of the first text end in a line separator, so they are not digits only
    texts = ["12\u2028 ab 123 12345 123456x 1234a a aB1 \U0001d400\U0001d401c d\u00e9j\u00e0vu \t x\r\nyy 12-3 ٣٣ \u00a0 a\u00a0b", "", "  ", "7"]
    by_word = lambda c: F.filter(F.transform(T.blank_split(c), T.token), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{Nd}+\z"))
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(T.tokens(F.col("x")).alias("a"), by_word(F.col("x")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[0]["a"][0] == "12\u2028"


def test_letters_that_become_several_are_looked_for_beyond_ascii_only(spark):
    assert T.RARE_LETTER.startswith("[^")
    texts = [c for c in T.FOLD_SEVERAL] + ["plain ascii", "été ß Ĳ", "a½", "\ufdfa b", "…"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(
        F.col("x").rlike(T.RARE_CLASS).alias("a"), F.col("x").rlike(T.RARE_LETTER).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


@pytest.mark.parametrize("a,b,near", [("zubeyr", "zubyer", True), ("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True),
                                      ("abcd", "badc", False), ("abc", "cba", False)])
def test_near(spark, a, b, near):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(N.near(F.col("a"), F.col("b"))).head()
    assert row[0] is near


@pytest.mark.parametrize("text,marks", [("see (33:33)", [(33, 33, 33)]), ("[23:99-100]", [(23, 99, 100)]), ("(Ahzab 33/51)", [(33, 51, 51)]),
                                        ("(1/2)", []), ("(1:8)", []), ("(2:1-60)", [])])
def test_citations(spark, text, marks):
    assert [tuple(m) for m in one(spark, text, R.citation_marks)] == marks


def test_name_attributes(spark):
    found = {k: one(spark, "أبو داود سليمان بن الأشعث السجستاني", lambda c, k=k: N.name_attributes(c)[k]) for k in ("kunya", "given", "fathers", "nisbas")}
    assert found == {"kunya": "أبو داود", "given": "سليمان", "fathers": ["الأشعث"], "nisbas": ["السجستاني"]}


def test_tails():
    assert V.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert V.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert V.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert V.t_tails(2.228139, 10) == pytest.approx(0.05, abs=1e-5)
    assert V.t_tails(12.7062, 1) == pytest.approx(0.05, abs=1e-4)


def test_holm_and_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "k int, p double").withColumn("g", F.lit(1))
    holm = {r["k"]: r["p_holm"] for r in V.holm(df, ["g"], "p", "k").collect()}
    q = {r["k"]: r["q"] for r in V.benjamini_hochberg(df, ["g"], "p", "k").collect()}
    assert [round(holm[i], 6) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert [round(q[i], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]
    assert all(holm[i] >= p[i] for i in range(4))


def test_labels(spark):
    df = spark.createDataFrame([(-0.4,), (0.05,)], "v double").select(V.verbal("strength", F.col("v")))
    assert [r[0] for r in df.collect()] == ["a moderate relation", "hardly any relation"]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT cl_normalize('Ünal'), cl_words('a b'), cl_ce_year(1), cl_is_near('abc', 'abd')").head()
    assert row[0] == "unal" and row[1] == ["a", "b"] and row[2] == round(0.970229 + 621.5643) and row[3] is True
    assert math.isclose(row[2], 623, abs_tol=1)
