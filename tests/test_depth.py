"""Trees, chains and result lists of any size, and the quoted examples of the rules that were read wrongly before."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslink.functions import names as N
from corpuslink.functions import pvalues as V
from corpuslink.functions import registration, rules
from corpuslink.functions import text as T
from corpuslink.operators import graph, people, resolve, search
from corpuslink.session import WANTED, tuned


@pytest.fixture(scope="module")
def path(spark):
    rows = [(i, i - 1 if i else None, "leaf" if i == 999 else "inner") for i in range(1000)]
    return spark.createDataFrame(rows, "node_id long, parent_id long, kind string").withColumn("label", F.lit("n")).withColumn("ordinal", F.lit(1))


def test_deep_trees(path):
    root = path.where("node_id = 0").select("node_id")
    assert [r.node_id for r in graph.leaves_under(path, root, "leaf").collect()] == [999]
    up = graph.path_to_root(path, path.where("node_id = 999").select("node_id"))
    assert sorted((r.node_id, r.distance) for r in up.collect()) == [(i, 999 - i) for i in range(1000)]
    assert graph.closure(path.where("node_id < 100")).count() == 5050


def test_cycles_end(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)], "node_id long, parent_id long")
    assert graph.closure(ring).count() == 49
    assert graph.path_to_root(ring, ring.where("node_id = 3").select("node_id")).count() == 7


def test_family_tree(spark):
    fathers = spark.createDataFrame([(i, i - 1) for i in range(1, 150)] + [(500, 1), (501, 500)], "son long, father long")
    got = {r.person_id: (r.father, r.depth) for r in graph.family_tree(fathers, 77).collect()}
    assert got[0] == (None, 0) and got[149] == (148, 149) and got[501] == (500, 3) and len(got) == 152


def test_impossible_pairs_to_the_end(spark):
    links = spark.createDataFrame([(1, i, 7, 1.0, "name", 1) for i in range(1, 61)], "chain_id long, position int, person_id long, confidence double, rule string, candidates int")
    persons = spark.createDataFrame([(7, 3, 100)], "person_id long, generation int, death_year int")
    assert resolve.drop_impossible(links, persons).where("person_id IS NOT NULL").count() == 30


def test_two_word_given_names(spark):
    aliases = spark.createDataFrame([(1, "عبد الله بن عمر بن الخطاب العدوي", 1), (2, "سالم بن عمر بن علي", 1)], "person_id long, alias string, tier int")
    names = spark.createDataFrame([("عبد الله بن عمر العدوي",), ("سالم بن عمر علي",), ("عبد الله",)], "name string")
    assert {(r.name, r.person_id) for r in resolve.name_candidates(names, aliases).collect()} == {("عبد الله بن عمر العدوي", 1), ("سالم بن عمر علي", 2)}


def test_later_matches_are_kept(spark):
    found = spark.range(50).select(F.col("id").alias("person_id"), (100 - F.col("id")).alias("score"), F.lit(0).alias("pass"))
    known = found.select("person_id", F.lit("omar").alias("known_as"), F.lit("omar").alias("name"), F.lit("omar").alias("reading"), F.lit(False).alias("scholar"))
    got = [r.person_id for r in people.rerank(found, known, "omar", first=20).collect()]
    assert sorted(got) == list(range(50)) and set(got[:20]) == set(range(20)) and got[20:] == list(range(20, 50))


def test_death_years(spark):
    rows = [("مات سنة خمس وقيل ست وتسعين وقيل سنة مائة", 3, 95), ("إحدى وعسرين ومائتين", 9, 221), ("مات سنة سبع وخمسين", 1, 57), ("مات قبل سنة خمسين", 3, None),
            ("سبع وقيل ثمان وقيل تسع وخمسين", 1, 57), ("قتل ظلما سنة خمس وثلاثين", 1, 35)]
    df = spark.createDataFrame(rows, "phrase string, generation int, want int")
    assert all(r.want == r.year for r in rules.with_death_year(df, "phrase", "generation", "year").collect())


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.0733880), (2.0, 1e6, 0.0455005), (2.0, 1e8, 0.0455003), (0.0, 5, 1.0)])
def test_t_tails(t, df, p):
    assert V.t_tails(t, df) == pytest.approx(p, rel=1e-4)


@pytest.mark.parametrize("t", [0.1, 1.0, 4.0, 30.0])
def test_t_tails_in_closed_form(t):
    """One, two and three degrees of freedom have elementary distribution functions."""
    x = t / math.sqrt(3)
    assert V.t_tails(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
    assert V.t_tails(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert V.t_tails(t, 3) == pytest.approx(1 - 2 / math.pi * (math.atan(x) + x / (1 + x * x)), rel=1e-9)


def test_sql_functions_equal_the_columns(spark):
    registration.register_functions(spark)
    pairs = [("Straße", "a"), ("Müslim's", "b"), ("ﬁn ½", "c"), ("NIYET", "niyet"), ("zbr", "bzr"), ("abc", "acb"), ("abc", "cba"), ("", "x"), (None, None), ("الأَعْمَالُ", "Ω")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(F.expr("cl_normalize(a)").alias("x"), T.normalize(F.col("a")).alias("y"), F.expr("cl_is_near(a, b)").alias("u"), N.near(F.col("a"), F.col("b")).alias("v")).collect():
        assert r.x == r.y and r.u == r.v


def test_parts_of_words(spark):
    phrases = spark.createDataFrame([(1, "tion"), (2, "on of"), (3, "zz"), (4, "e n")], "phrase_id int, norm string")
    texts = spark.createDataFrame([(1, "the nation of men"), (2, "ration ofer"), (3, "a")], "report_id int, norm string")
    got = {tuple(r) for r in search.phrases_in_texts(phrases, texts, whole_words=False).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1)}


def test_settings_of_the_session_stay(spark):
    before = {k: spark.conf.getAll.get(k) for k in WANTED}
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert tuned(spark).conf.get("spark.sql.session.timeZone") == "Europe/Berlin"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
