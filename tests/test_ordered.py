"""The hot-group paths give what the plain windows give."""

import pytest
from pyspark.sql import functions as F

from corpuslink.operators import chains as C
from corpuslink.operators import graph as G
from corpuslink.plans import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    # one key holds most of the rows
    return spark.range(600).select(F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(99).alias("k"), F.col("id").alias("o"),
                                   F.when(F.col("id") % 4 == 0, F.col("id")).alias("v")).repartition(5)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_numbers(rows):
    order = [F.col("o")]
    a, b = (O.number_within(rows, ["k"], order, hot=h).select("k", "o", F.col("n").cast("long")) for h in (False, True))
    assert same(a, b)


def test_running_total(rows):
    a, b = (O.running_total(rows, ["k"], [F.col("o")], F.col("v"), "t", hot=h).select("k", "o", "t") for h in (False, True))
    assert same(a, b)


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before(rows, inclusive):
    a, b = (O.last_before(rows, ["k"], [F.col("o")], F.col("v"), "l", inclusive, hot=h).select("k", "o", "l") for h in (False, True))
    assert same(a, b)


def test_beside(rows):
    a, b = (O.beside(rows, ["k"], [F.col("o")], ["v"], hot=h).select("k", "o", "v_before", "v_after") for h in (False, True))
    assert same(a, b)


def test_limit_is_a_setting(spark, rows):
    spark.conf.set("corpuslink.hotGroupRows", "100")
    try:
        assert O.has_hot_group(rows, ["k"])
    finally:
        spark.conf.unset("corpuslink.hotGroupRows")
    assert not O.has_hot_group(rows, ["k"])


def test_next_in_a_chain_longer_than_a_block(spark):
    links = spark.range(1, 10_001).select(F.lit(1).alias("chain_id"), F.col("id").alias("position"), F.col("id").alias("person_id"))
    pairs = G.pairs_of_links(links)
    assert pairs.count() == 9_999
    assert pairs.where("dst <> src + 1").isEmpty()


def test_long_chain_is_read_back_in_parts(spark):
    links = spark.range(1, 2501).select(F.lit(1).alias("chain_id"), F.col("id").alias("position"), F.col("id").alias("person_id"))
    people = spark.createDataFrame([(1, "a")], "person_id long, name string")
    assert sorted(r[0] for r in C.read_back(links, people).select(F.size("links")).collect()) == [500, 1000, 1000]
