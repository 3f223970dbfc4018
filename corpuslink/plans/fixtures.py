"""The library's views over the given tables: reports, chains, links, persons, ratings, nodes, names (FIXTURES.md).

Each view is a plan over parquet, and its DuckDB twin is in ``VIEW_SQL``, so that a query and its check start from the
same definition."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslink.plans.ordered import has_hot_group, hot_limit, number_within, top_within


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@lru_cache(maxsize=64)
def _hot(application: str, folder: str, name: str, key: str, limit: int) -> bool:
    spark = SparkSession.active()
    return has_hot_group(table(spark, folder, name).select(key), [key], limit)


def hot_key(spark: SparkSession, folder: str, name: str, key: str) -> bool:
    """Whether a key of a given table has more rows than one task should sort (asked once per table and session)."""
    source = table(spark, folder, name)
    return _hot(spark.sparkContext.applicationId, folder, name, key, hot_limit(source))


def scale_key(collection: Column) -> Column:
    return F.when(collection == "BUILDING", F.lit("B")).otherwise(F.lit("A"))


@lru_cache(maxsize=64)
def _splits(application: str, folder: str, name: str) -> int:
    return table(SparkSession.active(), folder, name).rdd.getNumPartitions()


def spread(df: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """A table that comes in fewer splits than there are cores (one small file) is spread over them before heavy work on
    its texts; a table of many splits is left where it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if _splits(spark.sparkContext.applicationId, folder, name) >= cores else df.repartition(cores, key)


def collections(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "customer").select(F.col("c_mktsegment").alias("collection")).distinct()
            .withColumn("scale", scale_key(F.col("collection"))))


def reports_o(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("collection"))
    return (table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("report_id"), "collection", F.col("o_orderkey").alias("number_sort")))


def chains(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("collection"))
    return (table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("chain_id"), F.col("o_orderkey").alias("report_id"), "collection",
                    F.lit(1).alias("ordinal"), (F.col("o_orderstatus") == "F").alias("reaches")))


LINK_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax"]


def links(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINK_ORDER)
    placed = number_within(lines, ["l_orderkey"], [F.col(c) for c in LINK_ORDER], "position",
                           hot=hot_key(spark, folder, "lineitem", "l_orderkey"))
    return placed.select(F.col("l_orderkey").alias("chain_id"), "position",
                         F.when(F.col("l_partkey") % 10 != 0, F.col("l_suppkey")).alias("person_id"))


def person_uses(spark: SparkSession, folder: str) -> DataFrame:
    """(chain_id, person_id) of every link without its position: for counts that do not need the order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"),
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_suppkey")).alias("person_id"))


def persons(spark: SparkSession, folder: str) -> DataFrame:
    generation = (1 + F.col("s_suppkey") % 12).cast("int")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"),
        F.least(F.lit(12), 1 + F.floor((F.col("s_acctbal") + 1000) / 917)).cast("int").alias("rank"),
        generation.alias("generation"),
        F.when(F.col("s_suppkey") % 7 != 0, 25 * generation + F.col("s_nationkey")).cast("int").alias("death_year"))


RATING_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity"]


def raw_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Every rating in the order given: (unit, rater, grade, place columns)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("unit"), (F.col("l_suppkey") % 6).cast("int").alias("rater"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("grade"), *RATING_ORDER)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """The first rating of each (unit, rater): one partial aggregate, no sort of a unit's ratings."""
    first = F.min_by("grade", F.struct(*RATING_ORDER))
    return raw_ratings(spark, folder).groupBy("unit", "rater").agg(first.alias("grade"))


def label_ratings(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("unit"), F.col("quality"), (1 - F.col("toxic")).cast("int").alias("toxic"))
    return labels.unpivot("unit", ["quality", "toxic"], "rater", "grade")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("report_id"), F.col("source").alias("collection"), F.col("lang").alias("language"), "text")
    return spread(rows, folder, "documents", "report_id")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("chain_id"), (F.col("turn") + 1).alias("position"), F.col("role").alias("person"), "text")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("r_regionkey").cast("long").alias("ordinal"), F.lit("region").alias("kind"), F.col("r_name").alias("label"))
    nation = table(spark, folder, "nation").select(
        F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long"),
        F.lit("nation"), "n_name")
    customer = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_custkey", F.lit("customer"), "c_name")
    order = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), "o_orderkey", F.lit("order"),
        F.col("o_orderkey").cast("string"))
    return region.union(nation).union(customer).union(order)


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name): parts, suppliers and customers, ids prefixed by kind."""
    part = table(spark, folder, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    supplier = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_name")
    customer = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_name")
    return part.union(supplier).union(customer)


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark")


# The same views for DuckDB.
VIEW_SQL = {
    "collections": """SELECT DISTINCT c_mktsegment AS collection,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'A' END AS scale FROM customer""",
    "reports_o": """SELECT o_orderkey AS report_id, c_mktsegment AS collection, o_orderkey AS number_sort
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "chains": """SELECT o_orderkey AS chain_id, o_orderkey AS report_id, c_mktsegment AS collection, 1 AS ordinal,
        o_orderstatus = 'F' AS reaches FROM orders JOIN customer ON o_custkey = c_custkey""",
    "links": """SELECT l_orderkey AS chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_tax) AS position,
        CASE WHEN l_partkey % 10 <> 0 THEN l_suppkey END AS person_id FROM lineitem""",
    "persons": """SELECT s_suppkey AS person_id, s_name AS name,
        CAST(least(12, 1 + floor((s_acctbal + 1000) / 917)) AS INTEGER) AS rank,
        CAST(1 + s_suppkey % 12 AS INTEGER) AS generation,
        CAST(CASE WHEN s_suppkey % 7 <> 0 THEN 25 * (1 + s_suppkey % 12) + s_nationkey END AS INTEGER) AS death_year
        FROM supplier""",
    "ratings": """SELECT unit, rater, grade FROM (SELECT l_partkey AS unit, CAST(l_suppkey % 6 AS INTEGER) AS rater,
        CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS grade, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 6
        ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
    "reports": "SELECT doc_id AS report_id, source AS collection, lang AS language, text FROM documents",
    "turns": "SELECT conv_id AS chain_id, turn + 1 AS position, role AS person, text FROM conversations",
    "nodes": """SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id,
        CAST(r_regionkey AS BIGINT) AS ordinal, 'region' AS kind, r_name AS label FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey AS BIGINT), 'nation', n_name FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 'customer', c_name FROM customer
        UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 'order', CAST(o_orderkey AS VARCHAR) FROM orders""",
    "names": """SELECT 'p' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 's' || s_suppkey, s_name
        FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer""",
    "passages": "SELECT item_id, text FROM benchmark",
    "label_ratings": """SELECT doc_id AS unit, 'quality' AS rater, CAST(quality AS INTEGER) AS grade FROM labels
        UNION ALL SELECT doc_id, 'toxic', CAST(1 - toxic AS INTEGER) FROM labels""",
}


__all__ = ["table", "hot_key", "top_within", "VIEW_SQL", "collections", "reports_o", "chains", "links", "person_uses",
           "persons", "raw_ratings", "ratings", "label_ratings", "reports", "turns", "nodes", "names", "passages"]
