"""Ingest and export operators (S, K) over the given tables."""

from pyspark.sql import functions as F

from corpuslink.plans import fixtures as X
from corpuslink.queries.corpus import EDGES, REPORT_RATINGS, report_ratings
from corpuslink.queries.registry import query
from corpuslink.queries.text import rule
from corpuslink.sources import readers as S
from corpuslink.sources import writers as K


@query("ingest_dedupe_numbers", "", """SELECT collection, CASE WHEN n > 1 THEN number || '.' || n ELSE number END AS number, l_partkey FROM (SELECT l_shipmode_ AS collection, CAST(l_orderkey AS VARCHAR) AS number,
    l_partkey, row_number() OVER (PARTITION BY l_shipmode_, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS n FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem))""")
def ingest_dedupe_numbers(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("collection"), F.col("l_orderkey").cast("string").alias("number"), "l_partkey", "l_linenumber",
                                                "l_suppkey", "l_shipdate", "l_quantity")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")]
    return S.dedupe_number(rows, order).select("collection", "number", "l_partkey")


@query("ingest_ratings_from", "", """SELECT o_orderstatus AS collection, CAST(o_orderkey AS VARCHAR) AS number, 'desk' AS rater, regexp_extract(o_orderpriority, '^[0-9]-(.*)$', 1) AS grade FROM orders
    WHERE regexp_extract(o_orderpriority, '^[0-9]-(.*)$', 1) <> '' AND NOT contains(o_orderpriority, 'LOW')""")
def ingest_ratings_from(spark, d):
    rows = X.table(spark, d, "orders").select(F.col("o_orderstatus").alias("collection"), F.col("o_orderkey").cast("string").alias("number"), "o_orderpriority")
    return S.ratings_from(rows, [("desk", "o_orderpriority", r"^\d-(.*)$", "LOW")])


@query("ingest_resolve_refs", "reports_o", """SELECT 'book:' || collection AS chapter, row_number() OVER (PARTITION BY collection ORDER BY l_orderkey) AS ordinal, report_id, CAST(l_orderkey AS VARCHAR) AS number FROM (
    SELECT DISTINCT l_orderkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey) JOIN reports_o ON report_id = l_orderkey WHERE o_orderpriority < '4'""")
def ingest_resolve_refs(spark, d):
    # references to reports that have lines; the collection is named wrongly for the two last priorities
    asked = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id")).distinct()
    named = asked.join(X.reports_o(spark, d), "report_id").join(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), "o_orderpriority"), "report_id")
    refs = named.select(F.col("report_id").alias("place"), F.when(F.col("o_orderpriority") < "4", F.col("collection")).otherwise("nowhere").alias("collection"),
                        F.col("report_id").cast("string").alias("number"))
    reports = X.reports_o(spark, d).withColumn("number", F.col("report_id").cast("string"))
    return S.resolve_refs(refs, reports)[0].select("chapter", F.col("ordinal").cast("long"), "report_id", "number")


def upserted(spark, d, mode):
    target = X.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("v")).groupBy("o_custkey").agg(F.min("v").alias("v"))
    batch = X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("v"))
    return S.upsert(target, batch, ["o_custkey"], mode)


UPSERT = "t AS (SELECT o_custkey, min(o_orderkey) AS v FROM orders GROUP BY 1)"


@query("ingest_upsert_ignore", "", UPSERT + " SELECT * FROM t UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM t)")
def ingest_upsert_ignore(spark, d):
    return upserted(spark, d, "ignore")


@query("ingest_upsert_replace", "", UPSERT + " SELECT * FROM t WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, -1 FROM customer")
def ingest_upsert_replace(spark, d):
    return upserted(spark, d, "replace")


@query("ingest_remove_source", "", """SELECT DISTINCT o_custkey AS report_id FROM orders WHERE o_orderstatus <> 'O'""")
def ingest_remove_source(spark, d):
    orders = X.table(spark, d, "orders")
    tables = {"editions": orders.select(F.col("o_orderstatus").alias("edition_id"), F.col("o_orderstatus").alias("source_id")).distinct(),
              "texts": orders.select(F.col("o_custkey").alias("report_id"), F.col("o_orderstatus").alias("edition_id")),
              "reports": orders.select(F.col("o_custkey").alias("report_id"), F.lit("c").alias("collection")).distinct()}
    return S.remove_source(tables, "O")["reports"].select("report_id")


@query("ingest_manifest_diff", "", """h AS (SELECT c_nationkey AS e, max(c_custkey) AS f FROM customer WHERE c_nationkey < 20 GROUP BY 1), o AS (SELECT c_nationkey AS e, max(c_custkey) AS f FROM customer WHERE c_mktsegment <> 'BUILDING'
    GROUP BY 1) SELECT CAST(o.e AS VARCHAR) AS entry, CASE WHEN h.e IS NULL THEN 'new' ELSE 'changed' END AS change FROM o LEFT JOIN h USING (e) WHERE h.e IS NULL OR h.f <> o.f""")
def ingest_manifest_diff(spark, d):
    offer = lambda keep: X.table(spark, d, "customer").where(keep).groupBy(F.col("c_nationkey").cast("string").alias("entry")).agg(
        F.max("c_custkey").cast("string").alias("fingerprint")).withColumn("languages", F.array(F.lit("en")))
    return S.manifest_diff(offer("c_nationkey < 20"), offer("c_mktsegment <> 'BUILDING'")).select("entry", "change")


rule("ingest_license_tiers", "orders", "o_orderkey", [("CC0", "A"), ("cc-by-sa-4.0", "B"), ("odd-nc-1", "B"), ("all rights reserved", "C"), (" MIT ", "A")], "VARCHAR", S.license_tier)


@query("ingest_status", "reports", """SELECT 'e' || collection AS entry, collection, count(*) AS reports, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, true AS imported FROM reports GROUP BY collection""")
def ingest_status(spark, d):
    texts = X.reports(spark, d)
    return S.status(texts.select("collection").distinct().withColumn("entry", F.concat(F.lit("e"), "collection")), texts, texts).select(
        "entry", "collection", "reports", "languages", "imported")


@query("ingest_entry_pages", "", r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def ingest_entry_pages(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"),
                                             F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


FLAT = REPORT_RATINGS + """, g AS (SELECT report_id, string_agg(rater || ': ' || grade, '; ' ORDER BY rater) AS ratings FROM report_ratings GROUP BY 1)"""


@query("export_flat_reports", "reports_o", FLAT + """ SELECT report_id, collection, CASE WHEN o_orderstatus = 'F' THEN 'status F' ELSE '' END AS text_f, CASE WHEN o_orderstatus = 'O' THEN 'status O' ELSE '' END AS text_o,
    coalesce(ratings, '') AS ratings FROM reports_o JOIN orders ON o_orderkey = report_id LEFT JOIN g USING (report_id)""")
def export_flat_reports(spark, d):
    texts = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.lower("o_orderstatus").alias("language"),
                                               F.concat(F.lit("status "), "o_orderstatus").alias("text"))
    return K.flat_reports(X.reports_o(spark, d).select("report_id", "collection"), texts, report_ratings(spark, d), ["f", "o"])


@query("export_round_trip", "reports_o", REPORT_RATINGS + " SELECT collection, CAST(report_id AS VARCHAR) AS number, CAST(rater AS VARCHAR) AS rater, CAST(grade AS VARCHAR) AS grade FROM report_ratings JOIN reports_o USING (report_id)")
def export_round_trip(spark, d):
    texts = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.lit("en").alias("language"), F.col("o_orderstatus").alias("text"))
    reports = X.reports_o(spark, d).select("report_id", "collection", F.col("report_id").cast("string").alias("number"))
    return S.read_export(K.flat_reports(reports, texts, report_ratings(spark, d), ["en"]))["ratings"]


@query("export_records", "reports_o", REPORT_RATINGS + " SELECT report_id, collection, CAST(count(rater) AS INTEGER) AS ratings FROM reports_o LEFT JOIN report_ratings USING (report_id) GROUP BY ALL")
def export_records(spark, d):
    texts = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.lit("en").alias("language"), F.col("o_orderstatus").alias("text"))
    rows = K.report_records(X.reports_o(spark, d).select("report_id", "collection"), texts, report_ratings(spark, d))
    return rows.select("report_id", "collection", F.when(F.col("ratings").isNull(), 0).otherwise(F.size("ratings")).alias("ratings"))


@query("export_persons", "links persons", "SELECT p.*, (SELECT count(*) FROM links l WHERE l.person_id = p.person_id) AS in_chains FROM persons p WHERE contains(lower(name), '01')")
def export_persons(spark, d):
    return K.person_table(X.persons(spark, d), X.person_uses(spark, d), "01")


@query("export_network_nodes", "links persons", EDGES + " SELECT person_id, name FROM persons WHERE person_id IN (SELECT src FROM edges WHERE weight >= 8 AND src <> dst UNION SELECT dst FROM edges WHERE weight >= 8 AND src <> dst)")
def export_network_nodes(spark, d):
    return K.network(X.links(spark, d), X.persons(spark, d), 8)[0].select("person_id", "name")


@query("export_network_edges", "links", EDGES + " SELECT src, dst, weight FROM edges WHERE weight >= 8 AND src <> dst")
def export_network_edges(spark, d):
    return K.network(X.links(spark, d), X.persons(spark, d), 8)[1]


@query("export_reference_lists", "reports_o", "SELECT o_orderpriority AS tag, count(*) AS refs FROM orders GROUP BY 1")
def export_reference_lists(spark, d):
    tags = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("tag"), F.col("o_orderkey").alias("report_id"))
    reports = X.reports_o(spark, d).withColumn("number", F.col("report_id").cast("string"))
    return K.reference_lists(tags, reports).groupBy("tag").agg(F.sum(F.size("refs")).alias("refs"))


@query("export_scale_selector", "reports_o collections", "SELECT report_id, collection FROM reports_o JOIN collections USING (collection) WHERE scale = 'B'")
def export_scale_selector(spark, d):
    return K.select_collections(X.reports_o(spark, d).select("report_id", "collection"), X.collections(spark, d), "scale:B")
