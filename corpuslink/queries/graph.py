"""Graph and tree operators (G) over the given tables."""

from pyspark.sql import functions as F

from corpuslink.operators import graph as G
from corpuslink.plans import fixtures as X
from corpuslink.queries.corpus import EDGES
from corpuslink.queries.registry import query, r6


@query("graph_edges", "links", EDGES + " SELECT src, dst, weight FROM edges WHERE src <> dst AND weight >= 2")
def graph_edges(spark, d):
    return G.edges(X.links(spark, d), self_loops=False, minimum=2)


@query("graph_degrees", "links", EDGES + """, t AS (SELECT src AS p, count(*) AS n FROM edges GROUP BY 1),
    s AS (SELECT dst AS p, count(*) AS n FROM edges GROUP BY 1) SELECT coalesce(t.p, s.p) AS person_id,
    coalesce(t.n, 0) AS teachers, coalesce(s.n, 0) AS students FROM t FULL JOIN s ON t.p = s.p""")
def graph_degrees(spark, d):
    return G.degrees(G.edges(X.links(spark, d)))


def pagerank_sql(rounds: int) -> str:
    """The rounds written one after the other."""
    parts = [EDGES.replace("edges AS (", "edges AS MATERIALIZED ("), """outw AS MATERIALIZED (SELECT src, sum(weight) AS w FROM edges GROUP BY 1),
    share AS MATERIALIZED (SELECT src, dst, weight / w AS s FROM edges JOIN outw USING (src)),
    node AS MATERIALIZED (SELECT DISTINCT p, p NOT IN (SELECT src FROM outw) AS sink FROM (SELECT src AS p FROM edges
    UNION ALL SELECT dst FROM edges)), size AS MATERIALIZED (SELECT count(*) AS n FROM node),
    r0 AS MATERIALIZED (SELECT p, sink, 1.0 / n AS v FROM node, size)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT node.p, node.sink, 0.15 / n + 0.85 * (coalesce(f, 0) + lost / n) AS v
        FROM node LEFT JOIN (SELECT dst, sum(v * s) AS f FROM share JOIN r{i - 1} ON p = src GROUP BY 1) ON dst = node.p,
        size, (SELECT coalesce(sum(v) FILTER (WHERE sink), 0) AS lost FROM r{i - 1}))""")
    return ", ".join(parts) + f" SELECT p AS person_id, round(v, 9) AS score FROM r{rounds}"


@query("graph_pagerank", "links", pagerank_sql(60))
def graph_pagerank(spark, d):
    return G.pagerank(G.edges(X.links(spark, d))).withColumn("score", F.round("score", 9))


# the fifteen most central persons
@query("graph_central", "links", pagerank_sql(60).replace("SELECT p AS person_id, round(v, 9) AS score FROM r60",
                                                         "SELECT p AS person_id, round(v, 9) AS score FROM r60 ORDER BY round(v, 9) DESC, p LIMIT 15"))
def graph_central(spark, d):
    ranks = G.pagerank(G.edges(X.links(spark, d))).withColumn("score", F.round("score", 9))
    return ranks.orderBy(F.desc("score"), "person_id").limit(15)


@query("graph_top_neighbours", "links", EDGES + """, b AS (SELECT src AS person_id, 'teacher' AS part, dst AS other, weight
    FROM edges UNION ALL SELECT dst, 'student', src, weight FROM edges) SELECT person_id, part, other, weight,
    CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY person_id, part
    ORDER BY weight DESC, other) AS place FROM b) WHERE place <= 5""")
def graph_top_neighbours(spark, d):
    return G.top_neighbours(G.edges(X.links(spark, d)))


@query("graph_compilers_of", "links chains", """SELECT person_id, collection, count(*) AS chains FROM links
    JOIN chains USING (chain_id) WHERE position = 1 AND person_id IS NOT NULL GROUP BY ALL""")
def graph_compilers_of(spark, d):
    return G.compilers_of(X.links(spark, d), X.chains(spark, d))


@query("graph_reports_of_persons", "links chains reports_o", """SELECT DISTINCT person_id, report_id, r.collection,
    number_sort FROM links JOIN chains c USING (chain_id) JOIN reports_o r USING (report_id) WHERE person_id IS NOT NULL""")
def graph_reports_of_persons(spark, d):
    return G.reports_of_persons(X.person_uses(spark, d), X.chains(spark, d), X.reports_o(spark, d))


@query("graph_learning_trees", "links", EDGES + """, p AS (SELECT * FROM edges WHERE src <> dst),
    l0 AS (SELECT DISTINCT src AS root, src AS person_id FROM p),
    c1 AS (SELECT root, src, dst, weight, row_number() OVER (PARTITION BY root, src ORDER BY weight DESC, dst) AS k
      FROM l0 JOIN p ON src = person_id WHERE dst <> root),
    l1 AS (SELECT root, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY root, dst ORDER BY weight DESC,
      src) AS o FROM c1 WHERE k <= 3) WHERE o = 1),
    s1 AS (SELECT root, root AS x FROM l0 UNION SELECT root, dst FROM l1),
    c2 AS (SELECT l1.root, p.src, p.dst, p.weight, row_number() OVER (PARTITION BY l1.root, p.src ORDER BY p.weight DESC,
      p.dst) AS k FROM l1 JOIN p ON p.src = l1.dst WHERE (l1.root, p.dst) NOT IN (SELECT root, x FROM s1)),
    l2 AS (SELECT root, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY root, dst ORDER BY weight DESC,
      src) AS o FROM c2 WHERE k <= 3) WHERE o = 1)
    SELECT root, CAST(NULL AS BIGINT) AS parent, person_id, 0 AS level, CAST(NULL AS BIGINT) AS weight FROM l0
    UNION ALL SELECT root, src, dst, 1, weight FROM l1 UNION ALL SELECT root, src, dst, 2, weight FROM l2""")
def graph_learning_trees(spark, d):
    edges = G.edges(X.links(spark, d))
    roots = edges.where("src <> dst").select(F.col("src").alias("person_id")).distinct()
    return G.learning_tree(edges, roots, depth=2, width=3)


NAMED = """named AS (SELECT s_suppkey AS person_id, CAST(1 + s_suppkey % 12 AS INTEGER) AS generation,
    [CAST(s_suppkey % 10 AS VARCHAR), CAST(s_suppkey // 10 % 10 AS VARCHAR), CAST(s_suppkey * 7 % 10 AS VARCHAR),
    CAST(s_suppkey % 4 AS VARCHAR)] AS seg FROM supplier)"""


@query("graph_father_edges", "", NAMED + """, k AS (SELECT s.person_id AS son, f.person_id AS father, 3 AS depth,
    f.generation < s.generation AS earlier FROM named s JOIN named f ON s.seg[2:4] = f.seg[1:3]
    AND s.person_id <> f.person_id AND f.generation <= s.generation UNION ALL
    SELECT s.person_id, f.person_id, 2, f.generation < s.generation FROM named s JOIN named f ON s.seg[2:3] = f.seg[1:2]
    AND s.person_id <> f.person_id AND f.generation <= s.generation)
    SELECT son, min(father) AS father FROM (SELECT *, rank() OVER (PARTITION BY son ORDER BY depth DESC, earlier DESC) AS r
    FROM k) WHERE r = 1 GROUP BY son HAVING count(DISTINCT father) = 1""")
def graph_father_edges(spark, d):
    key = F.col("s_suppkey")
    # names made so that the second and third segment of some persons are the first two of others
    people = X.table(spark, d, "supplier").select(
        key.alias("person_id"), (1 + key % 12).cast("int").alias("generation"),
        F.array(*[c.cast("string") for c in (key % 10, F.floor(key / 10) % 10, key * 7 % 10, key % 4)]).alias("segments"))
    return G.father_edges(people)


@query("graph_tree_closure", "nodes", """c AS (SELECT node_id AS ancestor, node_id AS node, 0 AS depth FROM nodes
    UNION ALL SELECT ancestor, n.node_id, depth + 1 FROM c JOIN nodes n ON n.parent_id = c.node)
    SELECT ancestor, count(*) AS nodes, max(depth) AS height FROM c GROUP BY 1""")
def graph_tree_closure(spark, d):
    reach = G.closure(X.nodes(spark, d))
    return reach.groupBy("ancestor").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("height"))


@query("graph_reading_order", "nodes", """c AS (SELECT node_id, kind, label, lpad(CAST(ordinal AS VARCHAR), 12, '0') || ':' ||
    node_id AS path, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.kind, n.label,
    c.path || '/' || lpad(CAST(n.ordinal AS VARCHAR), 12, '0') || ':' || n.node_id, depth + 1
    FROM c JOIN nodes n ON n.parent_id = c.node_id) SELECT node_id, kind, label, path, depth FROM c""")
def graph_reading_order(spark, d):
    return G.reading_order(X.nodes(spark, d))


@query("graph_child_counts", "nodes", """SELECT parent_id AS node_id, count(*) AS children,
    count(*) FILTER (WHERE kind = 'order') AS leaves FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1""")
def graph_child_counts(spark, d):
    return G.child_counts(X.nodes(spark, d), "order")


@query("graph_leaves_under", "nodes", """c AS (SELECT node_id AS chosen, node_id FROM nodes WHERE kind = 'region'
    UNION ALL SELECT chosen, n.node_id FROM c JOIN nodes n ON n.parent_id = c.node_id)
    SELECT chosen, node_id, label FROM c JOIN nodes USING (node_id) WHERE kind = 'order'""")
def graph_leaves_under(spark, d):
    tree = X.nodes(spark, d)
    return G.leaves_under(tree, tree.where("kind = 'region'").select("node_id"), "order")


@query("graph_path_to_root", "nodes", """c AS (SELECT node_id AS start, node_id, 0 AS distance FROM nodes WHERE kind = 'customer'
    UNION ALL SELECT start, parent_id, distance + 1 FROM c JOIN nodes USING (node_id) WHERE parent_id IS NOT NULL)
    SELECT * FROM c""")
def graph_path_to_root(spark, d):
    tree = X.nodes(spark, d)
    return G.path_to_root(tree, tree.where("kind = 'customer'").select("node_id"))


@query("graph_nodes_by_prefix", "nodes",
       "SELECT node_id, kind, label FROM nodes WHERE starts_with(lower(label), 'customer#00000001')")
def graph_nodes_by_prefix(spark, d):
    return G.nodes_by_prefix(X.nodes(spark, d), "Customer#00000001").select("node_id", "kind", "label")


@query("graph_work_tree", "", """r AS (SELECT o_orderkey AS report_id, o_orderstatus AS collection,
    CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE o_orderkey % 11 END AS section FROM orders),
    u AS (SELECT DISTINCT collection, section, CASE WHEN section > 0 THEN 'title ' || section END AS title FROM r)
    SELECT 'w:' || collection AS node_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(1 AS BIGINT) AS ordinal, 'work' AS kind,
    collection AS label FROM r GROUP BY collection
    UNION ALL SELECT 's:' || collection || '/' || coalesce(CAST(section AS VARCHAR), '?'), 'w:' || collection,
    row_number() OVER (PARTITION BY collection ORDER BY CASE WHEN section IS NULL THEN 2 WHEN section = 0 THEN 1 ELSE 0 END,
    section), 'section', coalesce(title, '') FROM u
    UNION ALL SELECT 'h:' || report_id, 's:' || collection || '/' || coalesce(CAST(section AS VARCHAR), '?'),
    row_number() OVER (PARTITION BY collection, section ORDER BY report_id), 'report', CAST(report_id AS VARCHAR) FROM r""")
def graph_work_tree(spark, d):
    section = F.col("o_orderkey") % 11
    reports = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("collection"),
        F.when(section < 10, section).alias("section"), F.col("o_orderkey").alias("number_sort"))
    titles = (reports.where("section > 0").select("collection", "section").distinct()
              .withColumn("title", F.concat(F.lit("title "), F.col("section").cast("string"))))
    return G.work_tree(reports, titles)


@query("graph_chapter_of_report", "reports_o", """s AS (SELECT collection, number_sort, 'chapter ' || report_id AS chapter
    FROM reports_o WHERE report_id % 97 = 5) SELECT r.report_id, r.collection, r.number_sort, s.chapter FROM reports_o r
    ASOF LEFT JOIN s ON r.collection = s.collection AND r.number_sort >= s.number_sort""")
def graph_chapter_of_report(spark, d):
    reports = X.reports_o(spark, d)
    starts = reports.where("report_id % 97 = 5").select(
        "collection", "number_sort", F.concat(F.lit("chapter "), F.col("report_id").cast("string")).alias("chapter"))
    return G.assign_chapters(reports, starts)
