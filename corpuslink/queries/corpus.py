"""Corpus counts (A) over the given tables."""

from pyspark.sql import functions as F

from corpuslink.operators import corpus as C
from corpuslink.operators import graph as G
from corpuslink.plans import fixtures as X
from corpuslink.queries.registry import query, r6
from corpuslink.scale import SCALE_A


def profiles(spark, d):
    return C.chain_profiles(X.chains(spark, d), X.person_uses(spark, d), X.persons(spark, d), X.collections(spark, d))


def report_ratings(spark, d):
    """The first rating of each (order, rater)."""
    rows = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), (F.col("l_suppkey") % 6).cast("int").alias("rater"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("grade"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_shipdate", "l_quantity")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return rows.groupBy("report_id", "rater").agg(F.min_by("grade", order).alias("grade"))


GROUP_A = """CASE WHEN {r} = 1 THEN 0 WHEN {r} <= 3 THEN 1 WHEN {r} <= 5 THEN 2 WHEN {r} = 6 THEN 3 WHEN {r} <= 9 THEN 4
    WHEN {r} <= 12 THEN 5 END"""
PROFILE = f"""prof AS (SELECT chain_id, report_id, collection, scale, reaches, length, identified,
    CASE WHEN scale = 'B' THEN max_b - 1 ELSE {GROUP_A.format(r='max_a')} END AS weakest FROM (
    SELECT c.chain_id, c.report_id, c.collection, k.scale, c.reaches, count(l.position) AS length,
    count(p.person_id) AS identified, max(p.rank) AS max_a, max(CASE WHEN p.rank <= 4 THEN p.rank END) AS max_b
    FROM chains c JOIN collections k USING (collection) LEFT JOIN links l ON l.chain_id = c.chain_id
    LEFT JOIN persons p ON p.person_id = l.person_id GROUP BY ALL))"""
ALL = "collections reports_o chains links persons"
REPORT_RATINGS = """report_ratings AS (SELECT report_id, rater, grade FROM (SELECT l_orderkey AS report_id,
    CAST(l_suppkey % 6 AS INTEGER) AS rater, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS grade,
    row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 6 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_quantity) AS rn FROM lineitem) WHERE rn = 1)"""


@query("corpus_overview", ALL, PROFILE + """, books AS (SELECT scale, count(DISTINCT collection) AS collections,
    count(*) AS reports FROM reports_o JOIN collections USING (collection) GROUP BY scale),
    people AS (SELECT scale, count(DISTINCT person_id) AS persons FROM links JOIN chains USING (chain_id)
    JOIN collections USING (collection) WHERE person_id IN (SELECT person_id FROM persons) GROUP BY scale)
    SELECT scale, collections, reports, persons, count(*) AS chains, CAST(sum(length) AS BIGINT) AS links,
    CAST(sum(identified) AS BIGINT) AS identified, count(*) FILTER (WHERE reaches) AS reaching,
    count(*) FILTER (WHERE length > 0 AND length = identified) AS "full"
    FROM prof JOIN books USING (scale) JOIN people USING (scale) GROUP BY scale, collections, reports, persons""")
def corpus_overview(spark, d):
    return C.overview(profiles(spark, d), X.person_uses(spark, d), X.chains(spark, d), X.collections(spark, d),
                      X.reports_o(spark, d), X.persons(spark, d))


@query("corpus_collections", ALL, PROFILE + f""", med AS (SELECT collection, length AS median_length FROM (
    SELECT collection, length, row_number() OVER (PARTITION BY collection ORDER BY length) AS rn,
    count(*) OVER (PARTITION BY collection) AS n FROM prof WHERE length > 0) WHERE rn = n // 2 + 1),
    grp AS (SELECT c.collection, count(DISTINCT p.person_id) AS persons,
    {', '.join(f"CAST(sum(CASE WHEN (CASE WHEN k.scale = 'B' THEN CASE WHEN p.rank <= 4 THEN p.rank - 1 END ELSE "
               + GROUP_A.format(r='p.rank') + f" END) = {g} THEN 1 ELSE 0 END) AS BIGINT) AS group_{g}" for g in range(6))}
    FROM links l JOIN chains c USING (chain_id) JOIN persons p USING (person_id) JOIN collections k USING (collection)
    GROUP BY c.collection)
    SELECT collection, scale, count(*) AS chains, CAST(sum(length) AS BIGINT) AS links,
    round(sum(identified) / sum(length), 6) AS identified_share, round(count(*) FILTER (WHERE reaches) / count(*), 6)
    AS reaching_share, any_value(median_length) AS median_length, any_value(persons) AS persons,
    {', '.join(f'any_value(group_{g}) AS group_{g}' for g in range(6))}
    FROM prof JOIN med USING (collection) JOIN grp USING (collection) GROUP BY collection, scale""")
def corpus_collections(spark, d):
    out = C.per_collection(profiles(spark, d), X.person_uses(spark, d), X.chains(spark, d), X.persons(spark, d),
                           X.collections(spark, d))
    return out.withColumn("identified_share", r6("identified_share")).withColumn("reaching_share", r6("reaching_share"))


@query("corpus_length_histogram", ALL, PROFILE + " SELECT scale, length, count(*) AS chains FROM prof GROUP BY ALL")
def corpus_length_histogram(spark, d):
    return C.length_histogram(profiles(spark, d))


@query("corpus_weakest_links", ALL, PROFILE + """, a AS (SELECT scale, weakest, count(*) AS chains,
    count(*) FILTER (WHERE length = identified) AS full_chains FROM prof WHERE weakest IS NOT NULL GROUP BY ALL),
    b AS (SELECT scale, weakest, count(*) AS reports FROM (SELECT scale, report_id, min(weakest) AS weakest FROM prof
    WHERE weakest IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT scale, weakest, chains, full_chains, coalesce(reports, 0) AS reports FROM a LEFT JOIN b USING (scale, weakest)""")
def corpus_weakest_links(spark, d):
    return C.weakest_links(profiles(spark, d))


@query("corpus_rank_distribution", "links persons", f"""u AS (SELECT person_id, count(*) AS n FROM links
    WHERE person_id IS NOT NULL GROUP BY 1) SELECT coalesce({GROUP_A.format(r='rank')}, -1) AS rank_group,
    count(*) AS persons, count(n) AS persons_in_chains, CAST(coalesce(sum(n), 0) AS BIGINT) AS links
    FROM persons LEFT JOIN u USING (person_id) GROUP BY 1""")
def corpus_rank_distribution(spark, d):
    return C.rank_distribution(X.person_uses(spark, d), X.persons(spark, d))


@query("corpus_generation_ranks", "links persons", f"""g AS (SELECT generation, {GROUP_A.format(r='rank')} AS grp
    FROM persons WHERE person_id IN (SELECT person_id FROM links) AND generation BETWEEN 1 AND 12)
    SELECT generation, {', '.join(f'count(*) FILTER (WHERE grp = {g}) AS group_{g}' for g in range(6))}
    FROM g WHERE grp IS NOT NULL GROUP BY generation""")
def corpus_generation_ranks(spark, d):
    return C.generation_ranks(X.person_uses(spark, d), X.persons(spark, d))


COUNTS = """cnt AS (SELECT p.person_id, p.name, p.rank, p.generation, p.death_year, count(*) AS links,
    count(DISTINCT c.report_id) AS reports FROM links l JOIN chains c USING (chain_id) JOIN persons p USING (person_id)
    GROUP BY ALL)"""


def person_counts(spark, d):
    return C.person_counts(X.person_uses(spark, d), X.chains(spark, d), X.persons(spark, d))


@query("corpus_pillars", "links chains persons", COUNTS + " SELECT * FROM cnt ORDER BY links DESC, person_id LIMIT 25")
def corpus_pillars(spark, d):
    return C.pillars(person_counts(spark, d), 25)


@query("corpus_weak_pillars", "links chains persons",
       COUNTS + " SELECT * FROM cnt WHERE rank >= 7 ORDER BY links DESC, person_id LIMIT 15")
def corpus_weak_pillars(spark, d):
    return C.pillars(person_counts(spark, d), 15, SCALE_A.weak_from)


EDGES = """edges AS (SELECT a.person_id AS src, b.person_id AS dst, count(*) AS weight FROM links a JOIN links b
    ON b.chain_id = a.chain_id AND b.position = a.position + 1 WHERE a.person_id IS NOT NULL AND b.person_id IS NOT NULL
    GROUP BY ALL)"""


@query("corpus_most_students", "links persons", EDGES + """, s AS (SELECT dst AS person_id, count(*) AS students FROM edges
    GROUP BY 1) SELECT person_id, name, students FROM s JOIN persons USING (person_id)
    ORDER BY students DESC, person_id LIMIT 10""")
def corpus_most_students(spark, d):
    degrees = G.degrees(G.edges(X.links(spark, d)))
    return (degrees.join(X.persons(spark, d), "person_id").select("person_id", "name", "students")
            .orderBy(F.desc("students"), "person_id").limit(10))


LORENZ = """u AS (SELECT person_id, count(*) AS v FROM links JOIN persons USING (person_id) GROUP BY 1),
    o AS (SELECT v, row_number() OVER (ORDER BY v, person_id) AS i, sum(v) OVER (ORDER BY v, person_id
    ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY v DESC, person_id) AS j,
    sum(v) OVER (ORDER BY v DESC, person_id ROWS UNBOUNDED PRECEDING) AS top, count(*) OVER () AS n,
    sum(v) OVER () AS total FROM u)"""


@query("corpus_concentration", "links persons", LORENZ + """ SELECT max(n) AS people,
    min(CASE WHEN top >= total / 2 THEN j END) AS half_by,
    round(1 - 2 * sum(cum / total) / max(n) + 1 / max(n), 6) AS gini,
    round(sum(CASE WHEN j <= greatest(1, round_even(0.01 * n, 0)) THEN v END) / max(total), 6) AS top1,
    round(sum(CASE WHEN j <= greatest(1, round_even(0.10 * n, 0)) THEN v END) / max(total), 6) AS top10 FROM o""")
def corpus_concentration(spark, d):
    out = C.concentration(C.use_counts(X.person_uses(spark, d), X.persons(spark, d)))
    return out.select("people", "half_by", r6("gini").alias("gini"), r6("top1").alias("top1"), r6("top10").alias("top10"))


@query("corpus_lorenz_curve", "links persons", LORENZ + """ SELECT CAST(k AS INTEGER) AS point,
    round(i / n, 6) AS people_share, round(cum / total, 6) AS sum_share
    FROM o JOIN range(1, 41) t(k) ON i = greatest(1, round_even(k * n / 40, 0))""")
def corpus_lorenz_curve(spark, d):
    out = C.lorenz_curve(C.use_counts(X.person_uses(spark, d), X.persons(spark, d)))
    return out.select("point", r6("people_share").alias("people_share"), r6("sum_share").alias("sum_share"))


FACTS = EDGES + """, facts AS (SELECT src, dst, weight AS times, s.death_year - t.death_year AS gap,
    s.generation AS sg, t.generation AS tg FROM edges JOIN persons s ON s.person_id = src
    JOIN persons t ON t.person_id = dst)"""


def facts(spark, d):
    return C.pair_facts(X.links(spark, d), X.persons(spark, d))


@query("corpus_death_gaps", "links persons", FACTS + """ SELECT CAST(floor(least(160, greatest(-60, gap)) / 10) * 10
    AS INTEGER) AS gap, CAST(sum(times) AS BIGINT) AS pairs FROM facts WHERE gap IS NOT NULL GROUP BY 1""")
def corpus_death_gaps(spark, d):
    return C.death_gaps(facts(spark, d))


@query("corpus_gap_suspects", "links persons", FACTS + """ SELECT src, dst, gap, times FROM facts
    WHERE gap > 110 OR gap < -60 ORDER BY times DESC, src, dst LIMIT 15""")
def corpus_gap_suspects(spark, d):
    return C.gap_suspects(facts(spark, d))


@query("corpus_generation_order", "links persons", FACTS + """ SELECT
    CAST(sum(CASE WHEN sg >= tg THEN times ELSE 0 END) AS BIGINT) AS in_order,
    CAST(sum(CASE WHEN sg < tg THEN times ELSE 0 END) AS BIGINT) AS out_of_order FROM facts""")
def corpus_generation_order(spark, d):
    return C.generation_order(facts(spark, d))


@query("corpus_order_suspects", "links persons",
       FACTS + " SELECT src, dst, times FROM facts WHERE sg < tg ORDER BY times DESC, src, dst LIMIT 15")
def corpus_order_suspects(spark, d):
    return C.order_suspects(facts(spark, d))


CELLS_W = REPORT_RATINGS + """, cells AS (SELECT collection, rater, w.weakest AS "row",
    CASE WHEN scale = 'B' THEN CASE WHEN grade > 0 THEN 4 - grade END ELSE 4 - grade END AS "col", count(*) AS n
    FROM report_ratings JOIN (SELECT report_id, collection, scale, min(weakest) AS weakest FROM prof
    WHERE weakest IS NOT NULL GROUP BY ALL) w USING (report_id) WHERE scale = 'A' OR grade > 0 GROUP BY ALL)"""
CELLS_L = REPORT_RATINGS + """, cells AS (SELECT collection, rater, CAST(least(w.length, 9) - 1 AS INTEGER) AS "row",
    4 - grade AS "col", count(*) AS n FROM report_ratings JOIN (SELECT report_id, collection, scale,
    min_by(length, chain_id) AS length FROM prof WHERE length > 0 GROUP BY ALL) w USING (report_id)
    WHERE scale = 'A' OR grade > 0 GROUP BY ALL)"""


@query("corpus_rating_by_weakest", ALL, PROFILE + ", " + CELLS_W + " SELECT * FROM cells")
def corpus_rating_by_weakest(spark, d):
    return C.rating_cells(report_ratings(spark, d), profiles(spark, d), "weakest")


@query("corpus_rating_by_length", ALL, PROFILE + ", " + CELLS_L + " SELECT * FROM cells")
def corpus_rating_by_length(spark, d):
    return C.rating_cells(report_ratings(spark, d), profiles(spark, d), "length")


@query("corpus_rating_distribution", "reports_o", REPORT_RATINGS + f""" SELECT collection, rater, count(*) AS rated,
    {', '.join(f'count(*) FILTER (WHERE grade = {g}) AS grade_{g}' for g in range(5))}
    FROM report_ratings JOIN reports_o USING (report_id) GROUP BY ALL""")
def corpus_rating_distribution(spark, d):
    return C.rating_distribution(report_ratings(spark, d), X.reports_o(spark, d))


@query("corpus_shared_persons", "chains links", """s AS (SELECT DISTINCT collection, person_id FROM links
    JOIN chains USING (chain_id) WHERE person_id IS NOT NULL), z AS (SELECT collection, count(*) AS n FROM s GROUP BY 1)
    SELECT x.collection AS a, y.collection AS b, count(*) AS shared, round(count(*) / (any_value(zx.n) + any_value(zy.n)
    - count(*)), 6) AS jaccard FROM s x JOIN s y USING (person_id) JOIN z zx ON zx.collection = x.collection
    JOIN z zy ON zy.collection = y.collection GROUP BY x.collection, y.collection""")
def corpus_shared_persons(spark, d):
    return C.shared_persons(X.person_uses(spark, d), X.chains(spark, d)).withColumn("jaccard", r6("jaccard"))


@query("corpus_compilers", "chains links persons", """p AS (SELECT collection, chain_id, person_id, position,
    max(position) OVER (PARTITION BY chain_id) AS last FROM links JOIN chains USING (chain_id)),
    t AS (SELECT 'first' AS part, collection, person_id, count(*) AS links FROM p WHERE position = 1 AND person_id IS NOT NULL
    GROUP BY ALL UNION ALL SELECT 'origin', collection, person_id, count(*) FROM p JOIN persons USING (person_id)
    WHERE position = last AND generation = 1 GROUP BY ALL)
    SELECT part, collection, person_id, links, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER
    (PARTITION BY part, collection ORDER BY links DESC, person_id) AS place FROM t) WHERE place <= 12""")
def corpus_compilers(spark, d):
    return C.compiler_profile(X.links(spark, d), X.chains(spark, d), X.persons(spark, d))


@query("corpus_ends", "", """SELECT c_mktsegment AS collection, o_orderpriority AS ends_with, count(*) AS chains
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def corpus_ends(spark, d):
    ends = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("chain_id"), F.col("o_orderpriority").alias("ends_with"))
    return C.ends_distribution(X.chains(spark, d).join(ends, "chain_id"))


@query("corpus_in_numbers", ALL, PROFILE + ", " + REPORT_RATINGS + """, med AS (SELECT scale, length AS median_length FROM (
    SELECT scale, length, row_number() OVER (PARTITION BY scale ORDER BY length) AS rn, count(*) OVER (PARTITION BY scale)
    AS n FROM prof WHERE length > 0) WHERE rn = n // 2 + 1), b AS (SELECT scale, count(*) AS reports,
    count(*) FILTER (WHERE report_id IN (SELECT report_id FROM report_ratings)) AS rated_reports FROM reports_o
    JOIN collections USING (collection) GROUP BY scale)
    SELECT scale, count(DISTINCT collection) AS collections, count(*) AS chains, CAST(sum(length) AS BIGINT) AS links,
    CAST(sum(identified) AS BIGINT) AS identified, reports, median_length, rated_reports
    FROM prof JOIN med USING (scale) JOIN b USING (scale) GROUP BY scale, reports, median_length, rated_reports""")
def corpus_in_numbers(spark, d):
    return C.corpus_in_numbers(profiles(spark, d), X.reports_o(spark, d), X.collections(spark, d), report_ratings(spark, d))


@query("corpus_listed_generations", "links persons", """l AS (SELECT c_custkey AS key, c_nationkey % 5 AS generation,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(100 + c_custkey % 50 AS INTEGER) END AS y FROM customer),
    u AS (SELECT person_id, count(*) AS n FROM links WHERE person_id IS NOT NULL GROUP BY 1),
    j AS (SELECT l.generation, coalesce(y, death_year) AS year, coalesce(n, 0) AS n FROM l LEFT JOIN persons p
    ON p.person_id = key LEFT JOIN u ON u.person_id = key),
    o AS (SELECT generation, year, row_number() OVER (PARTITION BY generation ORDER BY year) - 1 AS i,
    count(*) OVER (PARTITION BY generation) AS m FROM j WHERE year IS NOT NULL),
    q AS (SELECT generation, min(CASE WHEN i = least(m - 1, floor(0.25 * m)) THEN year END) AS q1,
    min(CASE WHEN i = least(m - 1, floor(0.5 * m)) THEN year END) AS q2,
    min(CASE WHEN i = least(m - 1, floor(0.75 * m)) THEN year END) AS q3 FROM o GROUP BY 1)
    SELECT generation, count(*) AS persons, count(year) AS dated, CAST(sum(n) AS BIGINT) AS links, q1, q2, q3
    FROM j JOIN q USING (generation) GROUP BY generation, q1, q2, q3""")
def corpus_listed_generations(spark, d):
    listed = X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 5).alias("generation"),
        F.when(F.col("c_custkey") % 3 == 0, (100 + F.col("c_custkey") % 50).cast("int")).alias("year"))
    persons = X.persons(spark, d)
    return C.listed_generations(listed, persons, C.use_counts(X.person_uses(spark, d), persons))


@query("corpus_by_century", "persons", """SELECT CAST(floor((death_year - 1) / 100) + 1 AS INTEGER) AS century,
    count(*) AS persons FROM persons WHERE death_year IS NOT NULL GROUP BY 1""")
def corpus_by_century(spark, d):
    return C.by_century(X.persons(spark, d))


@query("corpus_group_members", "links chains persons", """m AS (SELECT person_id FROM persons WHERE generation = 1)
    SELECT person_id, count(l.position) AS links, count(DISTINCT report_id) AS reports FROM m LEFT JOIN links l
    USING (person_id) LEFT JOIN chains USING (chain_id) GROUP BY 1""")
def corpus_group_members(spark, d):
    members = X.persons(spark, d).where(F.col("generation") == 1).select("person_id")
    return C.group_members(members, X.person_uses(spark, d), X.chains(spark, d))


@query("corpus_totals", "reports", """SELECT collection, language, count(DISTINCT report_id) AS reports, count(*) AS texts
    FROM reports GROUP BY ROLLUP (collection, language)""")
def corpus_totals(spark, d):
    return C.totals(X.reports(spark, d))


@query("corpus_collections_with_raters", "reports_o", REPORT_RATINGS + """ SELECT collection, count(*) AS raters FROM (
    SELECT collection, rater FROM report_ratings JOIN reports_o USING (report_id) GROUP BY ALL HAVING count(*) >= 20)
    GROUP BY 1""")
def corpus_collections_with_raters(spark, d):
    return C.collections_with_raters(report_ratings(spark, d), X.reports_o(spark, d))


@query("corpus_critic_profile", "", """SELECT s_nationkey % 4 AS critic, CAST(least(12, 1 + floor((s_acctbal + 1000) / 917))
    AS INTEGER) AS rank, CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE 'y' END AS creed, count(*) AS verdicts FROM supplier
    GROUP BY ALL""")
def corpus_critic_profile(spark, d):
    persons = X.persons(spark, d).select("person_id", "rank")
    verdicts = X.table(spark, d, "supplier").join(persons, F.col("s_suppkey") == F.col("person_id")).select(
        (F.col("s_nationkey") % 4).alias("critic"), "rank",
        F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise("y").alias("creed"))
    return C.critic_profile(verdicts)


@query("corpus_person_card", "links chains persons", COUNTS + ", " + EDGES + """, t AS (SELECT src AS person_id,
    count(*) AS teachers FROM edges GROUP BY 1), s AS (SELECT dst AS person_id, count(*) AS students FROM edges GROUP BY 1),
    v AS (SELECT l_suppkey AS person_id, min_by(l_returnflag || l_linestatus, l_orderkey * 1000000 + l_partkey) AS first_verdict
    FROM lineitem GROUP BY 1)
    SELECT person_id, name, links, reports, coalesce(teachers, 0) AS teachers, coalesce(students, 0) AS students,
    first_verdict FROM cnt LEFT JOIN t USING (person_id) LEFT JOIN s USING (person_id) LEFT JOIN v USING (person_id)""")
def corpus_person_card(spark, d):
    verdicts = X.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("person_id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("verdict_id"),
        F.concat("l_returnflag", "l_linestatus").alias("phrase"))
    return C.person_card(person_counts(spark, d), G.degrees(G.edges(X.links(spark, d))), verdicts)


@query("corpus_fingerprint", "reports_o persons", """f AS (SELECT 'persons|' || count(*) || '|' || max(person_id) || '|'
    || CAST(sum(person_id) AS BIGINT) AS a FROM persons), g AS (SELECT 'reports|' || count(*) || '|' || max(report_id) ||
    '|' || CAST(sum(report_id) AS BIGINT) AS b FROM reports_o) SELECT 'corpus-1#all#' || a || ';' || b AS state,
    sha256('corpus-1#all#' || a || ';' || b) AS fingerprint FROM f, g""")
def corpus_fingerprint(spark, d):
    return C.fingerprint({"reports": (X.reports_o(spark, d), "report_id"), "persons": (X.persons(spark, d), "person_id")},
                         "all", "corpus-1")


@query("corpus_roles_present", "", """SELECT s_suppkey AS person_id,
    s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS has_collection,
    s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AS has_ratings,
    s_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS has_verdicts FROM supplier""")
def corpus_roles_present(spark, d):
    pick = lambda name, key, keep: X.table(spark, d, name).where(keep).select(F.col(key).alias("person_id"))
    return C.roles_present(X.persons(spark, d).select("person_id"), pick("customer", "c_custkey", F.col("c_acctbal") > 0),
                           pick("lineitem", "l_suppkey", F.col("l_returnflag") == "R"),
                           pick("part", "p_partkey", F.col("p_size") > 25))


@query("corpus_alias_owners", "links", """a AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS alias, l_suppkey AS person_id
    FROM lineitem),
    u AS (SELECT person_id, count(*) AS links FROM links WHERE person_id IS NOT NULL GROUP BY 1),
    h AS (SELECT alias, person_id, coalesce(links, 0) AS links, row_number() OVER (PARTITION BY alias
    ORDER BY coalesce(links, 0) DESC, person_id) AS rn, count(*) OVER (PARTITION BY alias) AS holders,
    lead(coalesce(links, 0)) OVER (PARTITION BY alias ORDER BY coalesce(links, 0) DESC, person_id) AS nxt FROM a LEFT JOIN u
    USING (person_id)) SELECT alias, person_id, links, holders FROM h WHERE rn = 1 AND (holders = 1 OR (links >= 10
    AND links >= 2 * nxt))""")
def corpus_alias_owners(spark, d):
    aliases = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("alias"), F.col("l_suppkey").alias("person_id")).distinct()
    uses = C.use_counts(X.person_uses(spark, d), X.persons(spark, d))
    return C.alias_owners(aliases, uses)
