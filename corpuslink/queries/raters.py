"""Raters, models and rank tests (I) over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslink.functions import pvalues as V
from corpuslink.operators import corpus as C
from corpuslink.operators import graph as G
from corpuslink.operators import models as M
from corpuslink.operators import rank_tests as T
from corpuslink.operators import raters as R
from corpuslink.plans import fixtures as X
from corpuslink.queries.corpus import ALL, CELLS_L, CELLS_W, EDGES, PROFILE, REPORT_RATINGS, person_counts, profiles, report_ratings
from corpuslink.queries.registry import query, r6
from corpuslink.scale import SCALE_A

PAIR = """pair AS MATERIALIZED (SELECT CAST(x.rater AS VARCHAR) AS a, CAST(y.rater AS VARCHAR) AS b, x.grade AS i, y.grade AS j, count(*) AS n
    FROM {t} x JOIN {t} y ON x.{u} = y.{u} AND CAST(x.rater AS VARCHAR) < CAST(y.rater AS VARCHAR) GROUP BY ALL)"""
AGREE = """, tot AS (SELECT a, b, sum(n) AS n FROM pair GROUP BY ALL), ra AS (SELECT a, b, i AS k, sum(n) AS s FROM pair GROUP BY ALL),
    rb AS (SELECT a, b, j AS k, sum(n) AS s FROM pair GROUP BY ALL),
    ex AS (SELECT a, b, sum(CASE WHEN x.k = y.k THEN x.s * y.s ELSE 0 END) AS e, sum(x.s * y.s * ((x.k - y.k) / 4.0) ** 2) AS w
      FROM ra x JOIN rb y USING (a, b) GROUP BY ALL),
    ag AS (SELECT a, b, CAST(any_value(t.n) AS BIGINT) AS common, sum(CASE WHEN i = j THEN p.n ELSE 0 END) / any_value(t.n) AS po,
      any_value(e) / any_value(t.n) ** 2 AS pe, sum(p.n * ((i - j) / 4.0) ** 2) / any_value(t.n) AS dobs, any_value(w) / any_value(t.n) ** 2 AS dexp,
      sum(CASE WHEN abs(i - j) <= 1 THEN p.n ELSE 0 END) / any_value(t.n) AS one, sum(CASE WHEN i < j THEN p.n ELSE 0 END) / any_value(t.n) AS lo,
      sum(CASE WHEN i > j THEN p.n ELSE 0 END) / any_value(t.n) AS hi FROM pair p JOIN tot t USING (a, b) JOIN ex USING (a, b) GROUP BY ALL)"""


def pats(spark, d):
    return R.patterns(X.ratings(spark, d))


@query("raters_first_ratings", "ratings", "SELECT unit, CAST(rater AS INTEGER) AS rater, grade FROM ratings")
def raters_first_ratings(spark, d):
    return X.ratings(spark, d).select("unit", "rater", "grade")


WORDED = """w AS (SELECT l_partkey AS unit, CAST(l_suppkey % 6 AS INTEGER) AS rater, list_extract(['Mawdu', 'Daif Jiddan', 'Isnaad Daif', 'Hasan', 'Sahih'],
    CAST(floor((l_quantity - 1) / 10) AS INTEGER) + 1) AS wording, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 6 ORDER BY l_orderkey,
    l_linenumber, l_suppkey, l_shipdate, l_quantity) AS rn FROM lineitem)"""


def worded(spark, d):
    words = F.array(*[F.lit(w) for w in ("Mawdu", "Daif Jiddan", "Isnaad Daif", "Hasan", "Sahih")])
    return X.raw_ratings(spark, d).select("unit", "rater", F.element_at(words, F.col("grade") + 1).alias("wording"),
                                          F.struct(*X.RATING_ORDER).alias("place"))


@query("raters_first_worded", "", WORDED + """ SELECT unit, rater, CAST(CASE wording WHEN 'Mawdu' THEN 0 WHEN 'Daif Jiddan' THEN 1 WHEN 'Hasan' THEN 3
    ELSE 4 END AS INTEGER) AS grade FROM w WHERE rn = 1 AND wording <> 'Isnaad Daif'""")
def raters_first_worded(spark, d):
    return R.first_ratings(worded(spark, d))[0]


@query("raters_chain_only", "", WORDED + " SELECT rater, count(*) AS chain_only FROM w WHERE rn = 1 AND wording = 'Isnaad Daif' GROUP BY 1")
def raters_chain_only(spark, d):
    return R.first_ratings(worded(spark, d))[1]


@query("raters_wordings", "", WORDED + """, c AS (SELECT rater, wording, count(*) AS ratings FROM w GROUP BY ALL) SELECT rater, wording, ratings,
    CAST(row_number() OVER (PARTITION BY rater ORDER BY ratings DESC, wording) AS INTEGER) AS place FROM c""")
def raters_wordings(spark, d):
    return R.rater_wordings(worded(spark, d))


@query("raters_pair_tables", "ratings", PAIR.format(t="ratings", u="unit") + " SELECT a, b, i, j, n FROM pair")
def raters_pair_tables(spark, d):
    return R.pair_tables(pats(spark, d))


@query("raters_agreement", "ratings", PAIR.format(t="ratings", u="unit") + AGREE + """ SELECT a, b, common, round(po, 6) AS agree,
    round((po - pe) / (1 - pe), 6) AS kappa, round(1 - dobs / dexp, 6) AS wkappa, round(one, 6) AS within_one, round(lo - hi, 6) + 0.0 AS "order" FROM ag""")
def raters_agreement(spark, d):
    out = R.agreement(R.pair_tables(pats(spark, d)), ["a", "b"])
    return out.select("a", "b", "common", *[r6(c).alias(c) for c in ("agree", "kappa", "wkappa", "within_one", "order")])


@query("raters_label_agreement", "label_ratings", PAIR.format(t="label_ratings", u="unit") + AGREE + """ SELECT a, b, common, round(po, 6) AS agree,
    round((po - pe) / (1 - pe), 6) AS kappa FROM ag""")
def raters_label_agreement(spark, d):
    out = R.agreement(R.pair_tables(R.patterns(X.label_ratings(spark, d))), ["a", "b"])
    return out.select("a", "b", "common", r6("agree").alias("agree"), r6("kappa").alias("kappa"))


@query("raters_profile", "ratings", PAIR.format(t="ratings", u="unit") + AGREE + """ SELECT a, b, common, round(po, 6) AS agree,
    round((po - pe) / (1 - pe), 6) AS kappa, round(one, 6) AS within_one, round(lo, 6) AS lower, round(hi, 6) AS higher FROM ag UNION ALL
    SELECT b, a, common, round(po, 6), round((po - pe) / (1 - pe), 6), round(one, 6), round(hi, 6), round(lo, 6) FROM ag""")
def raters_profile(spark, d):
    out = R.rater_profile(R.pair_tables(pats(spark, d)))
    return out.select("a", "b", "common", *[r6(c).alias(c) for c in ("agree", "kappa", "within_one", "lower", "higher")])


@query("raters_agreement_intervals")
def raters_agreement_intervals(spark, d):
    return R.agreement_intervals(R.pair_tables(pats(spark, d)))


ALPHA = """m AS MATERIALIZED (SELECT unit, count(*) AS m FROM ratings GROUP BY 1 HAVING count(*) >= 2), co AS MATERIALIZED (SELECT x.grade AS c, y.grade AS k,
    sum(1.0 / (m - 1)) AS w FROM ratings x JOIN ratings y ON x.unit = y.unit AND x.rater <> y.rater JOIN m ON m.unit = x.unit GROUP BY ALL),
    nc AS MATERIALIZED (SELECT g, coalesce(sum(w), 0.0) AS n FROM range(0, 5) t(g) LEFT JOIN co ON co.c = g GROUP BY 1),
    de AS MATERIALIZED (SELECT x.g AS c, y.g AS k, x.n AS nx, y.n AS ny, ((SELECT sum(z.n) FROM nc z WHERE z.g BETWEEN least(x.g, y.g) AND
    greatest(x.g, y.g)) - (x.n + y.n) / 2) ** 2 AS d FROM nc x, nc y)"""


@query("raters_alpha", "ratings", ALPHA + """ SELECT round(1 - (SELECT sum(w * d) FROM co JOIN de ON de.c = co.c AND de.k = co.k) /
    ((SELECT sum(nx * ny * d) FROM de) / ((SELECT sum(n) FROM nc) - 1)), 6) AS alpha""")
def raters_alpha(spark, d):
    return R.alpha_of(R.coincidences(pats(spark, d)), []).select(r6("alpha").alias("alpha"))


@query("raters_alpha_interval")
def raters_alpha_interval(spark, d):
    return R.krippendorff(pats(spark, d))


def dawid_skene_sql(rounds: int) -> str:
    parts = ["""r AS MATERIALIZED (SELECT unit, rater, grade FROM ratings), u AS MATERIALIZED (SELECT unit, count(*) AS m FROM r GROUP BY 1),
    q1 AS MATERIALIZED (SELECT u.unit, k, count(r.grade) / any_value(m) AS p FROM u CROSS JOIN range(0, 5) t(k) LEFT JOIN r ON r.unit = u.unit AND r.grade = k GROUP BY ALL)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""pr{i} AS MATERIALIZED (SELECT k, sum(p) / (SELECT count(*) FROM u) AS p FROM q{i} GROUP BY 1),
    c{i} AS MATERIALIZED (SELECT rater, k, g, 0.5 + coalesce(s, 0) AS c FROM (SELECT DISTINCT rater FROM r) CROSS JOIN range(0, 5) a(k)
      CROSS JOIN range(0, 5) b(g) LEFT JOIN (SELECT rater, k, grade AS g, sum(p) AS s FROM r JOIN q{i} USING (unit) GROUP BY ALL) USING (rater, k, g)),
    th{i} AS MATERIALIZED (SELECT rater, k, g, c / sum(c) OVER (PARTITION BY rater, k) AS t FROM c{i}),
    l{i} AS MATERIALIZED (SELECT unit, r2.k, any_value(greatest(pr{i}.p, 1e-12)) * product(t) AS w FROM r JOIN th{i} r2 ON r2.rater = r.rater AND
      r2.g = r.grade JOIN pr{i} ON pr{i}.k = r2.k GROUP BY unit, r2.k),
    q{i + 1} AS MATERIALIZED (SELECT unit, k, w / sum(w) OVER (PARTITION BY unit) AS p FROM l{i})""")
    return ", ".join(parts)


@query("raters_dawid_skene_rounds", "ratings", dawid_skene_sql(4) + """ SELECT CAST(rater AS VARCHAR) AS rater, CAST(k AS INTEGER) AS true_grade,
    CAST(g AS INTEGER) AS grade, round(t, 6) AS theta, round(p, 6) AS prior FROM th4 JOIN pr4 USING (k)""")
def raters_dawid_skene_rounds(spark, d):
    """Four rounds of the EM, to compare the numbers."""
    model = R.dawid_skene(pats(spark, d), iterations=4, tolerance=0.0)
    rows = [(r, k, g, round(t[k][g], 6), round(model.prior[k], 6)) for r, t in model.theta.items() for k in range(R.K) for g in range(R.K)]
    return spark.createDataFrame(rows, "rater string, true_grade int, grade int, theta double, prior double")


@query("raters_consensus_rounds", "ratings", dawid_skene_sql(4) + """, b AS (SELECT unit, max(p) AS c, arg_max(k, p) AS best FROM q5 GROUP BY 1)
    SELECT CASE WHEN c >= 0.95 THEN 'high' WHEN c >= 0.6 THEN 'middle' ELSE 'low' END AS band, count(*) AS units FROM b GROUP BY 1""")
def raters_consensus_rounds(spark, d):
    data = pats(spark, d)
    return R.consensus(data, R.dawid_skene(data, iterations=4, tolerance=0.0))[1]


@query("raters_disputed", "ratings", dawid_skene_sql(4) + """, b AS (SELECT unit, max(p) AS c FROM q5 GROUP BY 1), s AS (SELECT unit, max(grade) - min(grade)
    AS spread, count(*) AS m FROM r GROUP BY 1) SELECT unit, spread, round(c, 6) AS certainty FROM b JOIN s USING (unit) WHERE m >= 2 AND (spread >= 2 OR c < 0.6)
    ORDER BY spread DESC, round(c, 9), unit LIMIT 300""")
def raters_disputed(spark, d):
    data = pats(spark, d)
    return R.disputed(X.ratings(spark, d), data, R.dawid_skene(data, iterations=4, tolerance=0.0)).select("unit", "spread", r6("certainty").alias("certainty"))


@query("raters_strictness")
def raters_strictness(spark, d):
    return R.strictness(pats(spark, d))


@query("raters_kinds", "ratings", """SELECT CAST(rater AS INTEGER) AS rater, count(*) AS ratings, CASE WHEN count(*) < 20 THEN 'few'
    WHEN min(grade) = max(grade) THEN 'selection' ELSE 'rater' END AS kind FROM ratings GROUP BY 1""")
def raters_kinds(spark, d):
    return R.rater_kinds(X.ratings(spark, d))


@query("raters_selections", "ratings", """s AS (SELECT * FROM ratings WHERE rater <> 2 OR grade = 3), k AS (SELECT x.rater AS selection, y.rater, y.grade, count(*) AS units
    FROM s x JOIN s y USING (unit) WHERE x.rater = 2 AND y.rater <> 2 GROUP BY ALL) SELECT * FROM k""")
def raters_selections(spark, d):
    rows = X.ratings(spark, d).where("rater <> 2 or grade = 3")
    return R.selections(rows, R.rater_kinds(rows))


@query("raters_one_voice", "ratings", """n AS (SELECT rater, count(*) AS n FROM ratings GROUP BY 1), t AS (SELECT unit, rater, grade FROM ratings UNION ALL
    SELECT unit, 9, grade FROM ratings WHERE rater = 1 AND unit % 2 = 0), p AS (SELECT x.rater AS a, y.rater AS b, avg(CAST(x.grade = y.grade AS INTEGER)) AS g FROM t x JOIN t y
    USING (unit) WHERE x.rater < y.rater GROUP BY ALL) SELECT CAST(a AS VARCHAR) AS kept, CAST(b AS VARCHAR) AS left_out, round(g, 6) AS agree FROM p WHERE g >= 0.95""")
def raters_one_voice(spark, d):
    base = X.ratings(spark, d)
    rows = base.union(base.where("rater = 1 and unit % 2 = 0").select("unit", F.lit(9).alias("rater"), "grade"))
    pairs = R.agreement(R.pair_tables(R.patterns(rows)), ["a", "b"])
    return R.one_voice(pairs, R.rater_kinds(rows)).withColumn("agree", r6("agree"))


KENDALL = """, ce AS MATERIALIZED (SELECT collection, rater, "row" AS r, "col" AS c, n FROM cells), pq AS (SELECT x.collection, x.rater,
    sum(CASE WHEN y.c > x.c THEN x.n * y.n ELSE 0 END) AS con, sum(CASE WHEN y.c < x.c THEN x.n * y.n ELSE 0 END) AS dis
    FROM ce x JOIN ce y ON x.collection = y.collection AND x.rater = y.rater AND x.r < y.r GROUP BY ALL),
    tr AS (SELECT collection, rater, sum(s * (s - 1) / 2) AS t, sum(s) AS n FROM (SELECT collection, rater, r, sum(n) AS s FROM ce GROUP BY ALL) GROUP BY ALL),
    tc AS (SELECT collection, rater, sum(s * (s - 1) / 2) AS t FROM (SELECT collection, rater, c, sum(n) AS s FROM ce GROUP BY ALL) GROUP BY ALL)
    SELECT collection, rater, CAST(tr.n AS BIGINT) AS n, round((con - dis) / sqrt((tr.n * (tr.n - 1) / 2 - tr.t) * (tr.n * (tr.n - 1) / 2 - tc.t)), 6) + 0.0 AS tau,
    round((con - dis) / (con + dis), 6) + 0.0 AS gamma FROM pq JOIN tr USING (collection, rater) JOIN tc USING (collection, rater)"""


@query("raters_association_weakest", ALL, PROFILE + ", " + CELLS_W + KENDALL)
def raters_association_weakest(spark, d):
    out = R.kendall(C.rating_cells(report_ratings(spark, d), profiles(spark, d), "weakest"), ["collection", "rater"])
    return out.select("collection", "rater", "n", r6("tau").alias("tau"), r6("gamma").alias("gamma"))


@query("raters_association_length", ALL, PROFILE + ", " + CELLS_L + KENDALL)
def raters_association_length(spark, d):
    out = R.kendall(C.rating_cells(report_ratings(spark, d), profiles(spark, d), "length"), ["collection", "rater"])
    return out.select("collection", "rater", "n", r6("tau").alias("tau"), r6("gamma").alias("gamma"))


@query("raters_association_intervals")
def raters_association_intervals(spark, d):
    return R.association(C.rating_cells(report_ratings(spark, d), profiles(spark, d), "weakest"), ["collection", "rater"])


# ------------------------------------------------------------------ models
FEATURES = """lk AS MATERIALIZED (SELECT l.chain_id, l.position, l.person_id, rank, generation, death_year FROM links l
    LEFT JOIN persons USING (person_id)), db AS (SELECT a.chain_id, max(CASE WHEN a.death_year - b.death_year > 110 OR a.death_year - b.death_year < -60 OR
    a.generation < b.generation THEN 1 ELSE 0 END) AS doubtful FROM lk a JOIN lk b ON b.chain_id = a.chain_id AND b.position = a.position + 1 GROUP BY 1),
    ft AS (SELECT report_id, CASE WHEN max(rank) = 1 THEN 0 WHEN max(rank) <= 3 THEN 1 WHEN max(rank) <= 5 THEN 2 WHEN max(rank) = 6 THEN 3 WHEN max(rank) <= 9 THEN 4
    WHEN max(rank) <= 12 THEN 5 ELSE 9 END AS weakest, CAST(greatest(0, count(*) FILTER (WHERE rank >= 7) - 1) AS INTEGER) AS weak_count,
    CAST(count(*) AS INTEGER) AS length, CAST(count(*) - count(person_id) AS INTEGER) AS unidentified, any_value(CASE WHEN reaches THEN 0 ELSE 1 END) AS mawquf,
    coalesce(any_value(doubtful), 0) AS doubtful, 1 AS routes FROM lk JOIN chains USING (chain_id) LEFT JOIN db USING (chain_id) GROUP BY report_id)"""


def features(spark, d):
    none = X.reports_o(spark, d).select("report_id", (F.col("report_id") % 3).alias("relations"))
    return M.unit_features(X.chains(spark, d), X.links(spark, d), X.persons(spark, d), none)


@query("models_unit_features", "links chains persons", FEATURES + " SELECT *, CAST(report_id % 3 AS INTEGER) AS relations FROM ft")
def models_unit_features(spark, d):
    return features(spark, d)


RATERS = 100


def fitted(spark, d):
    """Each rater of the table: (rater, units, kinds, design, grouped, categories, fit), the fit null where there is none. Ratings
    and factors are joined once for all raters, and all but the units themselves is worked out on the kinds, units alike as one row."""
    placed = M.frozen(M.placed_units(report_ratings(spark, d), features(spark, d)))
    every = M.frozen(M.alike(placed, ["rater"]))
    raters = [r["rater"] for r in every.select("rater").distinct().orderBy("rater").limit(RATERS + 1).collect()]
    if len(raters) > RATERS:
        raise ValueError(f"a model is fitted for each of at most {RATERS} raters")
    for rater in raters:
        mine = F.col("rater") == rater
        y, categories = M.categories_of(every.where(mine))
        units, kinds = placed.where(mine).withColumn("y", y).drop("place"), every.where(mine).withColumn("y", y).drop("place")
        design = M.Design(kinds)
        grouped = M.frozen(design.grouped(kinds))
        yield rater, units, kinds, design, grouped, categories, M.fit_ordinal(grouped, categories)


def by_rater(tables):
    """The union of one table per rater, with the rater as the first column."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(rater).alias("rater"), "*") for rater, df in tables if df is not None])


@query("models_coefficients")
def models_coefficients(spark, d):
    return by_rater((rater, M.coefficients(spark, fit, design.columns))
                    for rater, _units, _kinds, design, _grouped, _categories, fit in fitted(spark, d) if fit is not None)


@query("models_factor_tests")
def models_factor_tests(spark, d):
    return by_rater((rater, M.factor_tests(spark, grouped, fit, design.columns, categories))
                    for rater, _units, _kinds, design, grouped, categories, fit in fitted(spark, d) if fit is not None)


def predictions(spark, d):
    """Each rater with the units and the kinds of units as predicted."""
    for rater, units, kinds, design, _grouped, _categories, fit in fitted(spark, d):
        if fit is not None:
            yield rater, M.predicted(units.drop("rater"), design, fit), M.predicted(kinds.drop("rater"), design, fit)


@query("models_accuracy")
def models_accuracy(spark, d):
    return by_rater((rater, M.accuracy(kinds)) for rater, _units, kinds in predictions(spark, d))


@query("models_calibration")
def models_calibration(spark, d):
    return by_rater((rater, M.calibration(units)) for rater, units, _kinds in predictions(spark, d))


def surprises(spark, d):
    return by_rater((rater, M.surprises(units).select("side", "place", "report_id", "y", "likely", "p"))
                    for rater, units, _kinds in predictions(spark, d))


@query("models_surprises")
def models_surprises(spark, d):
    return surprises(spark, d)


@query("models_shared_surprises")
def models_shared_surprises(spark, d):
    return M.shared_surprises(surprises(spark, d))


@query("models_brant")
def models_brant(spark, d):
    return by_rater((rater, M.brant(spark, grouped, categories, [c[0] for c in design.columns]))
                    for rater, _units, _kinds, design, grouped, categories, _fit in fitted(spark, d))


# ------------------------------------------------------------------ rank tests
@query("tests_average_rank", "links persons", """u AS (SELECT person_id, count(*) AS links FROM links JOIN persons USING (person_id) GROUP BY 1)
    SELECT person_id, links, (2 * rank() OVER (ORDER BY links) + count(*) OVER (PARTITION BY links) - 1) / 2.0 AS rank FROM u""".replace("/ 2.0", "/ CAST(2 AS DOUBLE)"))
def tests_average_rank(spark, d):
    uses = C.use_counts(X.person_uses(spark, d), X.persons(spark, d)).select("person_id", "links")
    return T.average_rank(uses, [], "links").select("person_id", "links", F.col("rank").cast("double"))


LAB = EDGES + """, u AS (SELECT person_id, count(*) AS links FROM links WHERE person_id IS NOT NULL GROUP BY 1), te AS (SELECT src AS person_id, count(*) AS teachers FROM edges
    GROUP BY 1), st AS (SELECT dst AS person_id, count(*) AS students FROM edges GROUP BY 1), lab AS (SELECT p.person_id, CAST(rank AS DOUBLE) AS rank,
    CAST(generation AS DOUBLE) AS generation, CAST(death_year AS DOUBLE) AS death_year, CAST(links AS DOUBLE) AS links, CAST(coalesce(teachers, 0) AS DOUBLE) AS teachers,
    CAST(coalesce(students, 0) AS DOUBLE) AS students FROM persons p JOIN u USING (person_id) LEFT JOIN te USING (person_id) LEFT JOIN st USING (person_id))"""
VARIABLES = ["rank", "generation", "death_year", "links", "teachers", "students"]


def lab(spark, d):
    edges = G.edges(X.links(spark, d))
    no_rank = X.persons(spark, d).select("person_id", F.lit(0.0).alias("score"))
    return T.entity_lab(person_counts(spark, d), G.degrees(edges), no_rank)


def spearman_sql() -> str:
    from itertools import combinations
    parts = [f"""SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM lab WHERE {a} IS NOT NULL AND {b} IS NOT NULL""" for a, b in combinations(VARIABLES, 2)]
    return LAB + f""", long AS ({' UNION ALL '.join(parts)}), rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM long)
        SELECT a, b, count(*) AS n, CASE WHEN count(*) >= 10 AND NOT isnan(corr(rx, ry)) THEN round(corr(rx, ry), 6) + 0.0 END AS rho FROM rk GROUP BY ALL"""


@query("tests_spearman", "links chains persons", spearman_sql())
def tests_spearman(spark, d):
    return T.spearman(lab(spark, d), VARIABLES).select("a", "b", "n", r6("rho").alias("rho"))


@query("tests_spearman_p")
def tests_spearman_p(spark, d):
    return T.strongest_pairs(T.spearman(lab(spark, d), VARIABLES)).withColumn("words", V.verbal("strength", F.col("rho")))


@query("tests_partial")
def tests_partial(spark, d):
    rows = lab(spark, d)
    return T.partial_correlations(rows, T.varying(rows, VARIABLES, 30))


@query("tests_adjusted")
def tests_adjusted(spark, d):
    return T.adjusted(lab(spark, d), ["rank", "generation", "teachers", "students"], "links")


@query("tests_entity_lab", "links chains persons", LAB + """ SELECT person_id, CAST(rank AS INTEGER) AS rank, CAST(generation AS INTEGER) AS generation,
    CAST(death_year AS INTEGER) AS death_year, CAST(links AS BIGINT) AS links, CAST(teachers AS BIGINT) AS teachers, CAST(students AS BIGINT) AS students FROM lab""")
def tests_entity_lab(spark, d):
    return lab(spark, d).drop("score")


@query("tests_unit_lab", "links chains persons reports_o", FEATURES + ", " + REPORT_RATINGS + """, pl AS (SELECT report_id, (row_number() OVER (PARTITION BY collection ORDER BY number_sort)
    - 1) / greatest(1, count(*) OVER (PARTITION BY collection) - 1) AS place FROM reports_o), g AS (SELECT report_id, min(4 - grade) FILTER (WHERE rater = 1) AS grade_1,
    min(4 - grade) FILTER (WHERE rater = 2) AS grade_2, CASE WHEN count(*) >= 2 THEN max(4 - grade) - min(4 - grade) END AS disagreement FROM report_ratings WHERE rater IN (1, 2) GROUP BY 1)
    SELECT report_id, CASE WHEN weakest < 9 THEN weakest END AS weakest, length, round(place, 6) AS place, grade_1, grade_2, disagreement FROM ft JOIN pl USING (report_id) LEFT JOIN g USING (report_id)""")
def tests_unit_lab(spark, d):
    from corpuslink.plans.ordered import number_within
    reports = X.reports_o(spark, d)
    sizes = reports.groupBy("collection").agg(F.count(F.lit(1)).alias("_n"))
    places = number_within(reports, ["collection"], [F.col("number_sort"), F.col("report_id")], "_i").join(sizes, "collection").select(
        "report_id", ((F.col("_i") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).alias("place"))
    rows = T.unit_lab(features(spark, d), report_ratings(spark, d), places, [1, 2], SCALE_A.grade_index)
    return rows.select("report_id", "weakest", "length", r6("place").alias("place"), "grade_1", "grade_2", "disagreement")


@query("tests_kruskal", ALL, PROFILE + """, v AS (SELECT collection, length FROM prof WHERE length > 0 AND scale = 'A'), r AS (SELECT collection, length, rank() OVER (ORDER BY length) +
    (count(*) OVER (PARTITION BY length) - 1) / 2.0 AS rk FROM v), n AS (SELECT count(*) AS n FROM v), g AS (SELECT sum(s * s / m) AS h, count(*) AS g FROM (SELECT collection,
    sum(CAST(rk AS DOUBLE)) AS s, count(*) AS m FROM r GROUP BY 1)), t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS t FROM (SELECT count(*) AS c FROM v GROUP BY length)), x AS (SELECT n, g,
    (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * h - 3 * (n + 1)) / (1 - t / (CAST(n AS DOUBLE) ** 3 - n)) AS h FROM n, g, t)
    SELECT n, CAST(g - 1 AS INTEGER) AS df, round(h, 6) AS h, round(h / (n - 1), 6) AS epsilon2 FROM x""")
def tests_kruskal(spark, d):
    rows = profiles(spark, d).where("length > 0 and scale = 'A'")
    return T.kruskal(rows, [], "collection", "length").select("n", "df", r6("h").alias("h"), r6("epsilon2").alias("epsilon2"))


@query("tests_mann_whitney", ALL, PROFILE + """, v AS (SELECT collection AS c, length AS x, count(*) AS n FROM prof WHERE length > 0 GROUP BY ALL), s AS (SELECT c, sum(n) AS m FROM v GROUP BY 1)
    SELECT p.c AS a, q.c AS b, round(CAST(sum(p.n * q.n * CASE WHEN p.x > q.x THEN 1 WHEN p.x = q.x THEN 0.5 ELSE 0 END) AS DOUBLE), 6) AS u,
    round(2 * sum(p.n * q.n * CASE WHEN p.x > q.x THEN 1 WHEN p.x = q.x THEN 0.5 ELSE 0 END) / CAST(any_value(sp.m) * any_value(sq.m) AS DOUBLE) - 1, 6) + 0.0 AS delta
    FROM v p JOIN v q ON p.c < q.c JOIN s sp ON sp.c = p.c JOIN s sq ON sq.c = q.c GROUP BY ALL""")
def tests_mann_whitney(spark, d):
    rows = profiles(spark, d).where("length > 0")
    return T.mann_whitney(rows, "collection", "length").select("a", "b", r6("u").alias("u"), r6("delta").alias("delta"))


@query("tests_mann_whitney_p")
def tests_mann_whitney_p(spark, d):
    out = T.mann_whitney(profiles(spark, d).where("length > 0"), "collection", "length")
    return out.withColumn("words", V.verbal("cliff", F.col("delta")))


@query("tests_stuart_maxwell")
def tests_stuart_maxwell(spark, d):
    return T.stuart_maxwell(R.pair_tables(pats(spark, d)), R.K)
