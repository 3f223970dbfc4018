"""Near-duplicates, parallels and phrases (R) over the given tables."""

from pyspark.sql import functions as F

from corpuslink.functions.rules import VERSES_IN
from corpuslink.functions.text import normalize, normalize_sql
from corpuslink.operators import relations as R
from corpuslink.plans import fixtures as X
from corpuslink.queries.registry import query, r6
from corpuslink.queries.text import NORM, normed

TOKS = NORM + r""", tk AS MATERIALIZED (SELECT report_id, list_filter(list_transform(list_filter(string_split_regex(norm, '\s+'),
    lambda w: w <> ''), lambda w: substr(w, 1, 5)), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')) AS toks FROM n),
    wd AS MATERIALIZED (SELECT report_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS i FROM tk),
    cw AS MATERIALIZED (SELECT word FROM wd GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 150)"""
PAIRS = TOKS + """, pr0 AS (SELECT DISTINCT x.report_id, x.word || ' ' || y.word AS pair FROM wd x JOIN wd y
    ON y.report_id = x.report_id AND y.i = x.i + 1 WHERE NOT (x.word IN (SELECT word FROM cw) AND y.word IN (SELECT word FROM cw))),
    sz AS MATERIALIZED (SELECT report_id, count(*) AS k FROM pr0 GROUP BY 1 HAVING count(*) >= 4),
    pr AS MATERIALIZED (SELECT pr0.* FROM pr0 JOIN sz USING (report_id)),
    tf AS MATERIALIZED (SELECT report_id, word, count(*) AS tf FROM wd WHERE report_id IN (SELECT report_id FROM sz) GROUP BY ALL),
    nn AS MATERIALIZED (SELECT count(*) AS n FROM sz),
    df AS MATERIALIZED (SELECT word, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.05 * (SELECT n FROM nn)),
    w0 AS (SELECT report_id, word, (1 + ln(tf)) * ln((SELECT n FROM nn) / df) AS w FROM tf JOIN df USING (word)),
    ws AS MATERIALIZED (SELECT report_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY report_id)) AS w FROM w0),
    ov AS MATERIALIZED (SELECT a.report_id AS a, b.report_id AS b, count(*) AS k FROM pr a JOIN pr b ON a.pair = b.pair
      AND a.report_id < b.report_id GROUP BY ALL),
    ct AS MATERIALIZED (SELECT a, b, ov.k / least(x.k, y.k) AS c FROM ov JOIN sz x ON x.report_id = a JOIN sz y ON y.report_id = b
      WHERE ov.k / least(x.k, y.k) >= 0.2),
    cs AS MATERIALIZED (SELECT ct.a, ct.b, sum(x.w * y.w) AS cosine FROM ct JOIN ws x ON x.report_id = a JOIN ws y ON
      y.report_id = b AND y.word = x.word GROUP BY ALL),
    rel AS MATERIALIZED (SELECT a, b, c FROM ct JOIN cs USING (a, b) WHERE cosine >= 0.25)"""


def texts(spark, d):
    return X.reports(spark, d).select("report_id", "text")


def origins(spark, d):
    return X.reports(spark, d).select("report_id", F.when(F.length("text") % 3 != 0, F.length("text") % 7).alias("origin"))


@query("relations_common_words", "reports", TOKS + " SELECT word FROM cw")
def relations_common_words(spark, d):
    _copies, every = R.bodies(texts(spark, d))
    return spark.createDataFrame([(w,) for w in R.common_words(every)], "word string")


@query("relations_informative_pairs", "reports", PAIRS + " SELECT report_id, k AS pairs FROM sz")
def relations_informative_pairs(spark, d):
    copies, every = R.bodies(texts(spark, d))
    informative = R.informative_pairs(every, R.common_words(every))
    return copies.join(informative, "body_id").select("report_id", F.size("pairs").cast("long").alias("pairs"))


@query("relations_body_pairs", "reports", PAIRS + """, body AS (SELECT report_id, min(report_id) OVER (PARTITION BY
    array_to_string(toks, ' ')) AS body FROM tk) SELECT a, b, round(c, 6) AS containment FROM rel JOIN body x ON x.report_id = a
    AND x.body = a JOIN body y ON y.report_id = b AND y.body = b""")
def relations_body_pairs(spark, d):
    _copies, _known, pairs = R.related(texts(spark, d))
    return pairs.select("a", "b", r6("containment").alias("containment"))


@query("relations_counts", "reports", PAIRS + """, og AS (SELECT report_id, CASE WHEN length(text) % 3 <> 0 THEN length(text) % 7
    END AS origin FROM reports), two AS (SELECT a, b, c FROM rel UNION ALL SELECT b, a, c FROM rel)
    SELECT s.report_id, count(c) FILTER (WHERE c >= 0.5) AS same,
    count(c) FILTER (WHERE c < 0.5 AND x.origin = y.origin) AS same_report FROM sz s LEFT JOIN two ON a = s.report_id
    LEFT JOIN og x ON x.report_id = s.report_id LEFT JOIN og y ON y.report_id = b GROUP BY 1""")
def relations_counts(spark, d):
    copies, known, pairs = R.related(texts(spark, d))
    return R.related_counts(copies, known, pairs, origins(spark, d))


@query("relations_related_reports", "reports", PAIRS + """, og AS (SELECT report_id, CASE WHEN length(text) % 3 <> 0 THEN length(text) % 7
    END AS origin FROM reports), two AS (SELECT a, b, c FROM rel UNION ALL SELECT b, a, c FROM rel)
    SELECT a AS asked, b AS report_id, CASE WHEN c >= 0.5 THEN 'same' ELSE 'same_report' END AS kind, round(c, 3) AS score FROM two
    JOIN og x ON x.report_id = a JOIN og y ON y.report_id = b WHERE c >= 0.5 OR x.origin = y.origin""")
def relations_related_reports(spark, d):
    """The related reports of every report."""
    copies, known, pairs = R.related(texts(spark, d))
    reports = X.reports(spark, d).select("report_id", "collection", F.col("report_id").alias("number_sort"))
    found = R.related_reports(copies, known, pairs, origins(spark, d), reports, X.reports(spark, d).select("report_id"))
    return found.select("asked", "report_id", "kind", "score")


@query("relations_origins", "links chains", """SELECT report_id, arg_max(person_id, position) FILTER (WHERE position = last) AS origin
    FROM (SELECT report_id, person_id, position, max(position) OVER (PARTITION BY chain_id) AS last FROM links JOIN chains
    USING (chain_id)) GROUP BY 1""")
def relations_origins(spark, d):
    return R.origins(X.links(spark, d), X.chains(spark, d))


@query("relations_runs", "reports_o", """m AS (SELECT r.*, o_orderstatus <> 'F' AS goes_on, o_orderpriority < '3' AS head FROM reports_o r
    JOIN orders ON o_orderkey = report_id), i AS (SELECT *, CAST(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY collection
    ORDER BY number_sort ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
    SELECT report_id, collection, run FROM (SELECT *, count(*) OVER p AS k, bool_or(NOT goes_on AND head) OVER p AS h FROM i
    WINDOW p AS (PARTITION BY collection, run)) WHERE h AND k >= 2""")
def relations_runs(spark, d):
    orders = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), "o_orderstatus", "o_orderpriority")
    rows = X.reports_o(spark, d).join(orders, "report_id")
    return R.runs(rows, F.col("o_orderpriority") < "3", F.col("o_orderstatus") != "F").select("report_id", "collection", "run")


@query("relations_best_parallels", "reports passages", NORM + r""", p AS (SELECT item_id AS a, list_distinct(list_filter(
    regexp_extract_all(""" + normalize_sql("text") + r""", '\p{L}+'), lambda w: length(w) > 2)) AS ws FROM passages),
    t AS (SELECT report_id AS b, list_distinct(list_filter(regexp_extract_all(norm, '\p{L}+'), lambda w: length(w) > 2)) AS ws FROM n),
    z AS (SELECT a, b, len(list_intersect(p.ws, t.ws)) AS k, len(list_intersect(p.ws, t.ws)) / least(len(p.ws), len(t.ws)) AS c FROM p, t)
    SELECT b, a AS item, CAST(k AS INTEGER) AS overlap, round(c, 6) AS containment FROM (SELECT *, row_number() OVER (PARTITION BY b
    ORDER BY c DESC, a) AS rn FROM z WHERE k >= 4 AND c >= 0.6) WHERE rn = 1""")
def relations_best_parallels(spark, d):
    items = X.passages(spark, d).select(F.col("item_id").alias("a"), R.word_set(normalize(F.col("text"))).alias("words"))
    others = normed(spark, d).select(F.col("report_id").alias("b"), R.word_set(F.col("norm")).alias("words"))
    return R.best_parallels(items, others).withColumn("containment", r6("containment"))


TAGS = [("any", "A", "any", "einheit"), ("any", "A", "any", "eaux"), ("all", "A", "all", "tion"), ("all", "A", "all", "there"),
        ("head", "B", "head", "mente"), ("chain", "A", "chain", "der"), ("any_b", "B", "any", "que")]
SCALED = NORM + """, s AS (SELECT report_id, collection, CASE WHEN language = 'es' THEN 'B' ELSE 'A' END AS scale, norm,
    substr(norm, 1, 80) AS chain FROM n)"""
TAGGED = SCALED + """, tags AS (SELECT report_id, 'any' AS tag FROM s WHERE scale = 'A' AND (contains(norm, 'einheit') OR
    contains(norm, 'eaux')) UNION ALL SELECT report_id, 'all' FROM s WHERE scale = 'A' AND contains(norm, 'tion') AND
    contains(norm, 'there') UNION ALL SELECT report_id, 'head' FROM s WHERE scale = 'B' AND contains(substr(norm, 1, 400), 'mente')
    UNION ALL SELECT report_id, 'chain' FROM s WHERE scale = 'A' AND contains(chain, 'der') UNION ALL
    SELECT report_id, 'any_b' FROM s WHERE scale = 'B' AND contains(norm, 'que'))"""


def scaled(spark, d):
    return normed(spark, d).select(
        "report_id", "collection", F.when(F.col("language") == "es", "B").otherwise("A").alias("scale"), "norm",
        F.substring("norm", 1, 80).alias("chain"), F.col("report_id").alias("number_sort"))


def tags(spark, d):
    return R.phrase_tags(scaled(spark, d), spark.createDataFrame(TAGS, "tag string, scale string, how string, pattern string"))


@query("relations_phrase_tags", "reports", TAGGED + " SELECT report_id, tag FROM tags")
def relations_phrase_tags(spark, d):
    return tags(spark, d)


@query("relations_tag_summary", "reports", TAGGED + """ SELECT tag, collection, count(*) AS reports, CAST(0 AS BIGINT) AS parallels
    FROM tags JOIN n USING (report_id) GROUP BY GROUPING SETS ((tag, collection), (tag))""")
def relations_tag_summary(spark, d):
    return R.tag_summary(tags(spark, d), X.reports(spark, d))


@query("relations_phrase_counts", "reports", NORM + """ SELECT e AS event, count(report_id) AS texts FROM (VALUES ('one', 'und der'),
    ('one', 'of the'), ('two', 'que la'), ('none', 'zzz')) t(e, p) LEFT JOIN n ON contains(norm, p) GROUP BY 1""".replace(
        "count(report_id)", "count(DISTINCT report_id)"))
def relations_phrase_counts(spark, d):
    phrases = spark.createDataFrame([("one", "und der"), ("one", "of the"), ("two", "que la"), ("none", "zzz")], "event string, phrase string")
    return R.phrase_counts(normed(spark, d), phrases)


@query("relations_mentions", "reports", SCALED + r""", o AS (SELECT report_id, norm, unnest(range(1, len(parts))) AS k, parts FROM (SELECT report_id, norm, string_split(norm, 'the') AS parts FROM s)),
    c AS (SELECT report_id, right(' ' || substr(norm, 1, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 3 * (k - 1) AS BIGINT)), 16) AS before FROM o),
    f AS (SELECT DISTINCT report_id FROM c WHERE NOT regexp_matches(before, '[^\p{L}\p{N}_](of|in)\s.{0,12}$'))
    SELECT scale, count(*) AS texts FROM s WHERE contains(norm, 'en la') OR report_id IN (SELECT report_id FROM f) GROUP BY 1""")
def relations_mentions(spark, d):
    # "the" counts unless "of" or "in" stands in the letters before it; "en la" always counts
    found = R.mentions(scaled(spark, d), ["the", "en la"], "the", ["of", "in"])
    return found.groupBy("scale").agg(F.count(F.lit(1)).alias("texts"))


# a thousand phrases at once: the first twelve letters of every body, in all the others
@query("relations_phrase_table", "reports", NORM + """, p AS (SELECT DISTINCT substr(norm, 1, 12) AS event FROM n WHERE length(norm) >= 12)
    SELECT event, count(DISTINCT report_id) AS texts FROM p JOIN n ON contains(norm, event) GROUP BY 1""")
def relations_phrase_table(spark, d):
    begins = normed(spark, d).where(F.length("norm") >= 12).select(F.substring("norm", 1, 12).alias("event")).distinct()
    return R.phrase_counts(normed(spark, d), begins.withColumn("phrase", F.col("event")))


@query("relations_mentions_by_scale", "reports", SCALED + """, m AS (SELECT * FROM s WHERE contains(norm, 'que la') OR contains(norm, 'of the'))
    SELECT scale, report_id, CAST(place AS INTEGER) AS place, total FROM (SELECT *, row_number() OVER (PARTITION BY scale ORDER BY
    collection, report_id) AS place, count(*) OVER (PARTITION BY scale) AS total FROM m) WHERE place <= 20""")
def relations_mentions_by_scale(spark, d):
    found = R.mentions(scaled(spark, d), ["que la", "of the"], "que", [])
    return R.mentions_by_scale(found, 20).select("scale", "report_id", "place", "total")


FORMULAS = {"of_the": "of the", "und_die": "und (?:die|der)", "que_la": "que l[ao]s?"}
FLAGS = SCALED + r""", f AS (SELECT report_id, scale, collection, 'of_the' AS formula FROM s WHERE regexp_matches(norm,
    '(^|[^\p{L}\p{N}_])of the([^\p{L}\p{N}_]|$)') UNION ALL SELECT report_id, scale, collection, 'und_die' FROM s WHERE
    regexp_matches(norm, '(^|[^\p{L}\p{N}_])und (die|der)([^\p{L}\p{N}_]|$)') UNION ALL SELECT report_id, scale, collection, 'que_la'
    FROM s WHERE regexp_matches(norm, '(^|[^\p{L}\p{N}_])que l[ao]s?([^\p{L}\p{N}_]|$)'))"""


@query("relations_formula_census", "reports", FLAGS + " SELECT scale, formula, collection, count(*) AS reports FROM f GROUP BY ALL")
def relations_formula_census(spark, d):
    return R.formula_census(R.formula_flags(scaled(spark, d), FORMULAS))[0]


@query("relations_formula_examples", "reports", FLAGS + """ SELECT scale, formula, CAST(place AS INTEGER) AS place, report_id FROM (
    SELECT *, row_number() OVER (PARTITION BY scale, formula ORDER BY collection, report_id) AS place FROM f) WHERE place <= 4""")
def relations_formula_examples(spark, d):
    return R.formula_census(R.formula_flags(scaled(spark, d), FORMULAS))[1]


CITED = """c AS (SELECT o_orderkey AS report_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 120 WHEN 1 THEN o_custkey % 100 END AS chapter,
    CASE o_orderkey % 3 WHEN 0 THEN 1 + o_custkey % 40 WHEN 1 THEN 1 + o_orderkey % 9 END AS first,
    CASE o_orderkey % 3 WHEN 0 THEN 1 + o_custkey % 40 WHEN 1 THEN 1 + o_orderkey % 9 + o_custkey % 5 END AS last FROM orders),
    cited AS (SELECT report_id, CAST(chapter AS INTEGER) AS chapter, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last
    FROM c WHERE chapter BETWEEN 1 AND 114 AND last <= list_extract([{lengths}], CAST(chapter AS INTEGER)))"""
CITED = CITED.replace("{lengths}", ", ".join(map(str, VERSES_IN)))


def cited(spark, d):
    """Every order's keys written as a citation in words: with a colon, a range, or a bare fraction that is none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    mark = (F.when(k % 3 == 0, F.concat(F.lit("see ("), s(k % 120), F.lit(":"), s(1 + c % 40), F.lit(") there")))
            .when(k % 3 == 1, F.concat(F.lit("[Name "), s(c % 100), F.lit("/"), s(1 + k % 9), F.lit("-"), s(1 + k % 9 + c % 5), F.lit("]")))
            .otherwise(F.concat(F.lit("a part ("), s(k % 9), F.lit("/"), s(c % 9), F.lit(") only"))))
    return R.citations(X.table(spark, d, "orders").select(k.alias("report_id"), mark.alias("text")))


@query("relations_citations", "", CITED + " SELECT * FROM cited")
def relations_citations(spark, d):
    return cited(spark, d)


@query("relations_verse_citations", "", CITED + """, v AS (SELECT DISTINCT chapter, unnest(range(first, last + 1)) AS verse, report_id
    FROM cited) SELECT chapter, CAST(verse AS INTEGER) AS verse, count(*) AS reports FROM v GROUP BY ALL""")
def relations_verse_citations(spark, d):
    return R.verse_citations(cited(spark, d)).groupBy("chapter", "verse").agg(F.count(F.lit(1)).alias("reports"))


@query("relations_citations_by_chapter", "", CITED + " SELECT chapter, count(DISTINCT report_id) AS reports FROM cited GROUP BY 1")
def relations_citations_by_chapter(spark, d):
    return R.citations_by_chapter(cited(spark, d))

