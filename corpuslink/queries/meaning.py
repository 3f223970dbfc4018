"""Meaning search (M) over the given tables."""

from pyspark.sql import functions as F

from corpuslink.operators import meaning as M
from corpuslink.plans import fixtures as X
from corpuslink.queries.registry import query, r6
from corpuslink.queries.relations import TOKS
from corpuslink.session import frozen


def learnt(spark, d):
    counts = frozen(M.word_counts(X.reports(spark, d)))
    documents = X.reports(spark, d).agg(F.countDistinct("report_id").alias("n"))
    vocabulary = frozen(M.learn_vocabulary(counts, documents))
    return vocabulary, frozen(M.tfidf(counts, vocabulary))


WEIGHTS = TOKS + """, tf AS MATERIALIZED (SELECT report_id AS doc, word, count(*) AS tf FROM wd GROUP BY ALL), dfm AS MATERIALIZED (SELECT word, count(*) AS df FROM tf GROUP BY 1
    HAVING count(*) >= 3 AND count(*) <= 0.4 * (SELECT count(*) FROM n)), voc AS (SELECT word, ln((1 + (SELECT count(*) FROM n)) / (1 + df)) + 1 AS idf FROM dfm),
    w0 AS (SELECT doc, word, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (word)), mx AS (SELECT doc, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w0)"""


@query("meaning_vocabulary", "reports", WEIGHTS + " SELECT word, round(idf, 6) AS idf FROM voc")
def meaning_vocabulary(spark, d):
    return learnt(spark, d)[0].select("word", r6("idf").alias("idf"))


@query("meaning_weights", "reports", WEIGHTS + " SELECT doc, count(*) AS words, round(sum(w), 6) AS total, round(max(w), 6) AS top FROM mx GROUP BY 1")
def meaning_weights(spark, d):
    return learnt(spark, d)[1].groupBy("doc").agg(F.count(F.lit(1)).alias("words"), r6(F.sum("w")).alias("total"), r6(F.max("w")).alias("top"))


QUERIES = [(1, "einheit und schaft"), (2, "the nation there is"), (3, "que los mente")]


@query("meaning_lexical", "reports", WEIGHTS + """, q AS (SELECT * FROM (VALUES (1, 'einhe'), (1, 'und'), (1, 'schaf'), (2, 'the'), (2, 'natio'), (2, 'there'), (2, 'is'), (3, 'que'), (3, 'los'),
    (3, 'mente')) t(query_id, word)), qw AS (SELECT query_id, word, idf / sqrt(sum(idf * idf) OVER (PARTITION BY query_id)) AS w FROM q JOIN voc USING (word))
    SELECT query_id, doc, round(sum(qw.w * mx.w), 6) AS score FROM qw JOIN mx USING (word) GROUP BY ALL""")
def meaning_lexical(spark, d):
    vocabulary, matrix = learnt(spark, d)
    weights, _unknown = M.query_weights(spark.createDataFrame(QUERIES, "query_id int, text string"), vocabulary)
    return (weights.select("query_id", "word", F.col("w").alias("_q")).join(matrix, "word").groupBy("query_id", "doc")
            .agg(r6(F.sum(F.col("_q") * F.col("w"))).alias("score")))


@query("meaning_search")
def meaning_search(spark, d):
    counts = frozen(M.word_counts(X.reports(spark, d)))
    documents = X.reports(spark, d).agg(F.countDistinct("report_id").alias("n"))
    rows, words = M.weighted_rows(counts, frozen(M.learn_vocabulary(counts, documents)))
    concepts = M.concepts_of(rows, words, dims=20, steps=3, extra=10)
    points = M.points_of(rows, concepts)
    weights, _unknown = M.query_weights(spark.createDataFrame(QUERIES, "query_id int, text string"), words.select("word", "idf"))
    near = M.vectors(weights, concepts.select("word", "v"), "query_id")
    asked = frozen(weights.join(words, "word").select("query_id", F.col("id").alias("word"), "w"))
    return M.closest(M.hybrid_scores(asked, M.long_rows(rows), near, points))


@query("meaning_embeddings", "", """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    f AS (SELECT label AS query_id, arg_min(v, vec_id) AS q FROM e GROUP BY 1) SELECT query_id, vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY list_cosine_similarity(v, q) DESC, vec_id) AS k FROM e, f) WHERE k <= 10""")
def meaning_embeddings(spark, d):
    rows = X.table(spark, d, "embeddings").select("vec_id", F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.groupBy(F.col("label").alias("query_id")).agg(F.min_by("v", "vec_id").alias("v"))
    return M.nearest_vectors(asked, rows, 10).select("query_id", "vec_id", r6("score").alias("score"))


@query("meaning_state", "reports", "SELECT 'lsa-1|' || count(*) || '|' || max(report_id) AS stamp FROM reports")
def meaning_state(spark, d):
    return M.model_state(X.reports(spark, d), "report_id", "lsa-1")
