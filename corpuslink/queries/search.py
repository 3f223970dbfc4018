"""Search (Q) over the given tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.functions.text import normalize, normalize_sql
from corpuslink.operators import graph as G
from corpuslink.operators import people as P
from corpuslink.operators import search as S
from corpuslink.plans import fixtures as X
from corpuslink.queries.corpus import report_ratings
from corpuslink.plans.stored import stored
from corpuslink.queries.registry import query
from corpuslink.queries.text import NORM, folded, normed

VOCAB = r"v AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(norm, '[\p{L}\p{N}_]+')) AS word FROM n) GROUP BY 1)"


def vocab(spark, d):
    """The stored table of words (Q3)."""
    return stored(spark, "words", X.table(spark, d, "documents"), lambda: S.vocabulary(normed(spark, d)))


@query("search_vocabulary", "reports", f"{NORM}, {VOCAB} SELECT word, n FROM v")
def search_vocabulary(spark, d):
    return S.vocabulary(folded(spark, d))


@query("search_vocabulary_merged", "reports", f"{NORM}, {VOCAB} SELECT word, n FROM v")
def search_vocabulary_merged(spark, d):
    texts = normed(spark, d)
    return S.merged_vocabulary(S.vocabulary(texts.where("language = 'en'")), S.vocabulary(texts.where("language <> 'en'")))


@query("search_new_texts", "reports", NORM + " SELECT report_id, length(norm) AS letters FROM n WHERE language <> 'en'")
def search_new_texts(spark, d):
    texts = X.reports(spark, d)
    return S.normalized_texts(texts, texts.where("language = 'en'")).select("report_id", F.length("norm").alias("letters"))


@query("search_trigrams", "reports", NORM + """, c AS (SELECT report_id, string_split(norm, '') AS c FROM n
    WHERE length(norm) >= 3), g AS (SELECT report_id, unnest(list_distinct([c[i] || c[i + 1] || c[i + 2] for i in
    range(1, len(c) - 1)])) AS gram FROM c) SELECT gram, count(*) AS texts FROM g GROUP BY 1""")
def search_trigrams(spark, d):
    return S.trigrams(normed(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))


ASKED = [(1, "einheit"), (1, "chung"), (2, "mente"), (3, "eaux"), (4, "thing")]
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in ASKED) + ") t(query_id, term))"


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, term string")


@query("search_trigram_candidates", "reports", f"""{NORM}, {ASKED_SQL}, g AS (SELECT query_id, term, substr(term, i, 3) AS gram
    FROM asked, range(1, length(term) - 1) t(i)) SELECT query_id, term, report_id FROM g JOIN n ON contains(norm, gram)
    GROUP BY ALL HAVING count(DISTINCT gram) = length(term) - 2""")
def search_trigram_candidates(spark, d):
    return S.trigram_candidates(asked(spark), S.trigrams(normed(spark, d)))


def hits(spark, d, **kw):
    texts = normed(spark, d)
    return S.search(texts, vocab(spark, d), S.SearchParams(**kw))[0].select("report_id", "collection", "language")


HIT = " SELECT report_id, collection, language FROM n WHERE "


@query("search_all", "reports", NORM + HIT + "contains(norm, 'einheit') AND contains(norm, 'chung')")
def search_all(spark, d):
    return hits(spark, d, text="Einheit chung!")


@query("search_any", "reports", NORM + HIT + "contains(norm, 'einheit') OR contains(norm, 'iones') OR contains(norm, 'eaux')")
def search_any(spark, d):
    return hits(spark, d, text="einheit ÍONES eaux", mode="any")


@query("search_phrase", "reports", NORM + HIT + r"regexp_matches(norm, 'of[^\p{L}\p{N}_]+the')")
def search_phrase(spark, d):
    return hits(spark, d, text="of, the", mode="phrase")


@query("search_whole_words", "reports", NORM + HIT + r"""regexp_matches(norm, '(^|[^\p{L}\p{N}_])was([^\p{L}\p{N}_]|$)')
    AND regexp_matches(norm, '(^|[^\p{L}\p{N}_])this([^\p{L}\p{N}_]|$)')""")
def search_whole_words(spark, d):
    return hits(spark, d, text="was this", whole_words=True)


@query("search_whole_phrase", "reports", NORM + HIT +
       r"regexp_matches(norm, '(^|[^\p{L}\p{N}_])de[^\p{L}\p{N}_]+la([^\p{L}\p{N}_]|$)')")
def search_whole_phrase(spark, d):
    return hits(spark, d, text="de la", mode="phrase", whole_words=True)


@query("search_wildcard", "reports", f"""{NORM}, {VOCAB}, a AS (SELECT word FROM v WHERE regexp_full_match(word, 'th.t.*')
    ORDER BY n DESC, word LIMIT 30)""" + """ SELECT report_id, collection, language FROM n WHERE EXISTS (SELECT 1 FROM a
    WHERE contains(norm, word))""")
def search_wildcard(spark, d):
    return hits(spark, d, text="th?t*")


@query("search_near", "reports", f"""{NORM}, {VOCAB}, a AS (SELECT word FROM v WHERE levenshtein(word, 'einheitx') <= 1
    AND length(word) >= 3 ORDER BY n DESC, word LIMIT 30) SELECT report_id, collection, language FROM n
    WHERE EXISTS (SELECT 1 FROM a WHERE contains(norm, word))""")
def search_near(spark, d):
    return hits(spark, d, text="einheitx")


@query("search_filters", "reports", NORM + HIT + """contains(norm, 'the') AND language IN ('en', 'fr')
    AND collection IN ('src0', 'src1', 'src2', 'src3')""")
def search_filters(spark, d):
    return hits(spark, d, text="the", languages=("en", "fr"), collections=("src0", "src1", "src2", "src3"))


@query("search_active", "reports", NORM + HIT + "contains(norm, 'lich') AND length(collection) % 2 = 1")
def search_active(spark, d):
    found = normed(spark, d).where(S.matches([["lich"]], "all", False))
    active = found.select("collection").distinct().withColumn("active", F.length("collection") % 2 == 1)
    return S.active_only(found, active).select("report_id", "collection", "language")


MANY = [(1, "einheit"), (2, "einhextx"), (3, "thatq"), (3, "this"), (4, "zzzzqq"), (5, "eau?"), (6, "tionx"), (6, "shx")]
MANY_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in MANY) + ") t(query_id, term))"


@query("search_ladder", "reports", f"""{NORM}, {VOCAB}, {MANY_SQL},
    m AS (SELECT query_id, term, contains(term, '?') AS wild, term IN (SELECT word FROM v) AS known FROM asked),
    c AS (SELECT l AS level, query_id, term, word, n FROM m, v, range(0, 3) t(l) WHERE (wild AND regexp_full_match(word,
      replace(term, '?', '.'))) OR (NOT wild AND length(term) >= 3 AND length(word) >= 3 AND word <> term AND
      (l = 2 OR (l = 1 AND NOT known)) AND levenshtein(word, term) <= 1)),
    b AS (SELECT level, query_id, term, word AS alt FROM (SELECT *, row_number() OVER (PARTITION BY level, query_id, term
      ORDER BY n DESC, word) AS k FROM c) WHERE k <= 30 UNION SELECT l, query_id, term, term FROM m, range(0, 3) t(l)
      WHERE NOT wild),
    z AS (SELECT query_id, count(*) AS k FROM asked GROUP BY 1),
    h AS (SELECT level, b.query_id, report_id FROM b JOIN z USING (query_id) JOIN n ON contains(norm, alt)
      GROUP BY level, b.query_id, report_id, k HAVING count(DISTINCT term) = k)
    SELECT query_id, CAST(level AS INTEGER) AS level, report_id FROM h WHERE level = (SELECT min(level) FROM h y
      WHERE y.query_id = h.query_id)""")
def search_ladder(spark, d):
    texts = normed(spark, d)
    return S.search_many(texts, vocab(spark, d), spark.createDataFrame(MANY, "query_id int, term string"))


@query("search_passages", "reports passages", NORM + r""", t AS (SELECT report_id, ' ' || array_to_string(
    regexp_extract_all(norm, '[\p{L}\p{N}_]+'), ' ') || ' ' AS line FROM n),
    p AS (SELECT item_id AS phrase_id, ' ' || array_to_string(regexp_extract_all(""" +
       normalize_sql("text") + r""", '[\p{L}\p{N}_]+'), ' ') || ' ' AS said
    FROM passages) SELECT phrase_id, report_id FROM p JOIN t ON contains(line, said)""")
def search_passages(spark, d):
    phrases = X.passages(spark, d).select(F.col("item_id").alias("phrase_id"), normalize(F.col("text")).alias("norm"))
    return S.phrases_in_texts(phrases, normed(spark, d))


@query("search_parts", "reports", NORM + r""", p AS (SELECT DISTINCT substr(string_split(p_name, ' ')[1], 2, CAST(2 + p_partkey % 4 AS INTEGER)) AS said FROM part),
    t AS (SELECT report_id, ' ' || array_to_string(regexp_extract_all(norm, '[\p{L}\p{N}_]+'), ' ') || ' ' AS line FROM n)
    SELECT said AS phrase_id, count(*) AS texts FROM p JOIN t ON contains(line, said) WHERE said <> '' GROUP BY 1""")
def search_parts(spark, d):
    """Parts of words looked up through the words that hold them."""
    said = X.table(spark, d, "part").select(F.expr("substring(split(p_name, ' ')[0], 2, int(2 + p_partkey % 4))").alias("norm")).distinct()
    found = S.phrases_in_texts(said.select(F.col("norm").alias("phrase_id"), "norm"), normed(spark, d), whole_words=False)
    return found.groupBy("phrase_id").agg(F.count("*").alias("texts"))


WORDING = {4: "Sahih", 3: "Hasan", 2: "Daif", 1: "Daif Jiddan", 0: "Mawdu"}
WORDING_B = {4: "صحيح", 3: "حسن", 2: "موثق", 1: "ضعيف", 0: "كالسابق"}


def scaled_reports(spark, d):
    return X.reports_o(spark, d).join(X.collections(spark, d), "collection").select("report_id", "collection", "scale")


def worded(spark, d):
    """The ratings in words of the report's own scale."""
    pick = lambda table: F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col("grade")]
    rows = report_ratings(spark, d).join(scaled_reports(spark, d), "report_id")
    return rows.select("report_id", "rater", F.when(F.col("scale") == "B", pick(WORDING_B)).otherwise(pick(WORDING)).alias("grade"))


RATED = """w AS (SELECT r.report_id, r.collection, scale, CASE WHEN scale = 'B' THEN CASE grade WHEN 4 THEN 'imami-sahih'
    WHEN 3 THEN 'imami-hasan' WHEN 2 THEN 'muwaththaq' WHEN 1 THEN 'imami-daif' END ELSE CASE grade WHEN 4 THEN 'sahih'
    WHEN 3 THEN 'hasan' WHEN 2 THEN 'daif' WHEN 1 THEN 'very-weak' ELSE 'fabricated' END END AS code
    FROM reports_o r JOIN collections USING (collection) JOIN report_ratings USING (report_id)),
    g AS (SELECT r.report_id, r.collection, k.scale, count(w.report_id) AS given, count(w.code) AS known,
    coalesce(bool_or(code IN ('sahih', 'hasan', 'ungraded', 'muwaththaq')), false) AS any_of,
    coalesce(bool_and(code IS NULL OR code IN ('sahih', 'hasan', 'ungraded', 'muwaththaq')), true) AS all_of
    FROM reports_o r JOIN collections k USING (collection) LEFT JOIN w ON w.report_id = r.report_id GROUP BY ALL)"""


def rated_query(every: bool):
    from corpuslink.queries.corpus import REPORT_RATINGS
    test = "all_of" if every else "any_of"
    sql = f"""{REPORT_RATINGS}, {RATED} SELECT report_id, collection, scale FROM g WHERE CASE WHEN given = 0 AND scale = 'A'
        AND collection IN ('MACHINERY') THEN true WHEN known = 0 THEN scale = 'A' ELSE {test} END"""

    @query("search_rated_every" if every else "search_rated_any", "reports_o collections", sql)
    def run(spark, d):
        reports = scaled_reports(spark, d)
        codes = S.rating_codes(worded(spark, d), reports)
        return S.rated_reports(reports, codes, ["sahih", "hasan", "ungraded", "muwaththaq"], every, ("MACHINERY",))


rated_query(False)
rated_query(True)


@query("search_under_nodes", "nodes", """c AS (SELECT node_id FROM nodes WHERE node_id IN ('r1', 'n7') UNION ALL
    SELECT n.node_id FROM c JOIN nodes n ON n.parent_id = c.node_id)
    SELECT o_orderkey AS report_id FROM orders WHERE 'o' || o_orderkey IN (SELECT node_id FROM c)""")
def search_under_nodes(spark, d):
    tree = X.nodes(spark, d)
    leaves = G.leaves_under(tree, tree.where("node_id in ('r1', 'n7')").select("node_id"), "order")
    reports = X.reports_o(spark, d).select("report_id")
    return S.under_nodes(reports, leaves.select(F.col("label").cast("long").alias("report_id")))


@query("search_page", "reports", NORM + """, h AS (SELECT * FROM n WHERE contains(norm, 'tion')) SELECT report_id, collection,
    (SELECT count(*) FROM h) AS total FROM h ORDER BY length(collection), collection, report_id LIMIT 25 OFFSET 50""")
def search_page(spark, d):
    found = normed(spark, d).where(S.matches([["tion"]], "all", False)).withColumn("number_sort", F.col("report_id"))
    names = found.select("collection").distinct()
    order = names.withColumn("place", F.concat(F.lpad(F.length("collection").cast("string"), 3, "0"), "collection"))
    order = order.select("collection", F.dense_rank().over(
        W.orderBy("place")).alias("place"))  # collections: a few dozen
    return S.page(found, order, 50, 25).select("report_id", "collection", "total")


@query("search_highlights", "reports", NORM + """, h AS (SELECT report_id, text, string_split(norm, 'tion') AS parts FROM n WHERE contains(norm, 'tion')),
    m AS (SELECT report_id, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 4 * (k - 1) AS BIGINT) AS p FROM (SELECT report_id, parts, unnest(range(1, len(parts))) AS k FROM h)),
    u AS (SELECT report_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS i FROM h), f AS (SELECT ch, length({FOLD}) AS n FROM (SELECT DISTINCT ch FROM u)),
    c AS (SELECT report_id, i, CAST(sum(f.n) OVER (PARTITION BY report_id ORDER BY i) AS BIGINT) AS upto FROM u JOIN f USING (ch)),
    a AS (SELECT m.report_id, p, i AS start FROM m ASOF JOIN c ON c.report_id = m.report_id AND m.p < c.upto),
    e AS (SELECT m.report_id, p, i AS stop FROM m ASOF LEFT JOIN c ON c.report_id = m.report_id AND m.p + 4 < c.upto)
    SELECT a.report_id, CAST(sum(coalesce(stop, length(text)) - start) AS INTEGER) AS letters, CAST(min(start) AS INTEGER) AS first_start FROM a JOIN e USING (report_id, p) JOIN h ON h.report_id = a.report_id GROUP BY 1""".replace(
        "{FOLD}", normalize_sql("ch")))
def search_highlights(spark, d):
    found = normed(spark, d).where(S.matches([["tion"]], "all", False))
    marked = S.highlighted(found, ["tion"])
    # marks that touch are shown as one: their letters are counted
    letters = F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"])
    return marked.select("report_id", letters.alias("letters"), F.element_at("spans", 1)["start"].alias("first_start"))


@query("search_assembled", "reports", """SELECT r.report_id, CAST(count(*) AS INTEGER) AS texts, first(r.language) AS language,
    CAST(any_value((SELECT count(*) FROM labels l WHERE l.doc_id = r.report_id)) AS INTEGER) AS ratings
    FROM reports r GROUP BY 1""")
def search_assembled(spark, d):
    texts = X.reports(spark, d)
    ratings = X.table(spark, d, "labels").select(F.col("doc_id").alias("report_id"), F.lit("quality").alias("rater"),
                                                 F.col("quality").alias("grade"))
    rows = S.assembled(texts.select("report_id"), texts, ratings, "en")
    return rows.select("report_id", F.size("texts").alias("texts"), F.element_at("texts", 1)["language"].alias("language"),
                       F.when(F.col("ratings").isNull(), 0).otherwise(F.size("ratings")).alias("ratings"))


@query("search_spelling_report", "reports", f"""{NORM}, {VOCAB}, a AS (SELECT word FROM v WHERE regexp_full_match(word, 'sch.*')
    ORDER BY n DESC, word LIMIT 30) SELECT (SELECT min(word) FROM a) AS word, word AS spelling FROM a WHERE word IN (
    SELECT unnest(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+')) FROM n WHERE EXISTS (SELECT 1 FROM a x WHERE contains(norm, x.word)))""")
def search_spelling_report(spark, d):
    texts = normed(spark, d)
    found, terms = S.search(texts, vocab(spark, d), S.SearchParams("sch*"))
    return S.spelling_report(found, terms)


@query("search_collection_ends", "reports_o", """SELECT collection, min(report_id) AS first, max(report_id) AS last,
    count(*) AS reports FROM reports_o GROUP BY 1""")
def search_collection_ends(spark, d):
    return S.ends_of(X.reports_o(spark, d))


@query("search_number_prefix", "reports_o", "SELECT report_id, collection FROM reports_o WHERE starts_with(CAST(report_id AS VARCHAR), '12')")
def search_number_prefix(spark, d):
    return S.with_prefix(X.reports_o(spark, d), "report_id", "12").select("report_id", "collection")


@query("search_neighbours", "reports_o", """SELECT report_id, collection, row_number() OVER w AS n,
    lag(report_id) OVER w AS previous, lead(report_id) OVER w AS next FROM reports_o
    WINDOW w AS (PARTITION BY collection ORDER BY number_sort, report_id)""")
def search_neighbours(spark, d):
    return S.neighbours(X.reports_o(spark, d)).select("report_id", "collection", F.col("n").cast("long"), "previous", "next")


@query("search_nearest", "reports_o", """a AS (SELECT DISTINCT collection, w AS wanted FROM reports_o, (VALUES (777), (123456)) t(w))
    SELECT a.collection, CAST(wanted AS BIGINT) AS wanted, arg_min(report_id, abs(number_sort - wanted) * 1000000 + number_sort)
    AS report_id FROM a JOIN reports_o r USING (collection) GROUP BY ALL""")
def search_nearest(spark, d):
    reports = X.reports_o(spark, d)
    asked = X.collections(spark, d).select("collection", F.explode(F.array(F.lit(777).cast("long"), F.lit(123456).cast("long"))).alias("wanted"))
    return S.nearest(reports, asked)


@query("search_random")
def search_random(spark, d):
    reports = X.reports_o(spark, d)
    return S.random_report(reports, X.person_uses(spark, d).select(F.col("chain_id").alias("report_id")), 1405)


@query("search_references", "reports_o", """a AS (SELECT 10 * (row_number() OVER (ORDER BY collection) - 1) AS place, collection
    FROM collections), b AS (SELECT report_id, r.collection, number_sort, CASE WHEN number_sort BETWEEN 100 AND 180 THEN 0 ELSE 1
    END AS item, place FROM a JOIN reports_o r USING (collection) WHERE number_sort BETWEEN 100 AND 180 OR number_sort = 501)
    SELECT report_id, collection, number_sort, place, item FROM b""".replace("a AS (", "collections AS (SELECT DISTINCT "
       "c_mktsegment AS collection FROM customer), a AS (", 1))
def search_references(spark, d):
    window = W.orderBy("collection")
    asked = X.collections(spark, d).select(
        (10 * (F.row_number().over(window) - 1)).cast("long").alias("place"),  # one row a collection
        F.concat("collection", F.lit(":100-180, "), "collection", F.lit(":501, "), "collection", F.lit(":150")).alias("reference"))
    return S.resolve_references(asked, X.reports_o(spark, d))


@query("search_collection_list", "reports_o collections", """SELECT collection, scale, count(report_id) AS reports
    FROM collections LEFT JOIN reports_o USING (collection) GROUP BY ALL""")
def search_collection_list(spark, d):
    return S.collection_list(X.reports_o(spark, d), X.collections(spark, d))


@query("search_language_list", "reports", "SELECT collection, language, count(*) AS texts FROM reports GROUP BY ALL")
def search_language_list(spark, d):
    return S.language_list(X.reports(spark, d))


@query("search_chapter_listing", "reports", r"""f AS (SELECT report_id, collection, trim(regexp_replace(text, '\s+', ' ', 'g'))
    AS t FROM reports) SELECT report_id, collection, CASE WHEN length(t) <= 40 THEN t ELSE regexp_replace(substr(t, 1, 40),
    '\s+\S*$', '') || '…' END AS opening, (SELECT count(*) FROM labels WHERE doc_id = report_id) AS links FROM f""")
def search_chapter_listing(spark, d):
    texts = X.reports(spark, d)
    links = X.table(spark, d, "labels").select(F.col("doc_id").alias("report_id"))
    return S.chapter_listing(texts.select("report_id", "collection"), texts, links, ["en", "fr", "de", "es"], 40)


# the sentences of the documents as verses: chapter = document, verse = line
VERSES = NORM + r""", x AS (SELECT report_id AS chapter, language AS edition, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS verse FROM n)"""


def verses(spark, d):
    lines = X.reports(spark, d).select(F.col("report_id").alias("chapter"), F.col("language").alias("edition"),
                                       F.posexplode(F.split("text", "\n")).alias("_p", "text"))
    return lines.select("chapter", "edition", (F.col("_p") + 1).cast("long").alias("verse"), "text",
                        F.lit(False).alias("arabic"), normalize(F.col("text")).alias("norm"))


@query("search_verses", "reports", VERSES + """ SELECT chapter, verse, edition FROM x
    WHERE contains(lower(line), 'tion') AND contains(lower(line), 'the') ORDER BY chapter, verse, edition LIMIT 50""")
def search_verses(spark, d):
    return S.search_verses(verses(spark, d), "tion the", 50).select("chapter", "verse", "edition")


@query("search_verse_range", "reports", VERSES + " SELECT chapter, verse, md5(line) AS digest FROM x WHERE chapter = 5 AND verse BETWEEN 2 AND 6")
def search_verse_range(spark, d):
    return S.verse_range(verses(spark, d), 5, 2, 6).select("chapter", "verse", F.md5("text").alias("digest"))


# ------------------------------------------------------------------ persons
def part_names(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"),
                                            F.lit(True).alias("own"))


@query("people_search", "", """q AS (SELECT * FROM (VALUES (1, 'red'), (2, 'small ring'), (3, 'hot gear')) t(query_id, text)),
    n AS (SELECT p_partkey, replace(p_name, 'rod', 'red') AS p_name, string_split(replace(p_name, 'rod', 'red'), ' ') AS w FROM part)
    SELECT query_id, p_partkey AS person_id, CAST(10 * (len(string_split(text, ' ')) + CASE WHEN starts_with(p_name,
    string_split(text, ' ')[1]) THEN 2 ELSE 0 END + CASE WHEN p_name = text THEN 100 ELSE 0 END) AS INTEGER) AS score, 0 AS pass
    FROM q, n WHERE list_has_all(w, string_split(text, ' ')) AND (len(string_split(text, ' ')) = 1 OR
    list_position(w, string_split(text, ' ')[1]) < list_position(w, string_split(text, ' ')[2]))""")
def people_search(spark, d):
    queries = spark.createDataFrame([(1, "red"), (2, "small ring"), (3, "hot gear")], "query_id int, text string")
    return P.search_persons(part_names(spark, d), queries)


# every name is asked for, thousands of queries at once
@query("people_search_all", "", """n AS (SELECT p_partkey, replace(p_name, 'rod', 'red') AS p_name, string_split(replace(p_name, 'rod', 'red'), ' ') AS w FROM part), q AS (SELECT DISTINCT w, p_name AS text FROM n)
    SELECT text, count(*) AS persons, max(CASE WHEN n.p_name = q.text THEN 10 * (len(q.w) + 102) ELSE 10 * len(q.w) END) AS best FROM q JOIN n ON len(q.w) = 2 AND n.w = q.w GROUP BY 1""")
def people_search_all(spark, d):
    names = part_names(spark, d).withColumn("name", F.replace("name", F.lit("rod"), F.lit("red")))
    queries = names.select(F.col("name").alias("text")).distinct().withColumn("query_id", F.col("text"))
    found = P.search_persons(names, queries).where("pass = 0")
    return found.groupBy(F.col("query_id").alias("text")).agg(F.count(F.lit(1)).alias("persons"), F.max("score").cast("int").alias("best"))


@query("people_keyword_search", "", """SELECT p_partkey AS person_id, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'bolt')
    THEN 0 ELSE 1 END AS tier FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red')
    AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'bolt')""")
def people_keyword_search(spark, d):
    entries = X.table(spark, d, "part").withColumnRenamed("p_partkey", "person_id")
    return P.keyword_search(entries, ["p_name"], ["p_brand", "p_type"], "red Bolt").select("person_id", "tier")


@query("people_scholars", "", """SELECT p_partkey AS person_id, CASE WHEN contains(p_name, 'small') THEN 0 ELSE 1 END AS tier,
    p_size > 25 AS has_data FROM part WHERE contains(lower(p_name || ' ' || p_type), 'small')""")
def people_scholars(spark, d):
    entries = X.table(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"),
                                               F.col("p_type").alias("works"))
    data = X.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("person_id"))
    return P.scholars(entries, "small", data).select("person_id", "tier", "has_data")


@query("people_known_by", "", "SELECT p_partkey AS person_id FROM part WHERE starts_with(lower(p_name), 'blue g')")
def people_known_by(spark, d):
    entries = X.table(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("known_as"))
    return P.known_by(entries, "Blue g").select("person_id")


@query("people_browse", "links persons", """u AS (SELECT person_id, count(*) AS links FROM links WHERE person_id IS NOT NULL
    GROUP BY 1), v AS (SELECT l_suppkey AS person_id, min_by(l_returnflag, l_orderkey * 1000000 + l_partkey) AS f FROM lineitem
    GROUP BY 1), r AS (SELECT p.*, coalesce(links, 0) AS links, f AS first_verdict FROM persons p LEFT JOIN u USING (person_id)
    LEFT JOIN v USING (person_id) WHERE generation = 3 AND contains(lower(name), 'supplier'))
    SELECT person_id, links, first_verdict, (SELECT count(*) FROM r) AS total FROM r ORDER BY links DESC, name, person_id
    LIMIT 5 OFFSET 1""")
def people_browse(spark, d):
    uses = X.person_uses(spark, d).where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("links"))
    verdicts = X.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("person_id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("verdict_id"),
        F.col("l_returnflag").alias("phrase"))
    return P.browse(X.persons(spark, d), uses, verdicts, text="Supplier", generation=3, offset=1, limit=5).select(
        "person_id", "links", "first_verdict", "total")


@query("people_rerank")
def people_rerank(spark, d):
    names = part_names(spark, d)
    found = P.search_persons(names, spark.createDataFrame([(1, "red bolt")], "query_id int, text string"))
    people = names.select("person_id", F.col("name").alias("known_as"), "name", F.col("name").alias("reading"),
                          (F.col("person_id") % 50 == 0).alias("scholar"))
    featured = P.featured_by_alias(names.where("person_id % 100 = 1").select("person_id", F.col("name").alias("alias")), "red bolt")
    return P.rerank(found, people, "red bolt", featured).select("person_id", "tier", "weak", "score")
