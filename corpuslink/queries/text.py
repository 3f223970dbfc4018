"""Text, name and rule functions (T) over the given tables."""

from pyspark.sql import functions as F

from corpuslink.functions import names as N
from corpuslink.functions import rules as R
from corpuslink.functions import text as T
from corpuslink.plans import fixtures as X
from corpuslink.plans.stored import stored
from corpuslink.queries.registry import query

NORM = f"n AS MATERIALIZED (SELECT report_id, collection, language, text, {T.normalize_sql('text')} AS norm FROM reports)"


def folded(spark, d):
    """Every text with its fold, computed anew."""
    return X.reports(spark, d).withColumn("norm", T.normalize(F.col("text")))


def normed(spark, d):
    """The stored table of folded texts (Q1): built once from the documents' files, and again when they change."""
    return stored(spark, "text_norm", X.table(spark, d, "documents"), lambda: folded(spark, d))


@query("text_normalized", "reports", NORM + " SELECT report_id, length(norm) AS letters, md5(norm) AS digest FROM n")
def text_normalized(spark, d):
    return folded(spark, d).select("report_id", F.length("norm").alias("letters"), F.md5("norm").alias("digest"))


@query("text_tokens", "reports", NORM + r""", t AS (SELECT report_id, list_filter(list_transform(
    list_filter(string_split_regex(norm, '\s+'), lambda w: w <> ''), lambda w: substr(w, 1, 5)), lambda w: length(w) >= 2 AND
    NOT regexp_full_match(w, '[0-9]+')) AS toks FROM n)
    SELECT report_id, CAST(len(toks) AS INTEGER) AS tokens, md5(array_to_string(toks, ' ')) AS digest FROM t""")
def text_tokens(spark, d):
    toks = T.tokens(F.col("norm"))
    return normed(spark, d).select("report_id", F.size(toks).alias("tokens"), F.md5(F.array_join(toks, " ")).alias("digest"))


@query("text_scripts", "reports", "SELECT language, false AS arabic, count(*) AS texts FROM reports GROUP BY ALL")
def text_scripts(spark, d):
    return X.reports(spark, d).groupBy("language", T.mostly_arabic(F.col("text")).alias("arabic")).agg(
        F.count(F.lit(1)).alias("texts"))


@query("text_snippets", "reports", r"""f AS (SELECT report_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM reports)
    SELECT report_id, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), '\s+\S*$', '') || '…' END
    AS opening FROM f""")
def text_snippets(spark, d):
    return X.reports(spark, d).select("report_id", T.snippet(F.col("text"), 60).alias("opening"))


@query("text_bodies", "reports", """c AS (SELECT report_id, text, substr(text, 1, CAST(report_id % 40 AS INTEGER)) AS chain
    FROM reports) SELECT report_id, md5(CASE WHEN chain <> '' THEN ltrim(substr(text, length(chain) + 1)) ELSE text END)
    AS digest FROM c""")
def text_bodies(spark, d):
    rows = X.reports(spark, d).withColumn("chain", F.expr("substring(text, 1, int(report_id % 40))"))
    return rows.select("report_id", F.md5(T.body_after(F.col("text"), F.col("chain"))).alias("digest"))


@query("text_solar_years", "persons", """SELECT person_id, CAST(round_even(death_year * 0.970229 + 621.5643, 0) AS INTEGER)
    AS solar_year FROM persons""")
def text_solar_years(spark, d):
    return X.persons(spark, d).select("person_id", T.ce_year(F.col("death_year")).alias("solar_year"))


@query("names_near", "names", r"""w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
    SELECT a.word AS a, b.word AS b FROM w a, w b WHERE a.word < b.word AND damerau_levenshtein(a.word, b.word) <= 1""")
def names_near(spark, d):
    word = X.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    # one letter apart: the lengths differ by at most one, and one of the two halves is untouched
    keyed = word.select(F.col("word").alias("b"), F.length("word").alias("n"))
    asked = word.select(F.col("word").alias("a"), F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1)).alias("n"))
    return asked.join(keyed, "n").where((F.col("a") < F.col("b")) & N.near(F.col("a"), F.col("b"))).select("a", "b")


def cases(spark, d, key: str, table: str, values: list[str]):
    """Each row of a table with one of ``values`` chosen by its key."""
    place = (F.col(key) % len(values) + 1).cast("int")
    return X.table(spark, d, table).select(
        F.col(key).alias("id"), F.element_at(F.array(*[F.lit(v) for v in values]), place).alias("value"))


def cases_sql(key: str, table: str, results: list, kind: str) -> str:
    listed = ", ".join("NULL" if r is None else (f"'{r}'" if isinstance(r, str) else str(r).lower()) for r in results)
    return f"""SELECT CAST(list_extract([{listed}], CAST({key} % {len(results)} + 1 AS INTEGER)) AS {kind}) AS result,
        count(*) AS rows FROM {table} GROUP BY 1"""


def counted(rows, result):
    return rows.groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("rows"))


FOLDS = [("Muadh", "muadh"), ("Müslim", "muslim"), ("nîyet", "niyet"), ("الأَعْمَالُ", "الاعمال"), ("Straße", "strasse"),
         ("ﬁrst", "first"), ("صَلَّىٰ", "صلي"), ("مكتبة", "مكتبه")]
VERDICTS = [("ثقة", 3), ("ثقة حافظ", 2), ("صدوق يهم", 5), ("صدوق", 4), ("مقبول", 6), ("مجهول", 9), ("مجهول الحال", 7),
            ("ضعيف", 8), ("متروك", 10), ("كذاب", 12), ("صحابي", 1), ("أوثق الناس", 2), ("شاعر", None),
            ("ثقة وأفرط فلان فقال كذاب", 3), ("اتهم", 11)]
RATINGS = [("Hasan Sahih", 4), ("Daif Jiddan", 1), ("Isnaad Hasan", 3), ("Mawdu", 0), ("Da'if", 2), ("Shadh", 2),
           ("Sahih", 4), ("no grade", None)]
SECOND = [("حسن كالصحيح", 3), ("ضعيف على المشهور", 1), ("موثق", 2), ("كالسابق", None), ("صحيح", 4), ("مرسل", 1)]
YEARS = [("مات سنة سبع وخمسين", 57), ("مات قبل المائة", None), ("مات سنة خمس وقيل ست وتسعين", 95),
         ("قتل ظلما سنة إحدى ومائة", 101), ("مات", None), ("مات سنة عشرين ومائتين", 220)]
ASSESSED = [("ثقة عين", 1), ("جليل القدر", 2), ("ثقة وكان واقفيا", 3), ("ليس بثقة", 4), ("ضعيف", 4), ("له كتاب", None)]
SKELETONS = [("Bukhari", "bkhry"), ("البخاري", "bkhry"), ("Hurayra", "hrr"), ("هريرة", "hrr"), ("Zuhri", "zhry"),
             ("الزهري", "zhry"), ("ibn", "bn"), ("Abbas", "bs")]
LOOSES = [("bkhry", "bhr"), ("zbrrr", "zbr"), ("hrrh", "hr"), ("thwry", "swr"), ("زبيير", "زبير"), ("الزبير", "زبير")]
LATIN = [("A'isha", "aisha"), ("Âişe", "aisha"), ("Abu Hurayra", "abu huraira"), ("Ibn Umar", "umar")]
COMPOUNDS = [("Abdullah", "Abd llah"), ("Abdurrahman", "Abd rrahman"), ("عبدالله", "عبد الله"), ("Malik", "Malik")]
TERMS = [("What is this?", "what is this"), ("«لا» يومن:", "لا يومن"), ("a * b ? c", "a b c"), ("ten ten men", "ten men"),
         ("مسل* ي?من", "مسل* ي?من")]


def rule(name, table, key, pairs, kind, expression):
    """Register a function over a whole table whose rows carry the cases by key."""
    values, results = [v for v, _ in pairs], [r for _, r in pairs]

    @query(name, "", cases_sql(key, table, results, kind))
    def run(spark, d):
        return counted(cases(spark, d, key, table, values), expression(F.col("value")))


rule("text_fold_cases", "orders", "o_orderkey", FOLDS, "VARCHAR", T.normalize)
rule("rules_verdict_ranks", "orders", "o_orderkey", VERDICTS, "INTEGER", R.verdict_rank)
rule("rules_rating_groups", "orders", "o_orderkey", RATINGS, "INTEGER", R.rating_group)
rule("rules_chain_only", "orders", "o_orderkey", [(v, "Isnaad" in v) for v, _ in RATINGS], "BOOLEAN", R.chain_only)
rule("rules_attribution", "orders", "o_orderkey", [("Mawquf Sahih", "mawquf"), ("Hasan", None)], "VARCHAR", R.attribution)
rule("rules_second_groups", "orders", "o_orderkey", SECOND, "INTEGER", R.second_group)
rule("rules_assessments", "orders", "o_orderkey", ASSESSED, "INTEGER", lambda c: R.assessment(c)["rank"])
rule("rules_generation_words", "orders", "o_orderkey", [("من الثانية", 2), ("من الثانية عشرة", 12), ("من كبار العاشرة", 10)],
     "INTEGER", R.generation_number)
rule("names_skeletons", "orders", "o_orderkey", SKELETONS, "VARCHAR", N.skeleton)
rule("names_loose", "orders", "o_orderkey", LOOSES, "VARCHAR", N.loose)
rule("names_latin_fold", "orders", "o_orderkey", LATIN, "VARCHAR", N.latin_fold)
rule("names_compounds", "orders", "o_orderkey", COMPOUNDS, "VARCHAR", N.split_compound)
rule("names_tokens", "orders", "o_orderkey", [("ابن جريج", "بن جريج"), ("أبي هريرة", "ابو هريره"),
                                                ("سماك بكسر أوله وتخفيف الميم بن حرب", "سماك بن حرب")], "VARCHAR",
     lambda c: F.array_join(N.without_spelling(N.name_tokens(c)), " "))
rule("names_segments", "orders", "o_orderkey", [("يحيى بن سعيد بن قيس الأنصاري", "يحيي|سعيد|قيس"),
                                                  ("عبد الله بن عمر", "عبد الله|عمر")], "VARCHAR",
     lambda c: F.array_join(N.name_segments(c), "|"))
rule("names_kunya", "orders", "o_orderkey", [("أبو داود سليمان بن الأشعث السجستاني", "أبو داود"), ("أبي بن كعب", "")],
     "VARCHAR", lambda c: N.name_attributes(c)["kunya"])
rule("text_query_terms", "orders", "o_orderkey", TERMS, "VARCHAR", lambda c: F.array_join(T.query_terms(c), " "))
rule("text_number_keys", "orders", "o_orderkey", [("5:1740", 501740.0), ("12a", 12.0), ("402.2", 402.2)], "DOUBLE", T.number_key)
rule("text_number_texts", "orders", "o_orderkey", [("12.0", "12"), (" 7 ‏", "7"), ("402.2", "402.2")], "VARCHAR", T.number_text)


@query("rules_death_years", "", cases_sql("o_orderkey", "orders", [r for _, r in YEARS], "INTEGER"))
def rules_death_years(spark, d):
    rows = cases(spark, d, "o_orderkey", "orders", [v for v, _ in YEARS]).withColumn("generation", F.lit(2))
    return counted(R.with_death_year(rows, "value", "generation"), F.col("death_year"))


@query("rules_generation_labels", "persons", """SELECT CASE WHEN generation = 1 THEN 'sahabi' WHEN generation <= 5 THEN 'tabi''i'
    WHEN generation = 6 THEN 'contemporary of junior tabi''in' WHEN generation <= 9 THEN 'tabi'' al-tabi''in' ELSE 'later'
    END AS label, count(*) AS persons FROM persons GROUP BY 1""")
def rules_generation_labels(spark, d):
    return X.persons(spark, d).groupBy(R.generation_label(F.col("generation")).alias("label")).agg(
        F.count(F.lit(1)).alias("persons"))


@query("names_closeness", "", """w AS (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z]', '', 'g')) AS w FROM supplier)
    SELECT s_suppkey AS person_id, round(1 - levenshtein('suppliar', translate(w, 'eoy', 'aui')) / 8.0, 6) AS alike FROM w""")
def names_closeness(spark, d):
    alike = N.closeness(F.lit("Supplyer"), F.col("s_name"))
    return X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.round(alike, 6).alias("alike"))


@query("rules_named_ends", "", """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'sadiq' WHEN 1 THEN 'rida' WHEN 2 THEN 'abu_al_hasan'
    END AS end_key, count(*) AS rows FROM orders GROUP BY 1""")
def rules_named_ends(spark, d):
    forms = spark.createDataFrame([("ابي عبد الله", "sadiq"), ("ابي الحسن", "abu_al_hasan"), ("ابي الحسن الرضا", "rida"),
                                   ("علي", "ali")], "form string, end_key string")
    rows = cases(spark, d, "o_orderkey", "orders", ["قلت لأبي عبد الله ثم علي", "سألت أبا فلان أبي الحسن الرضا", "عن أبي الحسن", "قال"])
    return R.named_end(rows, "value", forms).groupBy("end_key").agg(F.count(F.lit(1)).alias("rows"))
