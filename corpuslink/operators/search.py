"""Searching the texts (Q1–Q16, Q22–Q25).

Texts are ``texts(report_id, collection, language, text[, …])``; their normalised form is the column ``norm``. A single
query is one scan with a filter made of its terms; a table of queries is a join on words (``phrases_in_texts``,
``trigram_candidates``) or a dictionary (``search_many``)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.functions.rules import UNRATED, rating_code
from corpuslink.functions.text import NOT_WORD, WORD, blank_split, normalize, query_terms, snippet, words
from corpuslink.operators.dictionary import occurring
from corpuslink.plans.ordered import number_within, top_within
from corpuslink.session import frozen

MODES = ("all", "any", "phrase")
WILDCARDS = "?؟*"
# Spellings tried for one word, and the shortest word that has near spellings.
SPELLINGS = 30
NEAR_LENGTH = 3
# The words that are also tried in near spellings, level by level: none, those of no text, all.
LADDER = ("", "unknown", "all")


@dataclass(frozen=True)
class SearchParams:
    """What is searched for: words, how they must match, which texts, which page."""

    text: str
    mode: str = "all"
    whole_words: bool = False
    collections: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    offset: int = 0
    limit: int = 25


# ------------------------------------------------------------------ derived tables
def normalized_texts(texts: DataFrame, known: DataFrame | None = None, key: str = "report_id") -> DataFrame:
    """The texts with ``norm``; with ``known`` only those not normalised yet (Q1)."""
    new = texts if known is None else texts.join(known.select(key), key, "left_anti")
    return new.withColumn("norm", normalize(F.col("text")))


def grams(text: Column) -> Column:
    """Every three letters in a row, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1))


def trigrams(normed: DataFrame, key: str = "report_id") -> DataFrame:
    """The distinct (trigram, text) pairs of normalised texts (Q2)."""
    return normed.select(key, F.explode(F.array_distinct(grams(F.col("norm")))).alias("gram"))


def trigram_candidates(terms: DataFrame, postings: DataFrame, key: str = "report_id") -> DataFrame:
    """(query_id, term, text) where the text holds every trigram of the term (Q2). ``terms(query_id, term)`` of three
    letters or more; the pairs still have to be verified."""
    asked = terms.select("query_id", "term", F.explode(F.array_distinct(grams(F.col("term")))).alias("gram"))
    needed = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_needed"))
    found = asked.join(postings, "gram").groupBy("query_id", "term", key).agg(F.count(F.lit(1)).alias("_found"))
    return found.join(needed, ["query_id", "term"]).where(F.col("_found") == F.col("_needed")).select("query_id", "term", key)


def vocabulary(normed: DataFrame) -> DataFrame:
    """Every word with how often it occurs (Q3)."""
    return normed.select(F.explode(words(F.col("norm"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def merged_vocabulary(old: DataFrame, more: DataFrame) -> DataFrame:
    """The vocabulary after an addition: counts summed (Q3)."""
    return old.select("word", "n").union(more.select("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ terms and spellings
def terms_of(spark, text: str, mode: str) -> list[str]:
    """The terms of one query, cleaned by the same column expressions as everything else (T4)."""
    return list(spark.range(1).select(query_terms(F.lit(text), mode).alias("t")).head()["t"])


def wildcard_pattern(term: Column) -> Column:
    """A term with wildcards as a whole-word pattern: ``?`` one letter, ``*`` any (Q6)."""
    escaped = F.regexp_replace(term, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(escaped, "[?؟]", "."), F.lit("*"), F.lit(".*")), F.lit("$"))


def spellings(vocab: DataFrame, terms: DataFrame, near: str | Column = "") -> DataFrame:
    """The spellings a term stands for (Q6, Q7): ``(query_id, term, alt)``, the 30 most frequent of the words a
    wildcard fits; with ``near`` = "unknown" also those one letter from a word of no text, with "all" from any word
    (a column of ``terms`` where its rows differ). A term nothing fits stands for itself. ``terms(query_id, term)`` is
    the side that is small; the vocabulary is met by keys (words with one letter left out, the fixed beginning of a
    pattern), then compared."""
    wild = F.col("term").rlike("[?؟*]")
    near = F.lit(near) if isinstance(near, str) else near
    asked = frozen(terms.withColumn("_ask", near))
    known = vocab.select(F.col("word").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").withColumn("_known", F.lit(True))
    # written, so that its size is known where the vocabulary meets it
    marked = frozen(asked.join(known, "term", "left").withColumn("_near", ~wild & (F.length("term") >= NEAR_LENGTH) & (
        (F.col("_ask") == "all") | (F.col("_ask") == "unknown") & F.col("_known").isNull())))
    patterns = marked.where(wild).withColumn("_p", wildcard_pattern(F.col("term")))
    by_pattern = _opened(patterns, vocab).select("query_id", "term", F.col("word").alias("alt"), "n")
    # words one letter apart have a common form among themselves and themselves with one letter left out
    close = (marked.where("_near").select("query_id", "term", F.explode(_left_out(F.col("term"))).alias("_key")).distinct()
             .join(vocab.where(F.length("word") >= NEAR_LENGTH - 1).select("word", "n", F.explode(_left_out(F.col("word"))).alias("_key")), "_key")
             .where((F.length("word") >= NEAR_LENGTH) & (F.col("word") != F.col("term")) & (F.levenshtein("term", "word", 1) >= 0))
             .select("query_id", "term", F.col("word").alias("alt"), "n").distinct())
    best = top_within(by_pattern.union(close), ["query_id", "term"], [F.desc("n"), F.asc("alt")], SPELLINGS)
    itself = marked.where(~wild).select("query_id", "term", F.col("term").alias("alt"))
    none = (marked.where(wild).select("query_id", "term").join(best.select("query_id", "term"), ["query_id", "term"], "left_anti")
            .withColumn("alt", F.regexp_replace("term", r"^[?؟*]+|[?؟*]+$", "")))
    return best.select("query_id", "term", "alt").union(itself).union(none).distinct()


def _left_out(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))))


def _opened(patterns: DataFrame, vocab: DataFrame) -> DataFrame:
    """Patterns with the words that fit them: met by the fixed letters before the first wildcard, up to three. Only a pattern
    that begins with a wildcard is held against every word."""
    fixed = F.least(F.length(F.regexp_extract("term", "^([^?؟*]*)", 1)), F.lit(3))
    keyed = patterns.withColumn("_k", fixed).withColumn("_head", F.substr("term", F.lit(1), fixed))
    heads = vocab.select("word", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("_k")).where(F.length("word") >= F.col("_k"))
    heads = heads.withColumn("_head", F.substr("word", F.lit(1), F.col("_k")))
    met = keyed.where("_k > 0").join(heads, ["_k", "_head"]).where(F.expr("word rlike _p")).select(*patterns.columns, "word", "n")
    return met.unionByName(patterns.join(keyed.where("_k = 0").select("query_id", "term"), ["query_id", "term"], "left_semi").join(vocab, F.expr("word rlike _p"))
                           .select(*patterns.columns, "word", "n"))


def holding(pieces: DataFrame, parts: DataFrame) -> DataFrame:
    """The words of ``pieces`` (word) that contain each of ``parts`` (part): (part, word). They meet by the part's first three
    letters (all of a shorter part), then are compared."""
    size = F.least(F.length("part"), F.lit(3))
    asked_ = parts.select("part").distinct().where("part <> ''").withColumn("_size", size).withColumn("_gram", F.substr("part", F.lit(1), size))
    sizes = asked_.select("_size").distinct()
    grams = pieces.select("word").distinct().join(sizes, F.length("word") >= F.col("_size"))  # at most three sizes
    places = F.sequence(F.lit(1), F.length("word") - F.col("_size") + 1)
    grams = grams.select("word", "_size", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("word", i, F.col("_size"))))).alias("_gram"))
    return asked_.join(grams, ["_size", "_gram"]).where(F.contains("word", F.col("part"))).select("part", "word")


# ------------------------------------------------------------------ matching one query
def _quoted(term: str) -> str:
    return re.sub(r"([\\.\[\]{}()+*?^$|])", r"\\\1", term)


def _whole(term: str) -> str:
    return rf"(?<!{WORD}){term}(?!{WORD})"


def matches(terms: list[list[str]], mode: str, whole_words: bool, norm: Column | None = None) -> Column:
    """Whether a normalised text matches (Q4, Q5). Each term is its list of spellings; in phrase mode each word of the
    phrase is. All or any within one text; phrase: in order, whatever stands between the words."""
    norm = F.col("norm") if norm is None else norm
    if mode == "phrase":
        body = (NOT_WORD + "+").join("(?:" + "|".join(map(_quoted, alts)) + ")" for alts in terms)
        return norm.rlike(_whole(body) if whole_words else body)
    one = (lambda alt: norm.rlike(_whole(_quoted(alt)))) if whole_words else (lambda alt: norm.contains(alt))
    found = [reduce(lambda a, b: a | b, map(one, alts)) for alts in terms]
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), found)


def filtered(texts: DataFrame, q: SearchParams) -> DataFrame:
    """The texts of the chosen collections and languages (Q9); pushed to the scan."""
    if q.collections:
        texts = texts.where(F.col("collection").isin(list(q.collections)))
    if q.languages:
        texts = texts.where(F.col("language").isin(list(q.languages)))
    return texts


def active_only(texts: DataFrame, collections: DataFrame) -> DataFrame:
    """The texts of active collections (Q9). ``collections(collection, active)``."""
    return texts.join(collections.where("active").select("collection"), "collection", "left_semi")


def spelt(vocab: DataFrame, typed: list[str], mode: str, near: str) -> list[list[str]]:
    """The spellings of each word of a query, the word itself first; at most 31 a word reach the driver."""
    asked = typed[0].split(" ") if mode == "phrase" else typed
    plain = not near and not any(ch in w for w in asked for ch in WILDCARDS)
    if plain:
        return [[w] for w in asked]
    spark = vocab.sparkSession
    rows = spellings(vocab, spark.createDataFrame([(0, w) for w in dict.fromkeys(asked)], "query_id long, term string"), near)
    found: dict[str, list[str]] = {}
    for row in rows.collect():
        found.setdefault(row["term"], []).append(row["alt"])
    return [sorted(found[w], key=lambda a, w=w: (a != w, a)) for w in asked]


def search(texts: DataFrame, vocab: DataFrame, q: SearchParams) -> tuple[DataFrame, list[list[str]]]:
    """The matching texts and the spellings they matched by (Q4–Q9). The ladder: as typed; then the words found in no
    text also in near spellings; then every word. ``texts`` carries ``norm``."""
    if q.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    typed = terms_of(texts.sparkSession, q.text, q.mode)
    if not typed:
        return texts.limit(0), []
    chosen, before = filtered(texts, q), None
    for near in LADDER:
        terms = spelt(vocab, typed, q.mode, near)
        if terms == before:
            continue
        hits = chosen.where(matches(terms, q.mode, q.whole_words))
        before = terms
        if near == "all" or not hits.limit(1).isEmpty():
            break
    return hits, terms


def search_many(texts: DataFrame, vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """A table of queries at once, all words, each at the first level of the ladder that finds anything (Q8):
    ``(query_id, level, report_id)``. ``terms(query_id, term)``.

    The spellings of all levels are found at once and written, so that no plan holds them several times. They are a dictionary:
    each text is read once for all of them, and only the pairs that match are shuffled."""
    nears = F.array(*map(F.lit, LADDER))
    asked = terms.select(F.posexplode(nears).alias("level", "_ask"), "query_id", "term").select(F.struct("level", "query_id").alias("query_id"), "term")
    levels = frozen(spellings(vocab, asked, F.get(nears, F.col("query_id.level"))).select("query_id.*", "term", "alt"))
    needed = levels.groupBy("query_id", "level").agg(F.countDistinct("term").alias("_needed"))
    strings = levels.where("alt <> ''").select(F.lit("norm").alias("kind"), F.col("alt").alias("string"))
    held = occurring(texts, "report_id", {"norm": F.col("norm")}, strings).withColumnRenamed("string", "alt")
    hits = frozen(held.join(levels, "alt").select("query_id", "level", "report_id", "term").distinct()
                  .groupBy("query_id", "level", "report_id").agg(F.count(F.lit(1)).alias("_found"))
                  .join(needed, ["query_id", "level"]).where(F.col("_found") == F.col("_needed")))
    first = hits.groupBy("query_id").agg(F.min("level").alias("level"))
    return hits.join(first, ["query_id", "level"]).select("query_id", "level", "report_id")


def phrases_in_texts(phrases: DataFrame, texts: DataFrame, whole_words: bool = True) -> DataFrame:
    """(phrase_id, report_id) where a text holds a phrase's words in order, whatever stands between (Q4 for a table
    of phrases). ``phrases(phrase_id, norm)``, ``texts(report_id, norm)``.

    Each phrase is looked up by the rarest of its words that must be whole, or by the words that hold its longest part; only
    texts holding one are compared."""
    spoken = phrases.select("phrase_id", words(F.col("norm")).alias("_w")).where(F.size("_w") > 0)
    lines = texts.select("report_id", words(F.col("norm")).alias("_t"))
    postings = lines.select("report_id", F.explode(F.array_distinct("_t")).alias("word"))
    inner = F.col("_w") if whole_words else F.when(F.size("_w") > 2, F.slice(F.col("_w"), 2, F.size("_w") - 2)).otherwise(F.array().cast("array<string>"))
    asked = spoken.select("phrase_id", F.explode(F.array_distinct(inner)).alias("word"))
    wanted = postings.join(asked.select("word").distinct(), "word", "left_semi")
    if not whole_words:
        # a phrase of one or two words has edges only: the words that hold its longer one stand for it
        edges = spoken.where(F.size("_w") <= 2).select("phrase_id", F.element_at(F.array_sort("_w", lambda a, b: F.length(b) - F.length(a)), 1).alias("part"))
        held = holding(postings.select("word"), edges)
        edge_pairs = edges.join(held, "part").join(postings, "word").select("phrase_id", "report_id").distinct()
    counts = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (asked.join(counts, "word", "left").groupBy("phrase_id")
              .agg(F.min_by("word", F.struct(F.coalesce("_df", F.lit(0)), F.col("word"))).alias("word")))
    pairs = rarest.join(wanted, "word").select("phrase_id", "report_id")
    pairs = pairs if whole_words else pairs.union(edge_pairs)
    edge = F.lit(" ") if whole_words else F.lit("")
    said = spoken.select("phrase_id", F.concat(edge, F.array_join("_w", " "), edge).alias("_p"))
    line = lines.select("report_id", F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).alias("_line"))
    return (pairs.join(said, "phrase_id").join(line, "report_id").where(F.col("_line").contains(F.col("_p")))
            .select("phrase_id", "report_id"))


# ------------------------------------------------------------------ ratings and trees as filters
def rating_codes(ratings: DataFrame, reports: DataFrame) -> DataFrame:
    """The code of each rating on its report's scale (Q10). ``ratings(report_id, rater, grade)`` in words,
    ``reports(report_id, collection, scale)``."""
    return (ratings.join(reports, "report_id")
            .select("report_id", "collection", "scale", rating_code(F.col("grade"), F.col("scale")).alias("code")))


def rated_reports(reports: DataFrame, codes: DataFrame, wanted: list[str], every: bool = False,
                  trusted: tuple[str, ...] = ()) -> DataFrame:
    """The reports the chosen codes allow (Q10): one rating among them is enough, or with ``every`` all must be. Unrated
    reports pass by the unrated code; those of ``trusted`` collections without any rating count as sound. ``codes``
    holds every rating, its code null when the wording fits none."""
    chosen = F.col("code").isin(wanted)
    per_report = codes.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("_given"), F.count("code").alias("_known"),
        F.bool_or(chosen).alias("_any"), F.bool_and(F.coalesce(chosen, F.lit(True))).alias("_every"))
    rows = reports.join(per_report, "report_id", "left")
    unrated = F.when(F.col("scale") == "B", F.lit(UNRATED["B"] in wanted)).otherwise(F.lit(UNRATED["A"] in wanted))
    by_compiler = (F.col("_given").isNull() & (F.col("scale") == "A") & F.col("collection").isin(list(trusted)))
    none_known = F.coalesce(F.col("_known"), F.lit(0)) == 0
    passes = (F.when(by_compiler, F.lit("sahih" in wanted)).when(none_known, unrated)
              .otherwise(F.col("_every") if every else F.coalesce(F.col("_any"), F.lit(False))))
    return rows.where(passes).select(*reports.columns)


def under_nodes(hits: DataFrame, leaves: DataFrame) -> DataFrame:
    """The hits that stand under chosen nodes (Q11). ``leaves(report_id)`` from the tree's closure."""
    return hits.join(leaves.select("report_id").distinct(), "report_id", "left_semi")


# ------------------------------------------------------------------ pages
def reading_order(df: DataFrame, order: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` with its collection's place, and the columns of reading order (Q12). ``order(collection, place)``."""
    return (df.join(order, "collection", "left"),
            [F.coalesce("place", F.lit(999)).asc(), F.col("number_sort").asc(), F.col("report_id").asc()])


def page(hits: DataFrame, order: DataFrame, offset: int, limit: int) -> DataFrame:
    """One hit per report in reading order, the page asked for, with the total (Q12). Only the page is sorted: Spark
    keeps offset + limit rows per task."""
    once = hits.dropDuplicates(["report_id"])
    total = once.agg(F.count(F.lit(1)).alias("total"))
    placed, columns = reading_order(once, order)
    return placed.orderBy(*columns).offset(offset).limit(limit).drop("place").crossJoin(total)  # total is one row


def _places(norm: Column, pattern: str, length: int | None) -> Column:
    """Where a pattern begins and ends, overlapping finds included: the text is cut before each find, in one pass."""
    pieces = F.split(norm, f"(?={pattern})")
    begins = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")))["starts"]
    real = F.filter(begins, lambda i: (i > 0) | norm.rlike(f"^(?={pattern})"))
    if length is not None:
        return F.transform(real, lambda i: F.struct(i.alias("s"), (i + length).alias("e")))
    size = lambda i: F.length(F.regexp_extract(F.substr(norm, i + 1), f"^({pattern})", 1))
    return F.transform(real, lambda i: F.struct(i.alias("s"), (i + size(i)).alias("e")))


def spans(norm: Column, terms: list[str], phrase: bool = False, whole_words: bool = False) -> Column:
    """The places of the terms in a normalised text, 0-based half-open, overlaps merged (Q13)."""
    found = []
    for term in terms:
        body = (NOT_WORD + "+").join(_quoted(w) for w in term.split(" ")) if phrase else _quoted(term)
        found.append(_places(norm, _whole(body) if whole_words else body, None if phrase else len(term)))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    ordered = F.array_sort(reduce(lambda a, b: F.concat(a, b), found))

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (span["s"] <= F.try_element_at(done, F.lit(-1))["e"]), joined).otherwise(
            F.concat(done, F.array(F.struct(span["s"].alias("s"), span["e"].alias("e")))))

    return F.aggregate(ordered, empty, add)


def highlighted(rows: DataFrame, terms: list[str], phrase: bool = False, whole_words: bool = False) -> DataFrame:
    """Rows of a page with ``spans``: the places of the terms in the ORIGINAL text, mapped back through what the fold
    deleted or lengthened (Q13)."""
    chars = F.split("text", "")
    lengths = F.transform(chars, lambda c: F.length(normalize(c)))
    back = F.flatten(F.transform(lengths, lambda n, i: F.when(n > 0, F.array_repeat(i, n)).otherwise(
        F.array().cast("array<int>"))))
    placed = rows.withColumn("_back", back).withColumn("_spans", spans(F.col("norm"), terms, phrase, whole_words))
    at = lambda i: F.coalesce(F.try_element_at(F.col("_back"), i + 1), F.length("text"))
    mapped = F.transform("_spans", lambda s: F.struct(at(s["s"]).alias("start"), at(s["e"]).alias("stop")))
    return placed.withColumn("spans", mapped).drop("_back", "_spans")


def assembled(reports: DataFrame, texts: DataFrame, ratings: DataFrame, first_language: str) -> DataFrame:
    """Each report of a page with its texts (the preferred language first) and its ratings (Q14). ``reports`` is a
    page, so the lists stay short."""
    rank = F.when(F.col("language") == first_language, 0).otherwise(1)
    said = texts.join(reports.select("report_id"), "report_id", "left_semi").groupBy("report_id").agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "language", "text"))).alias("_t"))
    given = ratings.join(reports.select("report_id"), "report_id", "left_semi").groupBy("report_id").agg(
        F.sort_array(F.collect_list(F.struct("rater", "grade"))).alias("ratings"))
    return (reports.join(said, "report_id", "left").join(given, "report_id", "left")
            .withColumn("texts", F.transform("_t", lambda t: F.struct(t["language"].alias("language"), t["text"].alias("text"))))
            .drop("_t"))


def spelling_report(hits: DataFrame, terms: list[list[str]]) -> DataFrame:
    """Which spellings of each word the shown hits really have (Q15): ``(word, spelling)``."""
    spark = hits.sparkSession
    asked = spark.createDataFrame([(alts[0], a) for alts in terms for a in alts], "word string, spelling string")
    there = hits.select(F.explode(words(F.col("norm"))).alias("spelling")).distinct()
    return asked.join(there, "spelling", "left_semi").select("word", "spelling")


def search_verses(verses: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """The verses of either script holding all words, in verse order (Q16). ``verses(chapter, verse, edition, arabic,
    norm)``."""
    terms = terms_of(verses.sparkSession, text, "all")
    arabic = any("؀" <= ch <= "ۿ" for ch in text)
    return (verses.where((F.col("arabic") == arabic) & matches([[t] for t in terms], "all", False))
            .orderBy("chapter", "verse", "edition").limit(limit))


def verse_range(verses: DataFrame, chapter: int, first: int, last: int) -> DataFrame:
    """The verses of a chapter from ``first`` to ``last`` (Q16)."""
    return verses.where((F.col("chapter") == chapter) & F.col("verse").between(first, last))


# ------------------------------------------------------------------ navigation
def ends_of(reports: DataFrame) -> DataFrame:
    """First and last number and the count of each collection (Q22)."""
    key = F.struct("number_sort", "report_id")
    return reports.groupBy("collection").agg(F.min_by("report_id", key).alias("first"), F.max_by("report_id", key).alias("last"),
                                             F.count(F.lit(1)).alias("reports"))


def with_prefix(reports: DataFrame, number: str, prefix: str) -> DataFrame:
    """The reports whose number begins with a prefix (Q22)."""
    return reports.where(F.startswith(F.col(number).cast("string"), F.lit(prefix)))


def neighbours(reports: DataFrame) -> DataFrame:
    """Each report with its place and the one before and after it in the collection (Q22). The places are numbered
    once, then a report is joined to places ±1, so a collection of any size is no single task's work."""
    placed = number_within(reports, ["collection"], [F.col("number_sort"), F.col("report_id")], "n")
    other = placed.select("collection", "n", F.col("report_id").alias("_other"))
    before = other.select("collection", (F.col("n") + 1).alias("n"), F.col("_other").alias("previous"))
    after = other.select("collection", (F.col("n") - 1).alias("n"), F.col("_other").alias("next"))
    return placed.join(before, ["collection", "n"], "left").join(after, ["collection", "n"], "left")


def nearest(reports: DataFrame, asked: DataFrame) -> DataFrame:
    """The existing report nearest to each asked number (Q22), the lower one when two are as near.
    ``asked(collection, wanted)``: a handful of numbers, joined by collection."""
    pairs = reports.join(asked, "collection")
    gap = F.struct(F.abs(F.col("number_sort") - F.col("wanted")), F.col("number_sort"), F.col("report_id"))
    return pairs.groupBy("collection", "wanted").agg(F.min_by("report_id", gap).alias("report_id"))


def random_report(reports: DataFrame, with_chain: DataFrame, seed: int) -> DataFrame:
    """One report at random, one with a chain if there is any (Q22). The same seed gives the same report."""
    marked = reports.join(with_chain.select("report_id").distinct().withColumn("_c", F.lit(0)), "report_id", "left")
    return marked.orderBy(F.coalesce("_c", F.lit(1)), F.xxhash64(F.lit(seed), "report_id"), "report_id").limit(1).drop("_c")


def resolve_references(asked: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of references ``c:n``, ``c:a-b`` or lists (Q23): in the order asked, each report once.
    ``asked(place, reference)``, commas between references."""
    one = asked.select("place", F.posexplode(F.split("reference", r"\s*,\s*")).alias("_i", "_r"))
    part = lambda g: F.regexp_extract("_r", r"^([^:]+):(\d+)(?:-(\d+))?$", g)
    read = one.select("place", "_i", part(1).alias("collection"), part(2).try_cast("long").alias("_from"),
                      F.coalesce(part(3).try_cast("long"), part(2).try_cast("long")).alias("_to"))
    exact = read.where("_from = _to").withColumn("number_sort", F.col("_from")).join(
        reports.withColumn("number_sort", F.col("number_sort").cast("long")), ["collection", "number_sort"])
    ranges = read.where("_from < _to").join(reports, "collection").where(F.col("number_sort").between(F.col("_from"), F.col("_to")))
    columns = ["report_id", "collection", F.col("number_sort").cast("long").alias("number_sort"), "place", "_i"]
    both = exact.select(*columns).union(ranges.select(*columns))
    first = both.groupBy("report_id", "collection", "number_sort").agg(F.min(F.struct("place", "_i")).alias("_at"))
    return first.select("report_id", "collection", "number_sort", F.col("_at.place").alias("place"), F.col("_at._i").alias("item"))


def collection_list(reports: DataFrame, collections: DataFrame) -> DataFrame:
    """The collections with their counts and scale (Q24)."""
    counts = reports.groupBy("collection").agg(F.count(F.lit(1)).alias("reports"))
    return collections.join(counts, "collection", "left").na.fill(0, ["reports"])


def language_list(texts: DataFrame) -> DataFrame:
    """The languages of each collection with their texts (Q24)."""
    return texts.groupBy("collection", "language").agg(F.count(F.lit(1)).alias("texts"))


def chapter_listing(reports: DataFrame, texts: DataFrame, links: DataFrame, languages: list[str], width: int = 60) -> DataFrame:
    """The reports of chapters with their first words in the preferred language and their number of links (Q25).
    ``links(report_id, …)``."""
    rank = reduce(lambda out, pair: F.when(F.col("language") == pair[1], pair[0]).otherwise(out),
                  reversed(list(enumerate(languages))), F.lit(len(languages)))
    best = texts.groupBy("report_id").agg(F.min_by("text", F.struct(rank, "language")).alias("_text"))
    counts = links.groupBy("report_id").agg(F.count(F.lit(1)).alias("links"))
    return (reports.join(best, "report_id", "left").join(counts, "report_id", "left")
            .select(*reports.columns, snippet(F.col("_text"), width).alias("opening"), F.coalesce("links", F.lit(0)).alias("links")))


def first_per_report(texts: DataFrame, order: list[Column]) -> DataFrame:
    """The first text of each report in an order."""
    return texts.withColumn("_n", F.row_number().over(W.partitionBy("report_id").orderBy(*order))).where("_n = 1").drop("_n")
