"""Searching persons (Q17–Q21): names by whole words, beginnings, skeletons, loose keys and one letter off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.functions.names import closeness, loose, name_tokens, one_off, skeleton
from corpuslink.functions.text import blank_split, normalize
from corpuslink.session import frozen

# Fewer exact matches than this bring the close passes; what each pass costs; the pages that are reranked.
FUZZY_BELOW = 10
LOOSE_COST, ONE_OFF_COST = 1000, 2000
RERANK = 400
WEAK_BELOW = 0.7


def _same(query: Column, word: Column) -> Column:
    """A query word is a name word, or its beginning when it has three letters or more; the article is no hindrance."""
    bare = F.when(F.startswith(word, F.lit("ال")) & (F.length(word) > 3) & ~F.startswith(query, F.lit("ال")),
                  F.substring(word, 3, 1000)).otherwise(word)
    return F.when(F.length(query) < 3, bare == query).otherwise(F.startswith(bare, query))


def ordered_score(query: Column, name: Column, same=_same) -> Column:
    """Null when the query's words do not occur in order in the name; else one point per whole word, two when the name
    begins with the first word, a hundred when it is the whole name (Q17)."""
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("points"))

    def step(state: Column, word: Column) -> Column:
        asked = F.try_element_at(query, state["next"])
        hit = asked.isNotNull() & same(asked, word)
        return F.when(hit, F.struct((state["next"] + 1).alias("next"),
                                    (state["points"] + (asked == word).cast("int")).alias("points"))).otherwise(state)

    done = F.aggregate(name, start, step)
    first, asked = F.try_element_at(name, F.lit(1)), F.try_element_at(query, F.lit(1))
    extra = F.when(F.startswith(first, asked), 2).otherwise(0) + F.when(name == query, 100).otherwise(0)
    return F.when((F.size(query) > 0) & (done["next"] > F.size(query)), done["points"] + extra)


def _loose_same(query: Column, word: Column) -> Column:
    return (word == query) | ((F.length(query) >= 3) & F.startswith(word, query))


def _begin(word: Column) -> Column:
    """What a query word of three letters or more and a name word that it begins have in common; a shorter one is met whole."""
    return F.when(F.length(word) < 3, F.concat(F.lit("="), word)).otherwise(F.concat(F.lit("^"), F.substring(word, 1, 3)))


def _unarticled(word: Column) -> Column:
    return F.when(F.startswith(word, F.lit("ال")) & (F.length(word) > 3), F.substring(word, 3, 1000)).otherwise(word)


def _whole(word: Column) -> Column:
    return F.concat(F.lit("="), word)


def _bent(word: Column) -> Column:
    """The first four letters of a word, and those with one of them but the first left out: two words one letter apart, or
    one and a beginning of the other, that agree in their first letter have one of these in common."""
    head = F.substring(word, 1, 4)
    cut = F.transform(F.sequence(F.lit(2), F.greatest(F.length(head), F.lit(2))), lambda i: F.concat(F.substr(head, F.lit(1), i - 1), F.substr(head, i + 1)))
    return F.transform(F.array_union(F.array(head), cut), lambda k: F.concat(F.lit("~"), k))


# The keys that words of queries and of names meet by, of each pass: of a query word any one, of a name word all.
PASSES = (
    (_same, 0, "", lambda q: F.array(_begin(q)), lambda w: F.array(_begin(w), _begin(_unarticled(w)), _whole(w), _whole(_unarticled(w)))),
    (_loose_same, LOOSE_COST, "_loose", lambda q: F.array(F.when(F.length(q) < 3, _whole(q)).otherwise(_begin(q))), lambda w: F.array(_begin(w), _whole(w))),
    (one_off, ONE_OFF_COST, "_loose", lambda q: F.when(F.length(q) < 4, F.array(_whole(q))).otherwise(_bent(q)), lambda w: F.array_append(_bent(w), _whole(w))),
)


def search_persons(names: DataFrame, queries: DataFrame, uses: DataFrame | None = None, own_weight: int = 10) -> DataFrame:
    """Persons for each query with their score (Q17): ``(query_id, person_id, score, pass)``. ``names(person_id, name,
    own)`` (own = the entry itself), ``queries(query_id, text)``, ``uses(person_id, links)`` to break ties.

    The exact pass runs for every query; the loose pass for queries with fewer than ten matches; the one-letter-off
    pass for those still short. In each pass the names' words are posted under keys, and a query is looked up by the one of its
    words whose keys have the fewest postings; only the names found there are compared word by word."""
    key = lambda c: F.transform(blank_split(c), skeleton)
    arabic = lambda c: c.rlike("[؀-ۿ]")
    asked = queries.select("query_id", F.when(arabic(F.col("text")), name_tokens(F.col("text"))).otherwise(
        key(F.lower("text"))).alias("_q"), arabic(F.col("text")).alias("_arabic"))
    asked = frozen(asked.withColumn("_q_loose", F.transform("_q", loose)))
    people = names.select("person_id", "own", name_tokens(F.col("name")).alias("_words"), key(F.col("name")).alias("_bones"), F.monotonically_increasing_id().alias("_row"))
    people = frozen(people.withColumn("_words_loose", F.transform("_words", loose)).withColumn("_bones_loose", F.transform("_bones", loose)))

    def run(wanted: DataFrame, same, cost: int, tail: str, query_keys, name_keys, number: int) -> DataFrame:
        posted = lambda column, is_arabic: people.select("_row", F.lit(is_arabic).alias("_arabic"), F.explode(F.array_distinct(F.flatten(
            F.transform(column + tail, name_keys)))).alias("_key"))
        postings = frozen(posted("_words", True).unionByName(posted("_bones", False)))
        words = wanted.select("query_id", "_arabic", F.posexplode("_q" + tail).alias("_at", "_w"))
        keys = frozen(words.select("query_id", "_arabic", "_at", F.explode(F.array_distinct(query_keys(F.col("_w")))).alias("_key")))
        asked_for = keys.select("_arabic", "_key").distinct()
        counts = postings.join(asked_for, ["_arabic", "_key"], "left_semi").groupBy("_arabic", "_key").agg(F.count(F.lit(1)).alias("_n"))
        rare = keys.join(counts, ["_arabic", "_key"], "left").groupBy("query_id", "_at").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
        rare = rare.groupBy("query_id").agg(F.min_by("_at", F.struct("_n", "_at")).alias("_at"))
        near = keys.join(rare, ["query_id", "_at"]).join(postings, ["_arabic", "_key"]).select("query_id", "_row").distinct()
        pairs = near.join(wanted, "query_id").join(people, "_row").select(
            "query_id", "person_id", "own", F.col("_q" + tail).alias("_query"),
            F.when(F.col("_arabic"), F.col("_words" + tail)).otherwise(F.col("_bones" + tail)).alias("_name"))
        scored = pairs.withColumn("_s", ordered_score(F.col("_query"), F.col("_name"), same)).where(F.col("_s").isNotNull())
        weight = F.when(F.col("own"), own_weight).otherwise(1)
        return scored.groupBy("query_id", "person_id").agg((F.max(F.col("_s") * weight) - cost).alias("score")).withColumn(
            "pass", F.lit(number))

    out = frozen(run(asked, *PASSES[0], 0))
    for number in (1, 2):
        counts = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        short = frozen(asked.join(counts, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < FUZZY_BELOW).drop("_n"))
        if short.isEmpty():
            break
        more = run(short, *PASSES[number], number)
        out = frozen(out.union(more.join(out.select("query_id", "person_id"), ["query_id", "person_id"], "left_anti")))
    if uses is None:
        return out
    return out.join(uses.select("person_id", "links"), "person_id", "left").na.fill(0, ["links"])


def rerank(found: DataFrame, people: DataFrame, query: str, featured: DataFrame | None = None, first: int = RERANK) -> DataFrame:
    """The first ``first`` matches of one query with the closest first, later ones in plain order (Q18): tier 0 known by that name and alike, 1 in the
    name, 2 in words about the person; close spellings ten tiers later, scholars −1, featured persons −100 first; weak
    likeness last. ``found(person_id, score, pass)``, ``people(person_id, known_as, name, reading, scholar)``,
    ``featured(person_id, place)``."""
    ahead = found.orderBy(F.desc("score"), "person_id").limit(first).select("person_id", F.lit(True).alias("_ahead"))
    rows = found.join(ahead, "person_id", "left").join(people, "person_id")
    late = F.col("_ahead").isNull()
    asked = normalize(F.lit(query))
    alike = F.greatest(closeness(F.lit(query), F.col("reading")), closeness(F.lit(query), F.col("known_as")))
    begins = F.startswith(normalize(F.col("known_as")), asked)
    inside = normalize(F.col("name")).contains(asked)
    tier = F.when(begins & (alike >= 0.8), 0).when(inside, 1).otherwise(2) + F.when(F.col("pass") > 0, 10).otherwise(0)
    tier = F.when(F.col("scholar"), -1).otherwise(tier)
    if featured is not None:
        rows = rows.join(featured, "person_id", "left")
        tier = F.when(F.col("place").isNotNull(), -100 + F.col("place")).otherwise(tier)
    rows = rows.withColumn("alike", F.when(~late, alike)).withColumn("tier", F.when(~late, tier))
    return (rows.withColumn("weak", (F.col("alike") < WEAK_BELOW) & (F.col("tier") > -1))
            .orderBy(F.coalesce("_ahead", F.lit(False)).desc(), "weak", "tier", F.desc(F.round("alike", 1)), F.desc("score"), "person_id").drop("_ahead"))


def featured_by_alias(aliases: DataFrame, query: str) -> DataFrame:
    """Featured persons a query names (Q18): the whole alias, its beginning, "son of" it, or the same skeleton and first
    letter. ``aliases(person_id, alias)``."""
    asked = normalize(F.lit(query))
    alias = normalize(F.col("alias"))
    bones = lambda c: F.array_join(F.transform(blank_split(c), skeleton), " ")
    son = F.regexp_replace(asked, r"^(?:ibn|bin|b\.|بن|ابن)\s+", "")
    place = (F.when(alias == asked, 0).when(F.startswith(alias, asked), 1).when((son != asked) & (alias == son), 2)
             .when((bones(alias) == bones(asked)) & (F.substring(alias, 1, 1) == F.substring(asked, 1, 1)), 3))
    return (aliases.withColumn("place", place).where(F.col("place").isNotNull())
            .groupBy("person_id").agg(F.min("place").alias("place")))


def browse(people: DataFrame, uses: DataFrame, verdicts: DataFrame, marks: DataFrame | None = None, text: str = "",
           generation: int | None = None, rank: int | None = None, mark: str | None = None, only: list[int] | None = None,
           offset: int = 0, limit: int = 50) -> DataFrame:
    """Persons by filters, most used first, then by name, paged with the total; each with the first verdict (Q19).
    ``rank`` −1 asks for the unranked."""
    first = verdicts.groupBy("person_id").agg(F.min_by("phrase", "verdict_id").alias("first_verdict"))
    rows = people
    if text:
        rows = rows.where(normalize(F.col("name")).contains(normalize(F.lit(text))))
    if generation is not None:
        rows = rows.where(F.col("generation") == generation)
    if rank is not None:
        rows = rows.where(F.col("rank").isNull() if rank == -1 else F.col("rank") == rank)
    if only is not None:
        rows = rows.where(F.col("person_id").isin(only))
    if mark is not None and marks is not None:
        rows = rows.join(marks.where(F.col("mark") == mark).select("person_id"), "person_id", "left_semi")
    rows = (rows.join(uses.select("person_id", "links"), "person_id", "left").na.fill(0, ["links"])
            .join(first, "person_id", "left"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("links"), "name", "person_id").offset(offset).limit(limit).crossJoin(total)  # one row


def keyword_search(entries: DataFrame, name_columns: list[str], body_columns: list[str], text: str) -> DataFrame:
    """Entries that hold every word, those whose names hold them before the others (Q20, Q21): ``tier`` 0 or 1."""
    terms = [w for w in entries.sparkSession.range(1).select(blank_split(normalize(F.lit(text))).alias("w")).head()["w"]]
    joined = lambda columns: normalize(F.concat_ws(" ", *columns))
    every = lambda hay: reduce(lambda a, b: a & b, [hay.contains(t) for t in terms], F.lit(bool(terms)))
    in_name, anywhere = every(joined(name_columns)), every(joined([*name_columns, *body_columns]))
    return entries.where(anywhere).withColumn("tier", F.when(in_name, 0).otherwise(1))


def scholars(entries: DataFrame, text: str, with_data: DataFrame) -> DataFrame:
    """Scholars by every word in names or works: names first, then those with data; close spellings only when nothing
    fits (Q20). ``entries(person_id, name, works)``, ``with_data(person_id)``."""
    exact = keyword_search(entries, ["name"], ["works"], text)
    asked = F.transform(blank_split(normalize(F.lit(text))), lambda w: loose(skeleton(w)))
    said = F.transform(blank_split(F.col("name")), lambda w: loose(skeleton(w)))
    close = F.forall(asked, lambda q: F.exists(said, lambda w: one_off(q, w)))
    rows = exact if not exact.limit(1).isEmpty() else entries.where(close).withColumn("tier", F.lit(2))
    marked = rows.join(with_data.select("person_id").distinct().withColumn("_d", F.lit(0)), "person_id", "left")
    return marked.withColumn("has_data", F.col("_d").isNotNull()).drop("_d").orderBy("tier", F.desc("has_data"), "person_id")


def known_by(entries: DataFrame, text: str) -> DataFrame:
    """Scholars whose known-by name is the query or begins with it (Q20). ``entries(person_id, known_as)``."""
    return entries.where(F.startswith(normalize(F.col("known_as")), normalize(F.lit(text))))
