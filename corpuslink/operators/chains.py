"""Reading chains of transmission out of texts, and working on read chains.

The reader is driven by a lexicon (``Profile``): transmission terms, fillers, where a name ends, what ends a chain, the
sign of a second road. It reads a text in one projection; names are kept as written."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.functions.text import WORD, normalize
from corpuslink.operators.graph import pairs_of_links
from corpuslink.plans.ordered import last_before, next_in_chain, running_total, top_within
from corpuslink.session import frozen

BORROWED, NO_CHAIN, CONTINUED, NOTE = "BORROWED", "NO_CHAIN", "CONTINUED", "NOTE"
_MARKS = "[ً-ْٰـ]*"
_SAME = {"ا": "[اأإآٱ]", "ي": "[يىئ]", "و": "[وؤ]", "ه": "[هة]", "ك": "[كک]"}


def tolerant(phrase: str) -> str:
    """A normalised phrase as a pattern for text as written: marks allowed after each letter, letters of one fold alike."""
    out = []
    for ch in phrase:
        if ch == " ":
            out.append(r"\s+")
        elif "؀" <= ch <= "ۿ":
            out.append(_SAME.get(ch, ch) + _MARKS)
        else:
            out.append(re.sub(r"([\\.\[\]{}()+*?^$|])", r"\\\1", ch))
    return "".join(out)


def any_of(phrases: tuple[str, ...]) -> str:
    """Any of some normalised phrases, the longest first. Their common beginnings are written once, so that a word is tried
    letter by letter and not phrase by phrase."""
    tree: dict = {}
    for phrase in sorted(phrases):
        node = tree
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def branch(node: dict) -> str:
        ways = [tolerant(ch) + branch(below) for ch, below in node.items() if ch]
        if not ways:
            return ""
        return "(?:" + "|".join(ways) + ")" + ("?" if "" in node else "")

    return "(?:" + branch(tree) + ")"


# Transmission terms of the first scale's books, and the words between a name and the next term.
TERMS_A = ("حدثناه", "حدثنيه", "حدثنا", "حدثني", "ثنا", "حدثتنا", "حدثتني", "اخبرتنا", "اخبرتني", "اخبرنا", "اخبرني", "انبانا",
           "انباني", "سمعت", "سمعا", "سمعوا", "سمعه من", "سمعته من", "سمعها من", "سمع", "قرات علي", "قري علي", "كتب الي", "كتب الينا",
           "عمن", "انه بلغه عن", "بلغه عن", "بلغني عن", "بلغنا عن", "زعم", "عن", "ان")
TERMS_B = ("حدثناه", "حدثنيه", "حدثنا", "حدثني", "ثنا", "اخبرنا", "اخبرني", "انبانا", "انباني", "سمعت", "سمع", "قرات علي", "قري علي",
           "زعم", "عن", "ان")
FILLERS = ("قالوا", "قالت", "قالا", "قال", "يقولان", "يقول", "تقول", "انهما", "انها", "انه", "حدثهم", "حدثها", "حدثه", "اخبرهم", "اخبره",
           "يحدث", "كلاهما", "جميعا", "يحدثونه", "يحدثانه", "كلهم", "يخبر", "يذكر", "يروي", "يرويه")
HONORIFICS = ("رضي الله عنه", "رضي الله عنها", "رضي الله عنهما", "رضي الله عنهم", "رضي الله تعالي عنه", "رحمه الله", "عليه السلام")
ENDS = ("رسول الله", "النبي", "نبي الله")


@dataclass(frozen=True)
class Profile:
    """The lexicon a collection's chains are read with."""

    terms: tuple[str, ...] = TERMS_A
    fillers: tuple[str, ...] = FILLERS
    honorifics: tuple[str, ...] = HONORIFICS
    ends: tuple[str, ...] = ENDS
    switch: str = "ح"
    conjunction: str = "و"
    bare_first: bool = False
    longest: int | None = None  # letters of a name without its marks


PROFILE_A = Profile()
PROFILE_B = Profile(terms=TERMS_B, bare_first=True, longest=160)


_PART = r"[\p{L}\p{N}\p{M}_]"


def _edge(pattern: str) -> str:
    """Whole words of text as written: a mark on a letter is part of its word."""
    return rf"(?<!{_PART}){pattern}(?!{_PART})"


def with_chain_links(df: DataFrame, text: str, profile: Profile = PROFILE_A, name: str = "found") -> DataFrame:
    """``df`` with ``array<struct(term, name, end)>`` of the chain at the head of a text (C1, C2), empty when there is
    none. A name runs to the next comma, term, honorific or end marker, of which the profile's ``longest`` letters are kept;
    the chain goes on while only fillers follow a name, not the rest of a longer one; a term without a name passes to the
    next term; asides between dashes are passed over. The pieces between terms are read in steps, each step once per piece."""
    terms, fillers = any_of(profile.terms), any_of(profile.fillers)
    honour, end = any_of(profile.honorifics), any_of(profile.ends)
    filler = rf"(?:[\s،,:;.\"'\-]|{_edge(fillers)}|{_edge(honour)})"
    stop = rf"(?=\s*(?:[،,:;.\"()]|{_edge(fillers)}|{_edge(honour)}|{_edge(end)}|$))"
    one_name = rf"^([^،,:;.\"()]+?){stop}"
    letters = rf"^[\p{{M}}ـ]*(?:[^\p{{M}}ـ][\p{{M}}ـ]*){{0,{profile.longest}}}"
    bound = lambda c: c if profile.longest is None else F.regexp_extract(c, letters, 0)
    plain = F.regexp_replace(F.col(text), r"\s[-–—ـ]\s[^-–—ـ]{1,80}\s[-–—ـ](?=\s)", " ")
    head = F.regexp_replace(plain, r"^[\s\d\-–—().:\[\]]+", "")
    marked = F.regexp_replace(head, _edge(rf"{re.escape(profile.conjunction)}?({terms})"), "\u0001$1\u0002")
    rows = df.withColumn("_pieces", F.split(marked, "\u0001"))
    lead = lambda c: F.regexp_replace(c, rf"^{filler}+", "")
    first = F.trim(F.regexp_replace(lead(F.element_at("_pieces", 1)), r"[\s،,:;.]+$", ""))
    cut = F.transform(F.slice("_pieces", 2, F.size("_pieces")), lambda p: F.struct(
        F.substring_index(p, "\u0002", 1).alias("term"), lead(F.substring_index(p, "\u0002", -1)).alias("rest")))
    named = F.transform(cut, lambda p: F.struct(p["term"].alias("term"), p["rest"].alias("rest"), F.when(
        p["rest"].rlike(rf"^{_edge(end)}"), "").otherwise(bound(F.regexp_extract(p["rest"], one_name, 1))).alias("name")))
    tails = F.transform(named, lambda p: F.struct(p["term"].alias("term"), p["name"].alias("name"),
                                                  lead(F.substr(p["rest"], F.length(p["name"]) + 1)).alias("tail")))
    rows = rows.withColumn("_first", first).withColumn("_read", F.transform(tails, lambda p: F.struct(
        p["term"].alias("term"), F.trim(p["name"]).alias("name"), p["tail"].rlike(rf"^{_edge(end)}").alias("end"), (p["tail"] != "").alias("stops"))))
    stops = F.array_position(F.transform("_read", lambda p: p["stops"]), True).cast("int")
    kept = F.filter(F.when(stops > 0, F.slice("_read", 1, stops)).otherwise(F.col("_read")), lambda p: (p["name"] != "") | p["end"])
    out = lambda items: F.transform(items, lambda p: F.struct(p["term"].alias("term"), p["name"].alias("name"), p["end"].alias("end")))
    opens = F.array(F.struct(F.lit("").alias("term"), F.trim(bound(F.col("_first"))).alias("name"), F.lit(False).alias("end")))
    none = F.array().cast("array<struct<term:string,name:string,end:boolean>>")
    bare = (F.col("_first") != "") & (F.size("_read") > 0)
    whole = (F.when(bare, F.concat(opens, out(kept))).otherwise(out(kept)) if profile.bare_first
             else F.when(F.col("_first") == "", out(kept)).otherwise(none))
    return rows.withColumn(name, whole).drop("_pieces", "_first", "_read")


def extract_links(texts: DataFrame, profile: Profile = PROFILE_A) -> tuple[DataFrame, DataFrame]:
    """Chains and links of texts (C1–C3): ``chains(report_id, ordinal, reaches, problem)`` and ``links(report_id, ordinal,
    position, term, name)``. A text with a switch sign has a road per part, each a chain of its own."""
    read = frozen(_roads(texts, profile))
    return _chains(read), _links(read)


def extract_links_only(texts: DataFrame, profile: Profile = PROFILE_A) -> DataFrame:
    """The links of ``extract_links``: where the chains are not asked for, nothing is written on the way."""
    return _links(_roads(texts, profile))


def extract_chains_only(texts: DataFrame, profile: Profile = PROFILE_A) -> DataFrame:
    """The chains of ``extract_links``: no name is written on the way."""
    return _chains(frozen(_roads(texts, profile).select("report_id", "ordinal", *_facts())))


def _roads(texts: DataFrame, profile: Profile) -> DataFrame:
    roads = texts.select("report_id", F.posexplode(F.split("text", _edge(profile.switch))).alias("_i", "_road"))
    return with_chain_links(roads.select("report_id", (F.col("_i") + 1).alias("ordinal"), "_road"), "_road", profile).drop("_road")


def _facts() -> list[Column]:
    return [F.exists("found", lambda p: p["end"]).alias("reaches"), F.when(~F.exists("found", lambda p: p["name"] != ""), NO_CHAIN).alias("problem")]


def _chains(read: DataFrame) -> DataFrame:
    chains = read if "problem" in read.columns else read.select("report_id", "ordinal", *_facts())
    return chains.where((F.col("ordinal") == 1) | F.col("problem").isNull())


def _links(read: DataFrame) -> DataFrame:
    # the outer form: the plain one asks first whether there is anything, and reads every text twice for it
    named = F.filter("found", lambda p: p["name"] != "")
    return read.select("report_id", "ordinal", F.posexplode_outer(named).alias("_p", "_l")).where(F.col("_p").isNotNull()).select(
        "report_id", "ordinal", (F.col("_p") + 1).alias("position"), F.col("_l.term").alias("term"), F.col("_l.name").alias("name"))


def name_key(name: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The form two spellings of a name share across roads (C7): normalised, without article and accusative ending, forms
    of ibn and kunya one, synonyms replaced."""
    key = F.regexp_replace(normalize(name), r"[،,.:()\"]", " ")
    key = F.regexp_replace(key, rf"(?<!{WORD})ابن(?!{WORD})", "بن")
    key = F.regexp_replace(key, rf"(?<!{WORD})(?:ابا|ابي)(?!{WORD})", "ابو")
    key = F.regexp_replace(key, rf"(?<!{WORD})ال(?=\p{{L}}{{2}})", "")
    key = F.regexp_replace(key, rf"(?<=\p{{L}}{{3}})ا(?!{WORD})", "")
    key = F.trim(F.regexp_replace(key, r"\s+", " "))
    if synonyms:
        table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
        key = F.coalesce(table[key], key)
    return key


def join_roads(chains: DataFrame, links: DataFrame, synonyms: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Roads of one text that meet (C3): a road's last name is looked for in the road after it; from there on the first
    road goes on as the second. Roads without a meeting stay as written."""
    keyed = links.withColumn("_key", name_key(F.col("name"), synonyms))
    last = keyed.groupBy("report_id", "ordinal").agg(F.max_by(F.struct("position", "_key"), "position").alias("_last"))
    ahead = last.select("report_id", F.col("ordinal").alias("_road"), (F.col("ordinal") + 1).alias("ordinal"),
                        F.col("_last.position").alias("_at"), F.col("_last._key").alias("_key"))
    open_roads = chains.where(~F.col("reaches")).select("report_id", F.col("ordinal").alias("_road"))
    meets = (ahead.join(open_roads, ["report_id", "_road"], "left_semi").join(
        keyed.select("report_id", "ordinal", "_key", F.col("position").alias("_from")), ["report_id", "ordinal", "_key"])
        .groupBy("report_id", "_road", "ordinal", "_at").agg(F.min("_from").alias("_from")))
    tail = meets.join(links, ["report_id", "ordinal"]).where(F.col("position") > F.col("_from")).select(
        "report_id", F.col("_road").alias("ordinal"), (F.col("_at") + F.col("position") - F.col("_from")).alias("position"), "term", "name")
    shared = meets.join(chains.select("report_id", "ordinal", F.col("reaches").alias("_reaches")), ["report_id", "ordinal"]).select(
        "report_id", F.col("_road").alias("ordinal"), "_reaches")
    done = chains.join(shared, ["report_id", "ordinal"], "left").withColumn("reaches", F.col("reaches") | F.coalesce("_reaches", F.lit(False)))
    return done.drop("_reaches"), links.unionByName(tail)


def expand_alternates(links: DataFrame, conjunction: str = r"\s+و(?=\p{L}{3})") -> DataFrame:
    """Links that name several teachers at one place become a chain each (C4): the first alternate in the chain, every
    other in a copy numbered after it: ``(…, alternate)``, 0 for the chain itself."""
    keys = [c for c in ("report_id", "ordinal", "chain_id") if c in links.columns]
    split = links.withColumn("_names", F.split("name", conjunction))
    extra = (split.where(F.size("_names") > 1).select(*keys, F.col("position").alias("_at"), F.posexplode("_names").alias("_a", "_other"))
             .where("_a > 0"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_at", "_a"))
    copies = extra.withColumn("alternate", place).join(split, keys)
    name = F.when(F.col("position") == F.col("_at"), F.col("_other")).otherwise(F.element_at("_names", 1))
    base = split.select(*keys, F.lit(0).alias("alternate"), "position", "term", F.element_at("_names", 1).alias("name"))
    return base.union(copies.select(*keys, "alternate", "position", "term", name.alias("name")))


def cut_repeats(links: DataFrame, key: str = "name") -> DataFrame:
    """A name that stands twice in a chain (C5): what lies between its first and its last mention is cut; what begins at a
    further mention of the first link's name is a chain of its own (``part`` 2, 3 …). ``links(chain_id, position, …)``.

    No name stands twice in a part afterwards: each round cuts one repeat of every part that has one left, and writes only
    those parts again. A missing name repeats nothing."""
    head = links.where("position = 1").select("chain_id", F.col(key).alias("_head"))
    begins = F.coalesce((F.col(key) == F.col("_head")).cast("int"), F.lit(0))
    rows = running_total(links.join(head, "chain_id", "left"), ["chain_id"], [F.col("position")], begins, "_said")
    rows = frozen(rows.withColumn("part", F.greatest(F.lit(1), F.col("_said")).cast("int")).drop("_head", "_said"))
    place, columns = ["chain_id", "part"], [*links.columns, "part"]
    starts = rows.where("part > 1").groupBy(*place).agg(F.min("position").alias("_start"))
    open_parts = rows.join(starts, place, "left").withColumn("position", F.col("position") - F.coalesce("_start", F.lit(1)) + 1).select(*columns)
    done = []
    while True:
        said = open_parts.where(F.col(key).isNotNull()).groupBy(*place, key).agg(
            F.min("position").alias("_first"), F.max("position").alias("_again"), F.count(F.lit(1)).alias("_n"))
        cut = frozen(said.where("_n > 1").groupBy(*place).agg(F.min(F.struct("_first", "_again")).alias("_cut")))
        done.append(open_parts.join(cut, place, "left_anti").select(*columns))
        if cut.isEmpty():
            return reduce(DataFrame.unionByName, done)
        first, again = F.col("_cut._first"), F.col("_cut._again")
        kept = open_parts.join(cut, place).where((F.col("position") <= first) | (F.col("position") > again))
        moved = F.when(F.col("position") > again, F.col("position") - (again - first)).otherwise(F.col("position"))
        open_parts = frozen(kept.withColumn("position", moved).select(*columns))


RESTARTS = 4
# Names that repeat nothing, the words for relatives, a name joined to another by "and".
NOT_A_REPEAT = ("عبد الله",)
AND_ANOTHER = r"\sو(?:\S|$)"
RELATIVE_WORDS = ("ابيه", "ابي", "ابوه", "جده", "جدي", "امه", "عمه", "اخيه")


def cut_restarts(links: DataFrame, rounds: int = RESTARTS) -> DataFrame:
    """A road that was begun again without a sign (C5): of two mentions of a name the road is read to the first and goes on from
    the second; if the first is the road's beginning, the second begins a road of its own (``part`` 2, 3 …). Two mentions are one
    man, and no namesake, only where the same name follows both, where the link after the first is heard in the first person
    (``fresh``), or where between them a name is joined by "and". ``links(chain_id, position, name, fresh)``.

    A round makes the first such cut of every road, at most ``rounds`` times, and reads only the roads that it cut before. Relatives, names
    of one or two letters and those that begin or end many roads repeat nothing, nor does a name directly behind itself."""
    said = name_key(F.col("name"))
    usable = (F.length(said) > 2) & ~normalize(F.col("name")).isin(*NOT_A_REPEAT, *RELATIVE_WORDS)
    columns = [*[c for c in links.columns if c != "part"], "part"]
    rows = links.withColumn("part", F.lit(1)).withColumn("_said", said).withColumn("_key", F.when(usable, said)).withColumn(
        "_and", normalize(F.col("name")).rlike(AND_ANOTHER).cast("int"))
    place, done = ["chain_id", "part"], []
    rows = frozen(rows)
    for turn in range(rounds + 1):
        after = rows.select(*place, (F.col("position") - 1).alias("position"), F.col("_said").alias("_next"), F.col("fresh").alias("_anew"))
        marked = frozen(running_total(rows, place, [F.col("position")], F.col("_and"), "_ands").join(after, [*place, "position"], "left"))
        first = marked.where(F.col("_key").isNotNull()).select(*place, "_key", F.col("position").alias("_j"), F.col("_next").alias("_next_j"), F.col("_anew").alias("_anew_j"),
                                                               (F.col("_ands") - F.col("_and")).alias("_ands_j"))
        again = marked.where(F.col("_key").isNotNull()).select(*place, "_key", F.col("position").alias("_i"), "_next", (F.col("_ands") - F.col("_and")).alias("_ands_i"))
        same = (F.col("_next") == F.col("_next_j")) | F.col("_anew_j") | (F.col("_ands_i") > F.col("_ands_j"))
        pairs = again.join(first, [*place, "_key"]).where((F.col("_i") > F.col("_j") + 1) & F.coalesce(same, F.lit(False)))
        cut = frozen(pairs.groupBy(*place).agg(F.min(F.struct("_i", "_j")).alias("_cut")))
        if turn == rounds or cut.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(cut, place, "left_anti"))
        i, j = F.col("_cut._i"), F.col("_cut._j")
        held = rows.join(cut, place).withColumn("_own", j == 1)
        parts = rows.groupBy("chain_id").agg(F.max("part").alias("_parts"))
        kept = held.where(F.col("_own") | (F.col("position") <= j) | (F.col("position") > i)).join(parts, "chain_id")
        new = F.col("_own") & (F.col("position") >= i)
        moved = F.when(new, F.col("position") - i + 1).when(~F.col("_own") & (F.col("position") > i), F.col("position") - (i - j)).otherwise(F.col("position"))
        part = F.when(new, F.col("_parts") + F.col("part")).otherwise(F.col("part"))
        rows = frozen(kept.withColumn("_p", moved).withColumn("part", part).drop("position", "_cut", "_own", "_parts").withColumnRenamed("_p", "position").select(*rows.columns))
    return reduce(DataFrame.unionByName, done).select(*columns)


def borrow_previous(reports: DataFrame, chains: DataFrame, links: DataFrame, from_him: str, same_chain: str) -> tuple[DataFrame, DataFrame]:
    """Reports without a chain that point to the one before (C6): "from him" takes the last link, "with this chain" the
    whole chain of the nearest earlier report of the collection that has one. ``reports(report_id, collection,
    number_sort, text)``; returns the borrowed chains (problem BORROWED) and links.

    The nearest earlier chain is an as-of lookup along the collection, however long the collection is."""
    first = links.where("ordinal = 1")
    have = first.select("report_id").distinct().withColumn("_has", F.col("report_id"))
    head = F.substring(normalize(F.col("text")), 1, 80)
    kind = F.when(head.rlike(same_chain), "whole").when(head.rlike(from_him), "last")
    marked = reports.join(have, "report_id", "left").withColumn("_kind", F.when(F.col("_has").isNull(), kind))
    asked = last_before(marked, ["collection"], [F.col("number_sort"), F.col("report_id")], F.col("_has"), "_source")
    asked = asked.where(F.col("_kind").isNotNull() & F.col("_source").isNotNull()).select("report_id", "_kind", "_source")
    source = first.select(F.col("report_id").alias("_source"), "position", "term", "name")
    size = source.groupBy("_source").agg(F.max("position").alias("_size"))
    taken = asked.join(source, "_source").join(size, "_source").where((F.col("_kind") == "whole") | (F.col("position") == F.col("_size")))
    got = taken.select("report_id", F.lit(1).alias("ordinal"), F.when(F.col("_kind") == "last", 1).otherwise(F.col("position")).alias("position"),
                       "term", "name")
    reaches = chains.where("ordinal = 1").select(F.col("report_id").alias("_source"), "reaches")
    borrowed = asked.join(reaches, "_source", "left").select("report_id", F.lit(1).alias("ordinal"), F.coalesce("reaches", F.lit(False)).alias("reaches"),
                                                           F.lit(BORROWED).alias("problem"))
    return borrowed, got


def continue_by_last_whole(stopped: DataFrame, whole: DataFrame) -> DataFrame:
    """A stopped road that says "with this chain" goes on as the last whole chain after the shared person (C6 b).
    ``stopped(report_id, position, key, source)``, ``whole(source, position, key, name)``: the added links."""
    last = stopped.groupBy("report_id", "source").agg(F.max("position").alias("_at"), F.max_by("key", "position").alias("key"))
    met = last.join(whole.select("source", "key", F.col("position").alias("_from")), ["source", "key"]).groupBy("report_id", "source", "_at").agg(
        F.min("_from").alias("_from"))
    return met.join(whole, "source").where(F.col("position") > F.col("_from")).select(
        "report_id", (F.col("_at") + F.col("position") - F.col("_from")).alias("position"), "name")


def attested_edges(chains: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst) with the distinct reports whose fully split chains show the pair."""
    if "problem" in chains.columns:
        chains = chains.where(F.col("problem").isNull())
    pairs = pairs_of_links(links).where("src <> dst").join(chains.select("chain_id", "report_id"), "chain_id")
    return pairs.select("src", "dst", "report_id").distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("reports"))


def join_stopped(chains: DataFrame, links: DataFrame, attested: DataFrame, persons: DataFrame, named: DataFrame | None = None,
                 least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Stopped roads joined to another road of the report at the most attested teacher (C9): added links and the audit
    ``(chain_id, report_id, first_position, student, teacher, attested, said)``.

    The teacher is attested in ``least`` other reports (in one if ``named(chain_id, person_id)`` names him); never when
    the reverse is as frequent, the teacher's generation is later, or the deaths are outside −40..100 years."""
    size = links.groupBy("chain_id").agg(F.max("position").alias("_at"), F.max_by("person_id", "position").alias("student"))
    several = chains.groupBy("report_id").count().where("count > 1").select("report_id")
    roads = chains.join(several, "report_id", "left_semi")
    stopped = (roads.where(~F.col("reaches")).join(size, "chain_id").where(F.col("student").isNotNull())
               .select("chain_id", "report_id", "_at", "student"))
    others = (roads.where("reaches").select(F.col("chain_id").alias("other"), "report_id").join(
        links.select(F.col("chain_id").alias("other"), F.col("position").alias("_j"), F.col("person_id").alias("teacher")), "other")
        .where((F.col("_j") > 1) & F.col("teacher").isNotNull()))
    pairs = stopped.join(others, "report_id").where((F.col("chain_id") != F.col("other")) & (F.col("student") != F.col("teacher")))
    shown = (pairs_of_links(links).join(chains.select("chain_id", "report_id"), "chain_id").select(
        "report_id", F.col("src").alias("student"), F.col("dst").alias("teacher")).distinct().withColumn("_own", F.lit(1)))
    seen = attested.select(F.col("src").alias("student"), F.col("dst").alias("teacher"), F.col("reports").alias("_seen"))
    back = attested.select(F.col("dst").alias("student"), F.col("src").alias("teacher"), F.col("reports").alias("_back"))
    fact = lambda end: persons.select(F.col("person_id").alias(end), F.col("generation").alias(f"_g_{end}"), F.col("death_year").alias(f"_d_{end}"))
    rows = (pairs.join(seen, ["student", "teacher"]).join(shown, ["report_id", "student", "teacher"], "left")
            .join(back, ["student", "teacher"], "left").join(fact("student"), "student", "left").join(fact("teacher"), "teacher", "left")
            .withColumn("attested", F.col("_seen") - F.coalesce("_own", F.lit(0))))
    said = F.lit(False)
    if named is not None:
        rows = rows.join(named.select("chain_id", F.col("person_id").alias("teacher"), F.lit(True).alias("_said")), ["chain_id", "teacher"], "left")
        said = F.coalesce("_said", F.lit(False))
    gap = F.col("_d_student") - F.col("_d_teacher")
    fits = ((F.coalesce("_back", F.lit(0)) < F.col("attested")) & ~F.coalesce(F.col("_g_teacher") > F.col("_g_student"), F.lit(False))
            & F.coalesce(gap.between(-40, 100), F.lit(True)))
    rows = rows.withColumn("said", said).where(fits & (F.col("attested") >= F.when(F.col("said"), 1).otherwise(least)))
    best = top_within(rows, ["chain_id"], [F.desc("said"), F.desc("attested"), F.asc("other"), F.asc("_j")], 1)
    best = frozen(best.select("chain_id", "report_id", "_at", "student", "teacher", "attested", "said", "other", "_j"))
    tail = best.join(links.withColumnRenamed("chain_id", "other"), "other").where(F.col("position") >= F.col("_j")).select(
        "chain_id", (F.col("_at") + 1 + F.col("position") - F.col("_j")).alias("position"), "person_id")
    audit = best.select("chain_id", "report_id", (F.col("_at") + 1).alias("first_position"), "student", "teacher", "attested", "said")
    return tail, audit


def undo_joins(links: DataFrame, audit: DataFrame) -> DataFrame:
    """The links as they were before roads were joined."""
    cut = audit.select("chain_id", "first_position")
    return links.join(cut, "chain_id", "left").where(
        F.col("first_position").isNull() | (F.col("position") < F.col("first_position"))).drop("first_position")


READ_BACK = 1000


def read_back(links: DataFrame, persons: DataFrame) -> DataFrame:
    """Chains in order with their persons (C10): one row per thousand links, ``(chain_id, part, links)``; a longer chain
    goes on in the next part."""
    named = links.join(persons.select("person_id", "name"), "person_id", "left")
    part = F.floor((F.col("position") - 1) / READ_BACK).cast("int")
    return named.groupBy("chain_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("position", "person_id", "name"))).alias("links"))


def extraction_report(chains: DataFrame, links: DataFrame) -> DataFrame:
    """Per collection: chains, split, reaching, links, and problems by reason (C11). ``chains(chain_id, collection, reaches,
    problem)``; reasons are rows, the whole collection has reason null."""
    size = links.groupBy("chain_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = chains.join(size, "chain_id", "left")
    total = rows.groupBy("collection").agg(
        F.lit(None).cast("string").alias("reason"), F.count(F.lit(1)).alias("chains"), F.count_if(F.col("problem").isNull()).alias("split"),
        F.count_if("reaches").alias("reaching"), F.coalesce(F.sum("_n"), F.lit(0)).alias("links"))
    by_reason = rows.where(F.col("problem").isNotNull()).groupBy("collection", F.col("problem").alias("reason")).agg(
        F.count(F.lit(1)).alias("chains"), F.lit(0).cast("long").alias("split"), F.count_if("reaches").alias("reaching"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("links"))
    return total.unionByName(by_reason)


def resolution_rate(links: DataFrame, chains: DataFrame) -> DataFrame:
    """The share of links with a person, per collection."""
    rows = links.join(chains.select("chain_id", "collection"), "chain_id")
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("links"), F.avg(F.col("person_id").isNotNull().cast("double")).alias("resolved"))


def term_counts(links: DataFrame, chains: DataFrame) -> DataFrame:
    """How often each transmission term occurs in each collection."""
    return links.join(chains.select("chain_id", "collection"), "chain_id").groupBy("collection", "term").agg(F.count(F.lit(1)).alias("links"))


# What stands for a person in a link without being a name.
GROUPS = ("عده من اصحابنا", "جماعه من اصحابنا", "غير واحد من اصحابنا", "غير واحد")
PREVIOUS = ("عنه", "عنهم", "وعنه")
VAGUE = ("رجل", "رجل من اصحابنا", "بعض اصحابنا", "بعض اصحابه", "بعض اصحابهم", "من ذكره", "من حدثه", "بعض رجاله", "رجل من اهل", "من اخبره",
         "بعض من رواه", "بعض اصحابنا رفعه")
VAGUE_STARTS = ("بعض اصحاب", "رجل من", "بعض من", "من ذكره", "من حدثه")


def link_kind(name: Column) -> Column:
    """What a link's raw name is (C13): ``group``, ``previous`` ("from him"), ``vague`` (unnamed) or ``person``."""
    n = F.regexp_replace(normalize(name), r"^[\s،,]+|[\s،,]+$", "")
    vague = n.isin(*VAGUE)
    for start in VAGUE_STARTS:
        vague = vague | F.startswith(n, F.lit(start))
    return F.when(n.isin(*GROUPS), "group").when(n.isin(*PREVIOUS), "previous").when(vague, "vague").otherwise("person")


def group_members(links: DataFrame, members: DataFrame) -> DataFrame:
    """The members a group link stands for, read from the next link's name (C13). ``links(chain_id, position, name)``,
    ``members(group, head, member)``: a rule table."""
    groups = next_in_chain(links.select("chain_id", "position", "name"), "chain_id", "position", ["name"]).where(link_kind(F.col("name")) == "group")
    keyed = groups.select("chain_id", "position", normalize(F.col("name")).alias("group"), normalize(F.col("name_next")).alias("_next"))
    return keyed.join(members, "group").where(F.startswith(F.col("_next"), F.col("head"))).select("chain_id", "position", "member")


def full_first_names(links: DataFrame, teachers: DataFrame) -> DataFrame:
    """A compiler's short teacher names at the first link written in full (C13). ``teachers(collection, short, long)``."""
    known = teachers.select("collection", F.col("short").alias("_short"), "long")
    rows = links.withColumn("_short", F.when(F.col("position") == 1, F.trim(normalize(F.col("name")))))
    return rows.join(known, ["collection", "_short"], "left").withColumn("name", F.coalesce("long", "name")).drop("_short", "long")


def origin_only(texts: DataFrame, origins: DataFrame, direct: list[str], opener: str) -> tuple[DataFrame, DataFrame]:
    """Collections that cite without chains (C14): the person after ``opener`` in the first 160 characters is a one-link
    chain when on the list and of at most six words; ``direct`` collections reach the origin without a link; otherwise
    the reason. ``texts(report_id, collection, text)``, ``origins(name)`` normalised."""
    head = F.substring(normalize(F.col("text")), 1, 160)
    name = F.trim(F.regexp_extract(head, rf"{opener}\s+((?:[^\s،,:.]+\s?){{1,6}}?)(?=\s*(?:[،,:.]|قال|$))", 1))
    read = texts.select("report_id", "collection", name.alias("name"), head.alias("_head"))
    rows = read.join(origins.select("name").distinct().withColumn("_on", F.lit(True)), "name", "left")
    reached = F.col("_on").isNotNull() | F.col("collection").isin(direct)
    reason = (F.when(F.col("_head").rlike(r"^\s*(?:و|ثم|مثله|نحوه)"), CONTINUED).when(F.length(F.trim("_head")) < 20, NOTE).otherwise(NO_CHAIN))
    chains = rows.select("report_id", F.lit(1).alias("ordinal"), reached.alias("reaches"), F.when(~reached, reason).alias("problem"))
    return chains, rows.where(F.col("_on").isNotNull()).select("report_id", F.lit(1).alias("ordinal"), F.lit(1).alias("position"), F.lit("").alias("term"), "name")
