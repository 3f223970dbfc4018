"""Tying names to persons by explicit evidence.

Distinct names are looked up once. What may be meant at a link is a row of ``cands(chain_id, position, person_id,
generation, death_year)``; each rule narrows the candidates of a link or decides it. A rule that would leave nothing
leaves the link as it was."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.functions.names import name_tokens, without_spelling
from corpuslink.functions.text import normalize
from corpuslink.operators.graph import pairs_of_links
from corpuslink.plans.ordered import beside, has_hot_group, top_within
from corpuslink.session import frozen, removed

SLOT = ["chain_id", "position"]
# The confidence of each way of deciding.
SURE, EVIDENCE, GUESS, NEIGHBOURS, FAMOUS = 1.0, 0.8, 0.7, 0.6, 0.5


@dataclass(frozen=True)
class Rules:
    """Which rules run and with what parameters."""

    on: frozenset[str] = frozenset({"marks", "order", "companion", "teacher", "client", "bare", "elsewhere", "impossible", "neighbours", "famous", "father",
                                    "one_side", "father_pair"})
    guesses: bool = True
    first_generation: int = 9
    trust: float = 0.7
    rounds: int = 3
    least: int = 2
    lead: float = 3.0
    one_least: int = 6
    one_lead: float = 5.0
    after: int = 4
    before: int = 6
    death_years: int = 80
    pair_least: int = 1
    pair_few: int = 3
    authors: dict[str, int] = field(default_factory=dict)

    def use(self, rule: str) -> bool:
        """Whether a rule runs: switched on, and, if it only infers, with guesses allowed."""
        return rule in self.on and (self.guesses or rule not in GUESSING)


# The rules that infer where the sources are silent.
GUESSING = frozenset({"bare", "elsewhere", "neighbours", "famous", "one_side", "father_pair"})


# ------------------------------------------------------------------ candidates of names
def _bare(word: Column) -> Column:
    return F.when(F.startswith(word, F.lit("ال")) & (F.length(word) > 4), F.substring(word, 3, 1000)).otherwise(word)


def looked_up(name: Column) -> Column:
    """The words a name is looked up by: its tokens without spelling notes and articles."""
    return F.transform(without_spelling(name_tokens(name)), _bare)


def _in_order(short: Column, long: Column) -> Column:
    """Whether the words of ``short`` occur in ``long`` in order."""
    met = F.aggregate(long, F.lit(1), lambda at, w: F.when(F.try_element_at(short, at) == w, at + 1).otherwise(at))
    return met > F.size(short)


def turned(words: Column) -> Column:
    """The orders a name may be looked up in (E1): as written, and with a nisba or a kunya that stands before the given name
    behind the lineage. Words keep their articles here."""
    n = F.size(words)
    first = F.try_element_at(words, F.lit(1))
    later = lambda k: F.array_contains(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))), "بن")
    behind = lambda k: F.concat(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))), F.slice(words, 1, k))
    nisba = (n > 3) & F.startswith(first, F.lit("ال")) & later(1)
    kunya = (n > 4) & first.isin("ابو", "ام") & later(2)
    return F.when(nisba, F.array(words, behind(1))).when(kunya, F.array(words, behind(2))).otherwise(F.array(words))


def name_candidates(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(name, person_id, tier, way)`` for distinct names (E1): a whole alias, or the same given name and father with the
    other words in order, in each order the name may be turned to; names nothing fits are tried again without the accusative
    ending. ``aliases(person_id, alias, tier)``. Names and aliases meet by a key: the whole name, or its given name and father."""
    asked = names.select("name").distinct().withColumn("_o", F.explode(turned(without_spelling(name_tokens(F.col("name"))))))
    asked = asked.select("name", F.transform("_o", _bare).alias("_w")).where(F.size("_w") > 0)
    known = aliases.select("person_id", "tier", looked_up(F.col("alias")).alias("_a")).where(F.size("_a") > 0)

    def find(wanted: DataFrame) -> DataFrame:
        exact = wanted.withColumn("_k", F.array_join("_w", " ")).join(known.withColumn("_k", F.array_join("_a", " ")), "_k").select(
            "name", "person_id", "tier", F.lit("name").alias("way"))
        # a given name is one word or two ("Abd Allah"): the head runs to the word after the first "son of"
        son = lambda c: F.array_position(c, "بن").cast("int")
        head = lambda c: F.array_join(F.slice(c, 1, son(c) + 1), " ")
        nasab = lambda c: son(c).between(2, 3) & (F.size(c) > son(c))
        longer = known.where(nasab(F.col("_a")) & (F.size("_a") > son(F.col("_a")) + 1)).withColumn("_k", head(F.col("_a")))
        within = (wanted.where(nasab(F.col("_w"))).withColumn("_k", head(F.col("_w"))).join(longer, "_k")
                  .where(_in_order(F.col("_w"), F.col("_a"))).select("name", "person_id", "tier", F.lit("name").alias("way")))
        return exact.union(within).distinct()

    first = frozen(find(asked))
    left = asked.join(first.select("name").distinct(), "name", "left_anti")
    again = find(left.withColumn("_w", F.transform("_w", lambda w: F.regexp_replace(w, r"(?<=\p{L}{3})ا$", ""))))
    return first.union(again)


def best_tier(found: DataFrame) -> DataFrame:
    """Only the candidates of the first work that has any."""
    least = found.groupBy("name").agg(F.min("tier").alias("_t"))
    return found.join(least, "name").where(F.col("tier") == F.col("_t")).drop("_t")


def candidates(links: DataFrame, found: DataFrame, persons: DataFrame) -> DataFrame:
    """The candidates of every link, by its name. ``links(chain_id, position, name)``."""
    return links.select(*SLOT, "name").join(found.select("name", "person_id").distinct(), "name").join(
        persons.select("person_id", "generation", "death_year"), "person_id").drop("name")


def with_mark(cands: DataFrame, chains: DataFrame, marks: DataFrame) -> DataFrame:
    """Candidates that carry the mark of the link's collection (E3); a link may be left without any."""
    rows = cands.join(chains.select("chain_id", "collection"), "chain_id")
    return rows.join(marks.select("person_id", F.col("mark").alias("collection")), ["person_id", "collection"], "left_semi").select(*cands.columns)


def keep_if_any(cands: DataFrame, keep: Column) -> DataFrame:
    """The candidates that pass, where a link has one that does; otherwise all of its candidates."""
    some = F.max(F.coalesce(keep, F.lit(False)).cast("int")).over(W.partitionBy(*SLOT))
    return cands.withColumn("_some", some).where((F.col("_some") == 0) | keep).drop("_some")


def narrow_ends(cands: DataFrame, chains: DataFrame, sizes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The first link is of a late generation, the last of a chain that reaches the origin of the first (E4); no
    generation passes. A collection whose author heads its own chains (``rules.authors``) takes him where the name may
    mean him. ``sizes(chain_id, size)``."""
    more = ["collection"] if rules.authors and "collection" not in cands.columns else []
    rows = cands.join(chains.select("chain_id", "reaches", *more), "chain_id").join(sizes, "chain_id")
    g = F.col("generation")
    if "teacher" in rules.on:
        late = g.isNull() | (g >= rules.first_generation)
        if rules.authors:
            own = F.create_map(*[F.lit(x) for pair in rules.authors.items() for x in pair])[F.col("collection")]
            heads = F.max(F.coalesce(F.col("person_id") == own, F.lit(False)).cast("int")).over(W.partitionBy(*SLOT)) == 1
            rows = rows.withColumn("_heads", heads)
            late = F.when(F.col("_heads"), F.col("person_id") == own).otherwise(late)
        rows = keep_if_any(rows, (F.col("position") != 1) | late)
    if "companion" in rules.on:
        rows = keep_if_any(rows, (F.col("position") != F.col("size")) | ~F.col("reaches") | g.isNull() | (g == 1))
    return rows.select(*cands.columns)


def order_bounds(cands: DataFrame, hot: bool | None = None) -> DataFrame:
    """For each link with candidates the least generation of the next one's and the greatest of the previous one's, null
    where any of theirs is unknown (E5)."""
    known = F.count_if(F.col("generation").isNull()) == 0
    per_slot = cands.groupBy(*SLOT).agg(F.when(known, F.min("generation")).alias("low"), F.when(known, F.max("generation")).alias("high"))
    near = beside(per_slot, ["chain_id"], [F.col("position")], ["low", "high"], hot)
    return near.select(*SLOT, F.col("low_after").alias("_low"), F.col("high_before").alias("_high"))


def monotone(cands: DataFrame, rounds: int | None = None, hot: bool | None = None) -> DataFrame:
    """Generations never grow towards the origin (E5): candidates outside their neighbours' bounds go, again and again
    until nothing changes (or for ``rounds``). Chains in which every link has one candidate cannot change and are left alone from
    the start; each round reads and writes only the chains that lost a candidate in the one before."""
    whole = cands if hasattr(cands, "_frozen_at") else frozen(cands)
    several = whole.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    waiting = frozen(several.select("chain_id").distinct())
    now, settled = frozen(whole.join(waiting, "chain_id", "left_semi").select(*cands.columns)), [whole.join(waiting, "chain_id", "left_anti")]
    hot = has_hot_group(now, ["chain_id"]) if hot is None else hot
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        g = F.col("generation")
        fits = g.isNull() | ((F.col("_low").isNull() | (F.col("_low") <= g)) & (F.col("_high").isNull() | (F.col("_high") >= g)))
        some = F.max(fits.cast("int")).over(W.partitionBy(*SLOT))
        seen = frozen(now.join(order_bounds(now, hot), SLOT).withColumn("_stays", (some == 0) | fits).select(*cands.columns, "_stays"))
        changed = frozen(seen.where("not _stays").select("chain_id").distinct())
        if changed.isEmpty():
            removed(seen)
            break
        left = seen.where("_stays").select(*cands.columns)
        settled.append(left.join(changed, "chain_id", "left_anti"))
        now = frozen(left.join(changed, "chain_id", "left_semi").select(*cands.columns), now)
    for part in settled:
        now = now.unionByName(part)
    return now.select(*cands.columns)


def clients(cands: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """The one candidate whose entry calls him the client of the next link's person (E6). ``entries(person_id, entry)``."""
    following = links.select("chain_id", (F.col("position") - 1).alias("position"), F.array_join(name_tokens(F.col("name")), " ").alias("_next"))
    rows = cands.join(following, SLOT, "left").join(entries.select("person_id", F.array_join(name_tokens(F.col("entry")), " ").alias("_entry")), "person_id", "left")
    hit = F.coalesce(F.contains(F.concat("_entry", F.lit(" ")), F.concat(F.lit(" مولي "), F.col("_next"), F.lit(" "))), F.lit(False))
    hits = F.sum(hit.cast("int")).over(W.partitionBy(*SLOT))
    return rows.withColumn("_hit", hit).withColumn("_hits", hits).where((F.col("_hits") != 1) | F.col("_hit")).select(*cands.columns)


def bare_names(cands: DataFrame, links: DataFrame, table: DataFrame) -> DataFrame:
    """Bare names read by their neighbours (E7). ``table(name, person_id, beside, side)`` in normal form, side = teacher or
    student; a link whose rules point to one person alone is his."""
    key = lambda c: F.array_join(looked_up(c), " ")
    said = links.select(*SLOT, key(F.col("name")).alias("name"))
    nearby = said.select("chain_id", (F.col("position") - 1).alias("position"), F.col("name").alias("beside"), F.lit("teacher").alias("side")).union(
        said.select("chain_id", F.col("position") + 1, "name", F.lit("student")))
    hits = said.join(table, "name").join(nearby, [*SLOT, "beside", "side"], "left_semi").select(*SLOT, "person_id").distinct().withColumn("_hit", F.lit(True))
    rows = cands.join(hits, [*SLOT, "person_id"], "left").withColumn("_hits", F.count("_hit").over(W.partitionBy(*SLOT)))
    return rows.where((F.col("_hits") != 1) | F.col("_hit")).select(*cands.columns)


def famous(open_links: DataFrame, table: DataFrame) -> DataFrame:
    """Links still open whose bare name has one famous bearer (E8). ``table(name, person_id)`` in normal form."""
    key = F.array_join(looked_up(F.col("name")), " ")
    known = table.select(F.col("name").alias("_key"), "person_id")
    return open_links.withColumn("_key", key).join(known, "_key").select(*SLOT, "person_id", F.lit(FAMOUS).alias("confidence"), F.lit("famous").alias("rule"))


def elsewhere(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Names nothing fits, found inside persons' entries (E9): every word of the name, by its rarest word.
    ``entries(person_id, entry)``."""
    asked = names.select("name", looked_up(F.col("name")).alias("_w")).where(F.size("_w") >= 2)
    inside = entries.select("person_id", looked_up(F.col("entry")).alias("_e"))
    postings = inside.select("person_id", F.explode(F.array_distinct("_e")).alias("word"))
    counts = postings.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    rarest = asked.select("name", F.explode("_w").alias("word")).join(counts, "word").groupBy("name").agg(
        F.min_by("word", F.struct("_df", "word")).alias("word"))
    pairs = rarest.join(postings, "word").join(asked, "name").join(inside, "person_id")
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return pairs.where(F.contains(joined("_e"), joined("_w"))).select("name", "person_id", F.lit(9).alias("tier"), F.lit("elsewhere").alias("way"))


# ------------------------------------------------------------------ results and global evidence
def decided(links: DataFrame, cands: DataFrame, first_counts: DataFrame, guessed: DataFrame | None = None) -> DataFrame:
    """Every link with its person where one candidate is left (E16): ``(chain_id, position, person_id, confidence, rule,
    candidates)``. Sure when the name alone decided, by evidence otherwise, a guess where ``guessed`` says so.
    ``first_counts(chain_id, position, candidates)``: how many the name alone had."""
    left = cands.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("_n"), F.min("person_id").alias("_who"))
    rows = links.select(*SLOT).join(left, SLOT, "left").join(first_counts, SLOT, "left")
    one = F.col("_n") == 1
    sure = F.col("candidates") == 1
    if guessed is not None:
        rows = rows.join(guessed.select(*SLOT, F.lit(True).alias("_guess")), SLOT, "left")
    else:
        rows = rows.withColumn("_guess", F.lit(None).cast("boolean"))
    confidence = F.when(one, F.when(F.col("_guess"), GUESS).when(sure, SURE).otherwise(EVIDENCE))
    rule = F.when(one, F.when(F.col("_guess"), "guess").when(sure, "name").otherwise("evidence"))
    return rows.select(*SLOT, F.when(one, F.col("_who")).alias("person_id"), confidence.alias("confidence"), rule.alias("rule"),
                       F.coalesce("candidates", F.lit(0)).alias("candidates"))


def trusted_edges(results: DataFrame, trust: float) -> DataFrame:
    """(src, dst, weight) from neighbouring links that are both trusted."""
    sure = results.select("chain_id", "position", F.when(F.col("confidence") >= trust, F.col("person_id")).alias("person_id"))
    return pairs_of_links(sure).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _sides(results: DataFrame) -> DataFrame:
    """Each link with the persons and confidences before and after it, and whether it is the last. Positions are whole
    numbers, so neighbours are joined by position: no chain is gathered."""
    side = lambda step, end: results.select("chain_id", (F.col("position") + step).alias("position"), F.col("person_id").alias(f"{end}"),
                                            F.col("confidence").alias(f"{end}_confidence"), F.lit(True).alias(f"has_{end}"))
    return results.join(side(1, "student"), SLOT, "left").join(side(-1, "teacher"), SLOT, "left").withColumn("last", F.col("has_teacher").isNull())


def _scored(open_links: DataFrame, cands: DataFrame, edges: DataFrame) -> DataFrame:
    """The candidates of open links with how often each is seen below and above."""
    rows = open_links.join(cands.select(*SLOT, F.col("person_id").alias("who")), SLOT)
    below = edges.select(F.col("src").alias("student"), F.col("dst").alias("who"), F.col("weight").alias("_below"))
    above = edges.select(F.col("src").alias("who"), F.col("dst").alias("teacher"), F.col("weight").alias("_above"))
    return rows.join(below, ["student", "who"], "left").join(above, ["who", "teacher"], "left").na.fill(0, ["_below", "_above"])


def _lead(rows: DataFrame, score: Column) -> DataFrame:
    """Per link the best and second score and the best one's person."""
    two = top_within(rows.withColumn("_score", score), SLOT, [F.desc("_score"), F.desc("who")], 2)
    pick = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    return two.groupBy(*SLOT).agg(pick(1, "who").alias("_who"), pick(1, "_score").alias("_best"), pick(2, "_score").alias("_second"),
                                  F.max(F.col("last").cast("int")).alias("_last"), F.max("_open").alias("_open"))


def _open(results: DataFrame, cands: DataFrame) -> DataFrame:
    several = cands.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("_open")).where("_open >= 2")
    return _sides(results).where(F.col("person_id").isNull()).drop("person_id", "confidence", "rule").join(several, SLOT)


def _taken(results: DataFrame, won: DataFrame, confidence: float, rule: str) -> DataFrame:
    rows = results.join(won.select(*SLOT, "_who"), SLOT, "left")
    new = F.col("_who").isNotNull()
    return frozen(rows.select(*SLOT, F.coalesce("_who", "person_id").alias("person_id"),
                              F.when(new, confidence).otherwise(F.col("confidence")).alias("confidence"),
                              F.when(new, rule).otherwise(F.col("rule")).alias("rule"), "candidates"))


def by_neighbours(results: DataFrame, cands: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Open links decided by both neighbours (E10): the candidate seen with both, in two chains or more and three times
    the next; the last link by its student alone, in one chain more. Repeated as links become known."""
    for _ in range(rules.rounds):
        won = frozen(neighbours_won(results, cands, frozen(trusted_edges(results, rules.trust)), rules))
        if won.isEmpty():
            break
        results = _taken(results, won, NEIGHBOURS, "neighbours")
    return results


def neighbours_won(results: DataFrame, cands: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """The links of ``results`` that one round of E10 decides, ``_who`` for each."""
    return _both_say(_scored(_both_known(_open(results, cands)), cands, edges), rules)


def _both_known(asked: DataFrame) -> DataFrame:
    """The open links that E10 asks about: both neighbours known, or the last one with its student."""
    return asked.where(F.col("student").isNotNull() & (F.col("teacher").isNotNull() | F.col("last")))


def _both_say(rows: DataFrame, rules: Rules) -> DataFrame:
    """What E10 decides from scored candidates; those never seen may be missing: they score 0, and a best of 0 decides nothing."""
    best = _lead(rows, F.when(F.col("last"), F.col("_below")).otherwise(F.least("_below", "_above")))
    second = F.coalesce("_second", F.lit(0))
    return best.where((F.col("_best") >= rules.least + F.col("_last")) & (F.col("_best") >= rules.lead * second) & (F.col("_best") > second))


def by_one_side(results: DataFrame, cands: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Open links with a known neighbour on one side (E11): six chains or more and five times the next; a neighbour known
    only as famous does not count beside a better one; with both known the teacher decides, if the student does not
    gainsay it."""
    return _taken(results, one_side_won(results, cands, frozen(trusted_edges(results, rules.trust)), rules), NEIGHBOURS, "one_side")


def one_side_won(results: DataFrame, cands: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """The links of ``results`` that E11 decides, ``_who`` for each."""
    return _one_says(_scored(_one_known(_open(results, cands)), cands, edges), rules)


def _one_known(asked: DataFrame) -> DataFrame:
    """The open links that E11 asks about, with the neighbours that count."""
    weak = lambda end: F.coalesce(F.col(f"{end}_confidence"), F.lit(0.0)) <= FAMOUS
    both = F.col("student").isNotNull() & F.col("teacher").isNotNull()
    one_weak = both & (weak("student") != weak("teacher"))
    asked = asked.withColumn("_s", F.when(~(one_weak & weak("student")), F.col("student"))).withColumn(
        "_t", F.when(~(one_weak & weak("teacher")), F.col("teacher")))
    return asked.withColumn("student", F.col("_s")).withColumn("teacher", F.col("_t")).drop("_s", "_t").where(
        F.col("student").isNotNull() | F.col("teacher").isNotNull())


def _one_says(scored: DataFrame, rules: Rules) -> DataFrame:
    """What E11 decides from scored candidates; those never seen may be missing: they score 0."""
    rows = frozen(scored)
    both = F.col("student").isNotNull() & F.col("teacher").isNotNull()
    by_teacher = F.col("teacher").isNotNull()
    best = _lead(rows, F.when(by_teacher, F.col("_above")).otherwise(F.col("_below")))
    kept = rows.where(both).groupBy(*SLOT).agg(F.max("_below").alias("_most"))
    mine = rows.where(both).select(*SLOT, F.col("who").alias("_who"), F.col("_below").alias("_mine"))
    best = best.join(kept, SLOT, "left").join(mine, [*SLOT, "_who"], "left")
    agreed = F.coalesce(F.col("_mine") >= F.col("_most"), F.lit(True))
    return best.where((F.col("_best") >= rules.one_least) & (F.col("_best") >= rules.one_lead * F.greatest(F.coalesce("_second", F.lit(0)), F.lit(1))) & agreed)


# The words for a father and a grandfather in a chain.
FATHER_WORDS, GRANDFATHER_WORDS = ("ابيه", "ابي", "ابوه"), ("جده", "جدي")


def kin(links: DataFrame) -> DataFrame:
    """``(chain_id, position, at, up)`` for every link that names a relative of the one before: the nearest link before it
    that names a person, and how many generations above him the relative is (E12). "His grandfather" after another
    relative is one generation further, else two. Pointers are doubled, so a run of relatives of any length takes rounds by the
    logarithm of its length."""
    name = normalize(F.col("name"))
    named = links.select(*SLOT, F.when(name.isin(*FATHER_WORDS), 1).when(name.isin(*GRANDFATHER_WORDS), 2).alias("_k")).where(F.col("_k").isNotNull())
    before = named.select("chain_id", (F.col("position") + 1).alias("position"), F.lit(True).alias("_after_kin"))
    up = F.when(F.col("_after_kin"), 1).otherwise(F.col("_k"))
    now = frozen(named.join(before, SLOT, "left").select(*SLOT, (F.col("position") - 1).alias("at"), up.alias("up")))
    while True:
        jump = now.select("chain_id", F.col("position").alias("at"), F.col("at").alias("_at"), F.col("up").alias("_up"))
        step = now.join(jump, ["chain_id", "at"], "left")
        if step.where(F.col("_at").isNotNull()).isEmpty():
            return now
        now = frozen(step.select(*SLOT, F.coalesce("_at", "at").alias("at"), (F.col("up") + F.coalesce("_up", F.lit(0))).alias("up")), now)


def ancestors(rows: DataFrame, fathers: DataFrame) -> DataFrame:
    """``rows`` with the ancestor of ``son`` that lies ``up`` generations above as ``father``; rows without one go. The table
    of fathers is squared each round: rounds by the logarithm of the greatest number of generations."""
    climb = fathers.select("son", "father")
    now = frozen(rows.withColumn("father", F.col("son")).withColumn("_left", F.col("up")))
    while not now.where("_left > 0").isEmpty():
        step = now.join(climb.select(F.col("son").alias("father"), F.col("father").alias("_next")), "father", "left")
        odd = F.col("_left") % 2 == 1
        now = frozen(step.where(~odd | F.col("_next").isNotNull()).select(*rows.columns, F.when(odd, F.col("_next")).otherwise(F.col("father")).alias("father"),
                                                                         F.floor(F.col("_left") / 2).cast("int").alias("_left")), now)
        climb = frozen(climb.join(climb.select(F.col("son").alias("father"), F.col("father").alias("_above")), "father").select("son", F.col("_above").alias("father")))
    return now.drop("_left")


def relatives(links: DataFrame, results: DataFrame, fathers: DataFrame, persons: DataFrame) -> DataFrame:
    """"His father", "his grandfather" and runs of them, read from the person before (E12): ``(chain_id, position, person_id)``.
    ``fathers(son, father)``; a relative of an earlier generation than the person after him is not taken."""
    return relatives_won(kin(links), results, fathers, persons).drop("confidence")


def relatives_won(asked: DataFrame, results: DataFrame, fathers: DataFrame, persons: DataFrame) -> DataFrame:
    """The open links of ``asked`` (their ``kin``) that E12 decides, sure as far as the person before is, else a guess."""
    known = results.where(F.col("person_id").isNotNull()).select("chain_id", "position", "person_id", "confidence")
    base = known.select("chain_id", F.col("position").alias("at"), F.col("person_id").alias("son"), F.col("confidence").alias("_sure"))
    rows = ancestors(asked.join(known.select(*SLOT), SLOT, "left_anti").join(base, ["chain_id", "at"]), fathers)
    after = known.select("chain_id", (F.col("position") - 1).alias("position"), F.col("person_id").alias("_after"))
    g = lambda end, name: persons.select(F.col("person_id").alias(end), F.col("generation").alias(name))
    rows = rows.join(after, SLOT, "left").join(g("father", "_gf"), "father", "left").join(g("_after", "_ga"), "_after", "left")
    sure = F.when(F.col("_sure") >= EVIDENCE, EVIDENCE).otherwise(GUESS)
    return rows.where(~F.coalesce(F.col("_ga") > F.col("_gf"), F.lit(False))).select(*SLOT, F.col("father").alias("person_id"), sure.alias("confidence"))


# What each thing a father's entry shares with the son's lineage weighs.
FATHER_WEIGHTS = {"grandfather": 2.0, "kunya": 1.0, "tribe": 1.0, "city": 0.5, "patron": 1.0, "names_son": 3.0}


def alike_fathers(people: DataFrame, same: list[str]) -> DataFrame:
    """The fathers that agree in all columns of ``same`` as one row: ``father`` the smallest, ``last`` the greatest, ``alike`` how
    many. ``people(father, …same)``, each person once."""
    return people.groupBy(*same).agg(F.min("father").alias("father"), F.max("father").alias("last"), F.count(F.lit(1)).alias("alike"))


def without_himself(pairs: DataFrame, himself: Column) -> DataFrame:
    """Pairs of a son and a row of ``alike_fathers``, the son taken out of the row that holds him (``himself``)."""
    other = F.when(himself & (F.col("father") == F.col("son")), F.col("last")).otherwise(F.col("father"))
    return pairs.withColumn("alike", F.col("alike") - F.coalesce(himself, F.lit(False)).cast("int")).withColumn("father", other).where("alike > 0")


def weighed_fathers(pairs: DataFrame, least: float = 2.0, gap: int = 6) -> DataFrame:
    """The father among candidates by what the entry shares with the son's lineage (E13): the heaviest, two or more, alone
    at the top, of the son's generation or up to six before. ``pairs(son, father, son_generation, father_generation,
    grandfather, kunya, tribe, city, patron, names_son)``, the features true or false. With a column ``alike`` a pair stands for so
    many fathers of the same features and generation (``alike_fathers``): no row is needed for each of them."""
    weight = sum((F.when(F.col(k), F.lit(w)).otherwise(0.0) for k, w in FATHER_WEIGHTS.items()), F.lit(0.0))
    apart = F.col("son_generation") - F.col("father_generation")
    rows = pairs.withColumn("_w", weight).where(F.coalesce(apart.between(0, gap), F.lit(True)))
    rows = rows.withColumn("_alike", F.col("alike") if "alike" in pairs.columns else F.lit(1))
    two = top_within(rows, ["son"], [F.desc("_w"), F.asc("father")], 2)
    best = two.groupBy("son").agg(F.max(F.when(F.col("place") == 1, F.col("father"))).alias("father"), F.max(F.when(F.col("place") == 1, F.col("_w"))).alias("weight"),
                                  F.max(F.when((F.col("place") == 2) | (F.col("_alike") > 1), F.col("_w"))).alias("_next"))
    return best.where((F.col("weight") >= least) & (F.col("_next").isNull() | (F.col("weight") > F.col("_next")))).drop("_next")


def father_pairs(results: DataFrame, cands: DataFrame, links: DataFrame, fathers: DataFrame, persons: DataFrame, rules: Rules = Rules(),
                 edges: DataFrame | None = None) -> DataFrame:
    """A son open between namesakes, followed by "his father": both decided by the one pair the chains have seen (E14):
    ``(chain_id, position, son, father)`` for the son's link."""
    edges = trusted_edges(results, rules.trust) if edges is None else edges
    asked = before_fathers(_open(results, cands), results, links)
    sons = asked.join(cands.select(*SLOT, F.col("person_id").alias("son")), SLOT).join(fathers, "son")
    return _pair_seen(sons, persons, edges, rules)


def before_fathers(asked: DataFrame, results: DataFrame, links: DataFrame) -> DataFrame:
    """The open links that E14 asks about: "his father" follows, open too; with the persons on either side of the two."""
    his = links.select(*SLOT, normalize(F.col("name")).alias("_n")).where(F.col("_n").isin(*FATHER_WORDS)).join(
        results.where(F.col("person_id").isNotNull()).select(*SLOT), SLOT, "left_anti").select("chain_id", (F.col("position") - 1).alias("position"))
    above = results.select("chain_id", (F.col("position") - 2).alias("position"), F.col("person_id").alias("teacher"))
    return asked.drop("teacher").join(his, SLOT).join(above, SLOT, "left")


def _pair_seen(sons: DataFrame, persons: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """What E14 decides. ``sons(chain_id, position, student, teacher, _open, son, father)``; where a link has more than
    ``rules.pair_few`` candidates, sons never seen may be missing."""
    g = lambda end, name: persons.select(F.col("person_id").alias(end), F.col("generation").alias(name))
    rows = (sons.join(g("father", "_gf"), "father", "left").join(g("teacher", "_gt"), "teacher", "left")
            .where(~F.coalesce(F.col("_gt") > F.col("_gf"), F.lit(False)))
            .join(edges.select(F.col("src").alias("student"), F.col("dst").alias("son"), F.col("weight").alias("_a")), ["student", "son"], "left")
            .join(edges.select(F.col("src").alias("father"), F.col("dst").alias("teacher"), F.col("weight").alias("_b")), ["father", "teacher"], "left"))
    rows = rows.withColumn("_score", F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0)))
    two = top_within(rows, SLOT, [F.desc("_score"), F.desc("son")], 2)
    best = two.groupBy(*SLOT).agg(F.max(F.when(F.col("place") == 1, F.struct("son", "father"))).alias("_x"), F.max(F.when(F.col("place") == 1, F.col("_score"))).alias("_best"),
                                  F.max(F.when(F.col("place") == 2, F.col("_score"))).alias("_second"), F.count(F.lit(1)).alias("_rows"),
                                  F.max("_open").alias("_open"), F.max(F.coalesce("student", "teacher")).alias("_near"))
    alone = (F.col("_rows") == 1) & (F.col("_open") <= rules.pair_few) & F.col("_near").isNotNull()
    second = F.coalesce("_second", F.lit(0))
    seen = (F.col("_best") >= rules.pair_least) & (F.col("_best") >= rules.lead * second) & (F.col("_best") > second)
    return best.where(alone | seen).select(*SLOT, "_x.son", "_x.father")


def drop_impossible(results: DataFrame, persons: DataFrame, rules: Rules = Rules(), rounds: int | None = None) -> DataFrame:
    """Pairs that cannot be (E15): a person who is his own teacher, a teacher four generations later or six earlier, or who
    died eighty years later. The less certain of the two is left open; on a tie the teacher, except at the first link.
    One pair of a chain at a time, until none is left (or for ``rounds``). A chain without such a pair is never looked at
    again: each round reads and writes only the chains that lost a link in the one before."""
    facts = persons.select("person_id", "generation", "death_year")
    now, settled, done = results, [], 0
    while rounds is None or done < rounds:
        done += 1
        known = now.join(facts, "person_id", "left")
        after = known.select("chain_id", (F.col("position") - 1).alias("position"), F.col("person_id").alias("_t"), F.col("confidence").alias("_ct"),
                             F.col("generation").alias("_gt"), F.col("death_year").alias("_dt"))
        pair = known.join(after, SLOT).where(F.col("person_id").isNotNull() & F.col("_t").isNotNull())
        older = F.coalesce(F.col("generation") - F.col("_gt") >= rules.before, F.lit(False))
        same = F.col("person_id") == F.col("_t")
        later = F.coalesce(F.col("_gt") - F.col("generation") >= rules.after, F.lit(False))
        died = F.coalesce(F.col("_dt") - F.col("death_year") >= rules.death_years, F.lit(False))
        cs, ct = F.coalesce("confidence", F.lit(0.0)), F.coalesce("_ct", F.lit(0.0))
        student = (cs < ct) | ((cs == ct) & (F.col("position") == 1) & ~same & ~older)
        bad = pair.where(same | older | later | died).withColumn("_drop", F.when(student, F.col("position")).otherwise(F.col("position") + 1))
        first = frozen(bad.groupBy("chain_id").agg(F.min_by("_drop", "position").alias("_drop")))
        if first.isEmpty():
            break
        settled.append(now.join(first, "chain_id", "left_anti"))
        gone = F.col("position") == F.col("_drop")
        now = frozen(now.join(first, "chain_id").select(*SLOT, *[F.when(~gone, F.col(c)).alias(c) for c in ("person_id", "confidence", "rule")], "candidates"))
    for part in settled:
        now = now.unionByName(part)
    return now


def rule_counts(results: DataFrame) -> DataFrame:
    """How many links each rule decided."""
    return results.groupBy("rule").agg(F.count(F.lit(1)).alias("links"), F.avg("confidence").alias("confidence"))


def to_match(links: DataFrame, chains: DataFrame, share: int = 50) -> DataFrame:
    """The chains to look up (E17): those with open links when they are fewer than one in fifty, else all."""
    waiting = links.where(F.col("person_id").isNull()).select("chain_id").distinct()
    return waiting if waiting.count() * share < chains.count() else chains.select("chain_id")


def link_list(entries: DataFrame, persons: DataFrame, years: int = 3, deep_years: int = 10) -> DataFrame:
    """Entries of an outside list tied to persons (E18): name and father must agree, the deeper the better; years within
    three, or within ten when name, father and grandfather agree; the one left alone at the greatest depth.
    ``entries(entry_id, name, year)``, ``persons(person_id, name, death_year)``. Blocked by the first three words and by years
    that may be near. Entries of one name and year are compared once, and so are persons: of several alike none is alone."""
    words = lambda c: without_spelling(name_tokens(c))
    head = lambda c: F.array_join(F.slice(c, 1, 3), " ")
    wide = max(1, years, deep_years)
    asked = entries.select("entry_id", "year", words(F.col("name")).alias("_e")).where((F.size("_e") >= 3) & F.col("year").isNotNull())
    left = asked.select("_e", "year").distinct().withColumn("_k", head("_e")).withColumn("_span", F.floor(F.col("year") / wide))
    right = persons.select("person_id", "death_year", words(F.col("name")).alias("_p")).where((F.size("_p") >= 3) & F.col("death_year").isNotNull()).groupBy(
        "_p", "death_year").agg(F.min("person_id").alias("person_id"), F.count(F.lit(1)).alias("_alike")).withColumn("_k", head("_p")).withColumn(
        "_span", F.explode(F.array(*[F.floor(F.col("death_year") / wide) + i for i in (-1, 0, 1)])))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("_e"), F.size("_p"))), lambda i: F.element_at(F.col("_e"), i) != F.element_at(F.col("_p"), i))
    run = F.when(F.size(same) > 0, F.try_element_at(same, F.lit(1)) - 1).otherwise(F.least(F.size("_e"), F.size("_p")))
    apart = F.abs(F.col("death_year") - F.col("year"))
    rows = left.join(right, ["_k", "_span"]).where(apart <= wide).withColumn("depth", F.floor((run + 1) / 2).cast("int"))
    # both go on with a father's name, and it is another: another man
    clash = (F.col("depth") < 3) & (F.size("_e") > run + 1) & (F.size("_p") > run + 1) & (F.try_element_at(F.col("_e"), run.cast("int")) == "بن")
    near = (apart <= years) | ((F.col("depth") >= 3) & (apart <= deep_years))
    two = top_within(rows.where(~F.coalesce(clash, F.lit(False)) & near), ["_e", "year"], [F.desc("depth"), F.asc("person_id")], 2)
    best = two.groupBy("_e", "year").agg(F.max(F.when(F.col("place") == 1, F.col("person_id"))).alias("person_id"), F.max("depth").alias("depth"),
                                         F.max(F.when((F.col("place") == 2) | (F.col("_alike") > 1), F.col("depth"))).alias("_next"))
    alone = best.where(F.col("_next").isNull() | (F.col("depth") > F.col("_next")))
    return asked.join(alone, ["_e", "year"]).select("entry_id", "person_id", "depth")


def overview(links: DataFrame, persons: DataFrame, scale: str = "scale") -> DataFrame:
    """Per scale: persons, source works, links and resolved links (E19). ``links(scale, person_id)``, ``persons(scale, work)``."""
    people = persons.groupBy(scale).agg(F.count(F.lit(1)).alias("persons"), F.countDistinct("work").alias("works"))
    counts = links.groupBy(scale).agg(F.count(F.lit(1)).alias("links"), F.count("person_id").alias("resolved"))
    return people.join(counts, scale, "full").na.fill(0)


class Alike:
    """What may be meant at the links, without a row per candidate. The marks and the order of generations treat all persons that bear
    one name, carry one collection's mark and are of one generation alike, so they are one row of ``classes(…key, generation,
    alike, person_id)`` (``person_id``: the smallest), and a link's candidates are its classes. ``key`` is the name, with the
    collection where marks count. Only ``pool(…key, person_id, generation)`` names the persons: it grows with names, not links.
    Authors that head their own chains are classes of their own."""

    def __init__(self, links: DataFrame, chains: DataFrame, persons: DataFrame, found: DataFrame, marks: DataFrame | None, rules: Rules):
        bearers = found.select("name", "person_id").distinct().join(persons.select("person_id", "generation"), "person_id")
        said = links.select(*SLOT, "name")
        self.key, pool = ["name"], bearers
        if marks is not None and "marks" in rules.on:
            self.key = ["name", "collection"]
            said = said.join(chains.select("chain_id", "collection"), "chain_id")
            pool = bearers.join(marks.select("person_id", F.col("mark").alias("collection")).distinct(), "person_id")
        self.said = said
        self.pool = frozen(pool.join(said.select(*self.key).distinct(), self.key, "left_semi").select(*self.key, "person_id", "generation"))
        own = F.when(F.col("person_id").isin(list(rules.authors.values())), F.col("person_id")) if rules.authors else F.lit(None).cast("long")
        alone = self.pool.withColumn("_own", own).groupBy(*self.key, "generation", "_own").agg(
            F.count(F.lit(1)).alias("alike"), F.min("person_id").alias("person_id")).drop("_own")
        kind = found.groupBy("name").agg(F.max("way").alias("_kind"))
        all_of = bearers.groupBy("name").agg(F.count(F.lit(1)).alias("_named"))
        here = self.pool.groupBy(*self.key).agg(F.count(F.lit(1)).alias("candidates")).join(all_of, "name").join(kind, "name")
        way = F.when((F.col("candidates") == 1) & (F.col("_named") > 1), "marks").otherwise(F.col("_kind"))
        here = here.select(*self.key, "candidates", F.col("candidates").alias("n"), way.alias("way"))
        self.classes = frozen(alone.join(here, self.key))

    def candidates(self) -> DataFrame:
        """The classes of every link."""
        return self.said.join(self.classes, self.key)

    def settled(self, cands: DataFrame, rule: str) -> DataFrame:
        """``cands`` after a rule, with the number now left at their link (``n``) and, where it has just left one of several,
        the rule as the link's ``way``."""
        rows = cands.withColumn("_n", F.sum("alike").over(W.partitionBy(*SLOT)))
        return rows.withColumn("way", F.when((F.col("_n") == 1) & (F.col("n") > 1), rule).otherwise(F.col("way"))).withColumn("n", F.col("_n")).drop("_n")

    def only(self, cands: DataFrame, hits: DataFrame, rule: str) -> DataFrame:
        """``cands`` where a link of several keeps, of the persons in ``hits(chain_id, position, person_id)``, the only one that is
        among its candidates."""
        here = cands.where("n > 1").select(*SLOT, *self.key, "generation", "candidates").distinct().join(hits.distinct(), SLOT)
        same = [F.col(f"h.{c}") == F.col(f"p.{c}") for c in [*self.key, "person_id"]] + [F.col("h.generation").eqNullSafe(F.col("p.generation"))]
        met = here.alias("h").join(self.pool.alias("p"), same, "left_semi")
        one = met.groupBy(*SLOT, *self.key).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("alike"), F.lit(rule).alias("way"), *[
            F.min(c).alias(c) for c in ("person_id", "generation", "candidates")]).where("n = 1")
        one = frozen(one.select(*cands.columns))
        return cands.join(one.select(*SLOT), SLOT, "left_anti").select(*cands.columns).unionByName(one)

    def open_sets(self, cands: DataFrame) -> DataFrame:
        """The links of several candidates: how many (``_open``), and of which generations (``_known``, ``_unknown``)."""
        return cands.where("n > 1").groupBy(*SLOT, *self.key).agg(
            F.max("n").alias("_open"), F.collect_set("generation").alias("_known"), F.max(F.col("generation").isNull()).alias("_unknown"))

    def pool_of(self, sets: DataFrame) -> DataFrame:
        """The persons meant by the keys of ``sets``: ``(…key, who, _g)``."""
        rows = self.pool.join(sets.select(*self.key).distinct(), self.key, "left_semi")
        return rows.select(*self.key, F.col("person_id").alias("who"), F.col("generation").alias("_g"))


def within_set() -> Column:
    """Whether a person's generation (``_g``) is one of those left at the link."""
    return F.when(F.col("_g").isNull(), F.col("_unknown")).otherwise(F.array_contains("_known", F.col("_g")))


def named_clients(links: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """``(chain_id, position, person_id)``: bearers of a link's name whose entry calls them the client of the next link's
    person (E6). Entries are cut at "client of"; what follows meets the next names whole, by its beginnings."""
    words = lambda c: name_tokens(F.col(c))
    nexts = links.select("name").distinct().withColumn("_w", words("name")).where(F.size("_w") > 0).select(
        F.col("name").alias("_after"), F.array_join("_w", " ").alias("_next"), F.size("_w").alias("_length"))
    lengths = nexts.select("_length").distinct()
    patron = F.filter(F.sequence(F.lit(2), F.size("_e")), lambda i: F.element_at(F.col("_e"), i) == "مولي")
    rows = entries.select("person_id", words("entry").alias("_e")).where(F.size("_e") > 1)
    rows = rows.select("person_id", "_e", F.explode(patron).alias("_at")).join(lengths, F.col("_length") <= F.size("_e") - F.col("_at"))
    said = rows.select("person_id", F.array_join(F.slice("_e", F.col("_at") + 1, F.col("_length")), " ").alias("_next")).distinct()
    whole = found.select("name", "person_id").distinct().join(said.join(nexts, "_next").select("person_id", "_after").distinct(), "person_id")
    following = links.select("chain_id", (F.col("position") - 1).alias("position"), F.col("name").alias("_after"))
    return links.select(*SLOT, "name").join(following, SLOT).join(whole, ["name", "_after"]).select(*SLOT, "person_id")


def named_bare(links: DataFrame, table: DataFrame) -> DataFrame:
    """``(chain_id, position, person_id)``: whom the neighbours of a bare name point to."""
    key = lambda c: F.array_join(looked_up(c), " ")
    said = links.select(*SLOT, key(F.col("name")).alias("name"))
    nearby = said.select("chain_id", (F.col("position") - 1).alias("position"), F.col("name").alias("beside"), F.lit("teacher").alias("side")).union(
        said.select("chain_id", F.col("position") + 1, "name", F.lit("student")))
    return said.join(table, "name").join(nearby, [*SLOT, "beside", "side"], "left_semi").select(*SLOT, "person_id").distinct()


class Evidence:
    """The evidence of all chains together, worked out on deltas.

    Chains without an open link are left alone from the start. Of the others the table ``base`` is written once; what the rules
    decide is a small table beside it. The neighbours' rounds look only at the ``frontier``: chains in which a link was decided
    since they were last looked at, and those with an open link that an edge seen since then speaks for (null: all chains).
    Edges are counted once and then grow by the pairs of newly trusted links. A link's candidates are not written out: those
    that an edge ties to its neighbours are met by neighbour and name; the others have no evidence."""

    def __init__(self, results: DataFrame, alike: Alike, cands: DataFrame, links: DataFrame, persons: DataFrame, fathers: DataFrame | None, rules: Rules):
        self.rules, self.persons, self.fathers, self.alike = rules, persons, fathers, alike
        self.sets = frozen(alike.open_sets(cands))
        self.pool = frozen(alike.pool_of(self.sets))
        waiting = frozen(results.where(F.col("person_id").isNull()).select("chain_id").distinct())
        self.whole = results.join(waiting, "chain_id", "left_anti")
        self.base = frozen(results.join(waiting, "chain_id", "left_semi"))
        self.links = frozen(links.select(*SLOT, "name").join(waiting, "chain_id", "left_semi"))
        self.kin = frozen(kin(self.links))
        self.edges = frozen(trusted_edges(results, rules.trust))
        self.decided = frozen(self.base.limit(0).select(*SLOT, "person_id", "confidence", "rule"))
        self.frontier: DataFrame | None = None
        self.spent: list[DataFrame] = []

    def open(self, results: DataFrame) -> DataFrame:
        """The open links of ``results`` that may mean several, with their neighbours."""
        return _sides(results).where(F.col("person_id").isNull()).drop("person_id", "confidence", "rule").join(self.sets, SLOT)

    def below(self, asked: DataFrame, edges: DataFrame) -> DataFrame:
        """The candidates of open links that are seen above the link's student, with how often."""
        seen = edges.select(F.col("src").alias("student"), F.col("dst").alias("who"), F.col("weight").alias("_below")).join(self.pool, "who")
        return asked.join(seen, ["student", *self.alike.key]).where(within_set())

    def above(self, asked: DataFrame, edges: DataFrame) -> DataFrame:
        """The candidates of open links that are seen below the link's teacher, with how often."""
        seen = edges.select(F.col("src").alias("who"), F.col("dst").alias("teacher"), F.col("weight").alias("_above")).join(self.pool, "who")
        return asked.join(seen, ["teacher", *self.alike.key]).where(within_set())

    def scored(self, asked: DataFrame) -> DataFrame:
        """The candidates of open links seen on either side."""
        asked = frozen(asked)
        self.spent.append(asked)  # until the decisions drawn from it are written
        columns = [*asked.columns, "who"]
        rows = self.below(asked, self.edges).select(*columns, "_below", F.lit(0).cast("long").alias("_above")).unionByName(
            self.above(asked, self.edges).select(*columns, F.lit(0).cast("long").alias("_below"), "_above"))
        keep = [F.first(c).alias(c) for c in columns if c not in (*SLOT, "who")]
        return rows.groupBy(*SLOT, "who").agg(*keep, F.sum("_below").alias("_below"), F.sum("_above").alias("_above"))

    def now(self, chains: DataFrame | None = None, decided: DataFrame | None = None) -> DataFrame:
        """The links of some chains (all with open ones) as they stand."""
        new = (self.decided if decided is None else decided).select(*SLOT, F.col("person_id").alias("_p"), F.col("confidence").alias("_c"), F.col("rule").alias("_r"))
        rows = self.base if chains is None else self.base.join(chains, "chain_id", "left_semi")
        pick = lambda a, b: F.coalesce(a, b).alias(b)
        return rows.join(new, SLOT, "left").select(*SLOT, pick("_p", "person_id"), pick("_c", "confidence"), pick("_r", "rule"), "candidates")

    def take(self, won: DataFrame) -> bool:
        """Add decisions ``(chain_id, position, person_id, confidence, rule)``; whether there were any. The chains they change
        join the frontier."""
        won = frozen(won.select(*SLOT, "person_id", "confidence", "rule"))
        changed = frozen(won.select("chain_id").distinct())
        for table in self.spent:
            removed(table)
        self.spent = []
        if changed.isEmpty():
            return False
        both = frozen(self.decided.unionByName(won))
        if not won.where(F.col("confidence") >= self.rules.trust).isEmpty():
            count = lambda decided, sign: trusted_edges(self.now(changed, decided), self.rules.trust).withColumn("weight", F.col("weight") * sign)
            new = frozen(count(both, 1).unionByName(count(self.decided, -1)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0"))
            self.edges = frozen(self.edges.unionByName(new).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), self.edges)
            asked = frozen(self.open(self.now(None, both)))
            self.spent = [asked, new]
            changed = changed.union(self.below(asked, new).select("chain_id")).union(self.above(asked, new).select("chain_id"))
        old, self.decided = self.decided, both
        if self.frontier is not None:
            self.frontier = frozen(self.frontier.union(changed).distinct())
        for table in (*self.spent, old, won):
            removed(table)
        self.spent = []
        return True

    def neighbours(self) -> None:
        """E10 until a round decides nothing, at most ``rules.rounds``."""
        for _ in range(self.rules.rounds if self.rules.use("neighbours") else 0):
            asked, self.frontier = self.frontier, self.base.select("chain_id").limit(0)
            won = _both_say(self.scored(_both_known(self.open(self.now(asked)))), self.rules)
            if not self.take(won.select(*SLOT, F.col("_who").alias("person_id"), F.lit(NEIGHBOURS).alias("confidence"), F.lit("neighbours").alias("rule"))):
                break

    def famous(self, table: DataFrame) -> bool:
        open_links = self.now().where(F.col("person_id").isNull()).select(*SLOT).join(self.links, SLOT)
        return self.take(famous(open_links, table))

    def relatives(self) -> bool:
        if self.fathers is None or "father" not in self.rules.on:
            return False
        return self.take(relatives_won(self.kin, self.now(), self.fathers, self.persons).withColumn("rule", F.lit("father")))

    def one_side(self) -> bool:
        won = _one_says(self.scored(_one_known(self.open(self.now()))), self.rules)
        return self.take(won.select(*SLOT, F.col("_who").alias("person_id"), F.lit(NEIGHBOURS).alias("confidence"), F.lit("one_side").alias("rule")))

    def sons(self) -> DataFrame:
        """The sons that E14 chooses from: of links of few candidates all, of the others those seen with a neighbour, or whose
        father is."""
        now = self.now()
        asked = frozen(before_fathers(self.open(now), now, self.links))
        few, many, columns = asked.where(F.col("_open") <= self.rules.pair_few), asked.where(F.col("_open") > self.rules.pair_few), [*SLOT, "student", "teacher", "_open"]
        named = F.array_union("_known", F.when(F.col("_unknown"), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>")))
        each = few.select(*columns, *self.alike.key, F.explode(named).alias("_g")).alias("f")
        same = [F.col(f"f.{c}") == F.col(f"p.{c}") for c in self.alike.key] + [F.col("f._g").eqNullSafe(F.col("p._g"))]
        whole = each.join(self.pool.alias("p"), same).select(*[F.col(f"f.{c}") for c in columns], F.col("p.who").alias("son")).join(self.fathers, "son")
        by_son = self.below(many, self.edges).select(*columns, F.col("who").alias("son")).join(self.fathers, "son")
        up = self.edges.select(F.col("src").alias("father"), F.col("dst").alias("teacher")).join(self.fathers, "father").join(self.pool, F.col("son") == F.col("who"))
        by_father = many.join(up, ["teacher", *self.alike.key]).where(within_set()).select(*columns, "son", "father")
        return whole.unionByName(by_son.unionByName(by_father).distinct())

    def father_pairs(self) -> bool:
        if self.fathers is None:
            return False
        won = frozen(_pair_seen(self.sons(), self.persons, self.edges, self.rules))
        pair = [F.struct("position", F.col("son").alias("person_id")), F.struct((F.col("position") + 1).alias("position"), F.col("father").alias("person_id"))]
        both = won.select("chain_id", F.explode(F.array(*pair)).alias("_l")).select("chain_id", "_l.*")
        return self.take(both.withColumn("confidence", F.lit(NEIGHBOURS)).withColumn("rule", F.lit("father_pair")))


def resolve(links: DataFrame, chains: DataFrame, persons: DataFrame, aliases: DataFrame, marks: DataFrame | None = None, rules: Rules = Rules(), *,
            entries: DataFrame | None = None, bare: DataFrame | None = None, known_names: DataFrame | None = None,
            fathers: DataFrame | None = None) -> DataFrame:
    """All links of the chains with their persons, the rules in their fixed order (E1–E16): ``(chain_id, position, person_id,
    confidence, rule, candidates)``.

    First each link by itself: names looked up (E1, E2; inside ``entries(person_id, entry)`` where nothing fits, E9), the marks of
    the collection (E3), the ends (E4), the order of generations (E5), patrons named in entries (E6), bare names by their
    neighbours (``bare``, E7). Then the chains together, on deltas: neighbours (E10), famous bearers of a name (``known_names(name,
    person_id)``, E8), relatives (``fathers(son, father)``, E12), one neighbour alone (E11), son and father together (E14), each
    followed by the neighbours again; last what cannot be (E15). A rule runs when it is in ``rules.on`` and, if it only infers,
    when ``rules.guesses``; a table that is not given leaves its rule out."""
    links = frozen(links.select(*SLOT, "name"))
    found = frozen(best_tier(name_candidates(links.select("name"), aliases)))
    if entries is not None and rules.use("elsewhere"):
        more = elsewhere(links.select("name").distinct().join(found.select("name").distinct(), "name", "left_anti"), entries)
        found = frozen(found.unionByName(more))
    alike = Alike(links, chains, persons, found, marks, rules)
    sizes = links.groupBy("chain_id").agg(F.max("position").alias("size"))
    cands = frozen(alike.settled(narrow_ends(alike.candidates(), chains, sizes, rules), "ends"))
    if "order" in rules.on:
        cands = frozen(alike.settled(monotone(cands), "order"), cands)
    if entries is not None and "client" in rules.on:
        cands = frozen(alike.only(cands, named_clients(links, entries, found), "client"), cands)
    if bare is not None and rules.use("bare"):
        cands = frozen(alike.only(cands, named_bare(links, bare), "bare"), cands)
    left = cands.groupBy(*SLOT).agg(*[F.max(c).alias(c) for c in ("n", "candidates", "way")], F.min("person_id").alias("_who"))
    one, way = F.col("n") == 1, F.col("way")
    sure = F.when(way.isin("bare", "elsewhere"), GUESS).when(F.col("candidates") == 1, SURE).otherwise(EVIDENCE)
    results = frozen(links.select(*SLOT).join(left, SLOT, "left").select(
        *SLOT, F.when(one, F.col("_who")).alias("person_id"), F.when(one, sure).alias("confidence"), F.when(one, way).alias("rule"),
        F.coalesce("candidates", F.lit(0)).alias("candidates")))
    said = Evidence(results, alike, cands, links, persons, fathers, rules)
    removed(cands)
    said.neighbours()
    if known_names is not None and rules.use("famous") and said.famous(known_names):
        said.neighbours()
    if said.relatives():
        said.neighbours()
    for rule, step in (("one_side", said.one_side), ("father_pair", said.father_pairs)):
        if rules.use(rule) and step():
            said.neighbours()
            if said.relatives():
                said.neighbours()
    results = frozen(said.whole.unionByName(said.now()), results)
    for table in (links, said.sets, said.pool, said.base, said.links, said.kin, said.edges, said.decided):
        removed(table)
    return drop_impossible(results, persons, rules) if "impossible" in rules.on else results
