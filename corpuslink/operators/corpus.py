"""Corpus-scale counts over chains, links and persons.

Inputs everywhere: ``chains(chain_id, report_id, collection, ordinal, reaches[, problem])``,
``links(chain_id, position, person_id)``, ``persons(person_id, name, rank, generation, death_year)`` and, where both
scales occur, ``collections(collection, scale)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.operators.graph import pairs_of_links
from corpuslink.plans.ordered import running_total, top_within
from corpuslink.scale import SCALE_A, SCALE_B, Scale, by_scale

# Bounds of the death gaps and of what is called a doubtful gap, in years.
GAP_LOW, GAP_HIGH, GAP_STEP = -60, 160, 10
DOUBTFUL_LOW, DOUBTFUL_HIGH = -60, 110


def counted(chains: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains that count and their links: a chain with a problem counts only as the first of its report, and
    carries no links."""
    if "problem" not in chains.columns:
        return chains, links
    whole = chains.where(F.col("problem").isNull()).select("chain_id")
    return (chains.where(F.col("problem").isNull() | (F.col("ordinal") == 1)),
            links.join(whole, "chain_id", "left_semi"))


def scaled_group(scale: Column, rank: Column) -> Column:
    """The rank group of a rank on the scale of its row."""
    return by_scale(scale, SCALE_A.group_of(rank), SCALE_B.group_of(rank))


def chain_profiles(chains: DataFrame, links: DataFrame, persons: DataFrame, collections: DataFrame) -> DataFrame:
    """One row per chain: scale, length, identified links, weakest rank group (null when nobody is ranked)."""
    chains, links = counted(chains, links)
    known = persons.select("person_id", "rank")
    ranked = links.join(known.withColumn("_known", F.lit(1)), "person_id", "left")
    in_b = F.col("rank").isin([r for group in SCALE_B.rank_groups for r in group])
    per_chain = ranked.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("length"), F.count("_known").alias("identified"), F.max("rank").alias("_max_a"),
        F.max(F.when(in_b, F.col("rank"))).alias("_max_b"))
    rows = chains.join(collections, "collection").join(per_chain, "chain_id", "left")
    return rows.select(
        "chain_id", "report_id", "collection", "scale", "reaches", F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("identified", F.lit(0)).alias("identified"),
        by_scale(F.col("scale"), SCALE_A.group_of(F.col("_max_a")), SCALE_B.group_of(F.col("_max_b"))).alias("weakest"))


def _full() -> Column:
    return (F.col("length") > 0) & (F.col("length") == F.col("identified"))


def overview(profiles: DataFrame, links: DataFrame, chains: DataFrame, collections: DataFrame, reports: DataFrame,
             persons: DataFrame) -> DataFrame:
    """Per scale: collections, reports, chains, links, identified, reaching, fully identified, persons (A1)."""
    counts = profiles.groupBy("scale").agg(
        F.count(F.lit(1)).alias("chains"), F.sum("length").alias("links"), F.sum("identified").alias("identified"),
        F.count_if("reaches").alias("reaching"), F.count_if(_full()).alias("full"))
    books = (reports.groupBy("collection").count().join(collections, "collection").groupBy("scale")
             .agg(F.count(F.lit(1)).alias("collections"), F.sum("count").alias("reports")))
    people = (links.join(persons.select("person_id"), "person_id", "left_semi")
              .join(chains.select("chain_id", "collection"), "chain_id").select("collection", "person_id").distinct()
              .join(collections, "collection").groupBy("scale").agg(F.countDistinct("person_id").alias("persons")))
    return counts.join(books, "scale").join(people, "scale", "left")


def median_length(profiles: DataFrame, by: list[str]) -> DataFrame:
    """The element n//2 of the sorted chain lengths above 0, read from the histogram of lengths."""
    histogram = profiles.where(F.col("length") > 0).groupBy(*by, "length").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(histogram, by, [F.col("length")], F.col("_n"), "_upto", hot=False)
    total = histogram.groupBy(*by).agg(F.sum("_n").alias("_total"))
    reached = F.when(F.col("_upto") > F.expr("_total div 2"), F.col("length"))
    return placed.join(total, by).groupBy(*by).agg(F.min(reached).alias("median_length"))


def per_collection(profiles: DataFrame, links: DataFrame, chains: DataFrame, persons: DataFrame,
                   collections: DataFrame) -> DataFrame:
    """Per collection: chains, links, identified share, reaching share, median length, links per rank group, distinct
    persons (A2)."""
    counts = profiles.groupBy("collection", "scale").agg(
        F.count(F.lit(1)).alias("chains"), F.sum("length").alias("links"),
        F.sum("identified").alias("_identified"), F.count_if("reaches").alias("_reaching"))
    used = (links.join(chains.select("chain_id", "collection"), "chain_id").groupBy("collection", "person_id")
            .agg(F.count(F.lit(1)).alias("_n")).join(persons.select("person_id", "rank"), "person_id")
            .join(collections, "collection").withColumn("_g", scaled_group(F.col("scale"), F.col("rank"))))
    groups = used.groupBy("collection").agg(
        F.count(F.lit(1)).alias("persons"),
        *[F.sum(F.when(F.col("_g") == g, F.col("_n")).otherwise(0)).alias(f"group_{g}") for g in range(SCALE_A.groups)])
    out = counts.join(groups, "collection", "left").join(median_length(profiles, ["collection"]), "collection", "left")
    return (out.withColumn("identified_share", F.coalesce(F.try_divide("_identified", "links"), F.lit(0.0)))
            .withColumn("reaching_share", F.col("_reaching") / F.col("chains")).drop("_identified", "_reaching"))


def length_histogram(profiles: DataFrame) -> DataFrame:
    """Chains by length, unsplit ones as 0 (A3)."""
    return profiles.groupBy("scale", "length").agg(F.count(F.lit(1)).alias("chains"))


def weakest_links(profiles: DataFrame) -> DataFrame:
    """Per rank group: chains whose weakest identified person is of it, those fully identified, and reports whose best
    chain is of it (A4)."""
    ranked = profiles.where(F.col("weakest").isNotNull())
    chains = ranked.groupBy("scale", "weakest").agg(
        F.count(F.lit(1)).alias("chains"), F.count_if(_full()).alias("full_chains"))
    best = (ranked.groupBy("scale", "report_id").agg(F.min("weakest").alias("weakest"))
            .groupBy("scale", "weakest").agg(F.count(F.lit(1)).alias("reports")))
    return chains.join(best, ["scale", "weakest"], "full").na.fill(0, ["chains", "full_chains", "reports"])


def use_counts(links: DataFrame, persons: DataFrame) -> DataFrame:
    """Links per known person. Counted before the person table is joined, so a hot person is one row."""
    used = links.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count(F.lit(1)).alias("links"))
    return used.join(persons, "person_id")


def rank_distribution(links: DataFrame, persons: DataFrame, scale: Scale = SCALE_A) -> DataFrame:
    """Per rank group (-1 = unranked): all persons, persons in chains, links (A5)."""
    group = F.coalesce(scale.group_of(F.col("rank")), F.lit(-1)).alias("rank_group")
    everyone = persons.groupBy(group).agg(F.count(F.lit(1)).alias("persons"))
    used = use_counts(links, persons).groupBy(group).agg(
        F.count(F.lit(1)).alias("persons_in_chains"), F.sum("links").alias("links"))
    return everyone.join(used, "rank_group", "left").na.fill(0, ["persons_in_chains", "links"])


def generation_ranks(links: DataFrame, persons: DataFrame, scale: Scale = SCALE_A) -> DataFrame:
    """Persons in chains by generation and rank group, one column per group."""
    rows = use_counts(links, persons).where(F.col("generation").between(1, 12))
    group = scale.group_of(F.col("rank"))
    return rows.where(group.isNotNull()).groupBy("generation").agg(
        *[F.count_if(group == g).alias(f"group_{g}") for g in range(scale.groups)])


def person_counts(links: DataFrame, chains: DataFrame, persons: DataFrame) -> DataFrame:
    """Per known person: links and distinct reports."""
    per_report = (links.where(F.col("person_id").isNotNull()).join(chains.select("chain_id", "report_id"), "chain_id")
                  .groupBy("person_id", "report_id").agg(F.count(F.lit(1)).alias("_n")))
    return (per_report.groupBy("person_id").agg(F.sum("_n").alias("links"), F.count(F.lit(1)).alias("reports"))
            .join(persons, "person_id"))


def pillars(counts: DataFrame, k: int = 25, weak_from: int | None = None) -> DataFrame:
    """The k persons most links pass through; with ``weak_from`` only those of that rank or weaker."""
    rows = counts if weak_from is None else counts.where(F.col("rank") >= weak_from)
    return rows.orderBy(F.desc("links"), "person_id").limit(k)


def concentration_steps(counts: DataFrame, value: str) -> DataFrame:
    """The Lorenz order in steps of equal value: one row per distinct count, with people and sum below and above."""
    steps = (counts.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v"))
             .agg(F.count(F.lit(1)).alias("m")).withColumn("s", F.col("v") * F.col("m")))
    steps = running_total(steps, [], [F.col("v")], F.col("m"), "people_upto")
    steps = running_total(steps, [], [F.col("v")], F.col("s"), "sum_upto", hot=False)
    whole = counts.agg(F.count(value).alias("n"), F.sum(F.col(value).cast("long")).alias("total"))
    return (steps.crossJoin(whole)  # one row
            .withColumn("people_below", F.col("people_upto") - F.col("m"))
            .withColumn("sum_below", F.col("sum_upto") - F.col("s"))
            .withColumn("people_above", F.col("n") - F.col("people_upto"))
            .withColumn("sum_above", F.col("total") - F.col("sum_upto")))


def concentration(counts: DataFrame, value: str = "links") -> DataFrame:
    """Gini, the shares of the top 1% and 10%, how many carry half, and how many there are."""
    steps = concentration_steps(counts, value)
    cumulated = F.col("m") * F.col("sum_below") + F.col("v") * F.col("m") * (F.col("m") + 1) / 2

    def top(share: float) -> Column:
        k = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n")).cast("long"))
        taken = F.greatest(F.lit(0), F.least(F.col("m"), k - F.col("people_above")))
        return F.sum(taken * F.col("v"))

    half = F.col("total") / 2
    reached = F.when(F.col("sum_above") + F.col("s") >= half, F.col("people_above") + F.greatest(
        F.lit(1), F.ceil((half - F.col("sum_above")) / F.col("v"))))
    out = steps.agg(F.first("n").alias("people"), F.first("total").alias("total"), F.sum(cumulated).alias("_c"),
                    top(0.01).alias("_t1"), top(0.10).alias("_t10"), F.min(reached).cast("long").alias("half_by"))
    return out.select(
        "people", "half_by", (1 - 2 * F.col("_c") / F.col("total") / F.col("people") + 1 / F.col("people")).alias("gini"),
        (F.col("_t1") / F.col("total")).alias("top1"), (F.col("_t10") / F.col("total")).alias("top10"))


def lorenz_curve(counts: DataFrame, value: str = "links", points: int = 40) -> DataFrame:
    """The Lorenz curve read at ``points`` places."""
    steps = concentration_steps(counts, value)
    place = lambda k: F.greatest(F.lit(1), F.bround(k * F.col("n") / points).cast("long"))
    inside = F.filter(F.sequence(F.lit(1), F.lit(points)),
                      lambda k: (place(k) > F.col("people_below")) & (place(k) <= F.col("people_upto")))
    rows = steps.withColumn("point", F.explode(inside)).withColumn("_p", place(F.col("point")))
    return rows.select("point", (F.col("_p") / F.col("n")).alias("people_share"),
                       ((F.col("sum_below") + (F.col("_p") - F.col("people_below")) * F.col("v")) / F.col("total"))
                       .alias("sum_share"))


def pair_facts(links: DataFrame, persons: DataFrame) -> DataFrame:
    """Distinct (src, dst) of neighbouring known persons with how often, the death gap and both generations. Counted
    before the persons are joined."""
    pairs = pairs_of_links(links).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    side = lambda end: persons.select(F.col("person_id").alias(end), F.col("death_year").alias(f"{end}_death"),
                                      F.col("generation").alias(f"{end}_generation"))
    return (pairs.join(side("src"), "src").join(side("dst"), "dst")
            .withColumn("gap", F.col("src_death") - F.col("dst_death")))


def death_gaps(facts: DataFrame) -> DataFrame:
    """Neighbouring pairs by years between the two deaths, clamped, in tens."""
    clamped = F.least(F.lit(GAP_HIGH), F.greatest(F.lit(GAP_LOW), F.col("gap")))
    bins = (F.floor(clamped / GAP_STEP) * GAP_STEP).cast("int")
    return facts.where(F.col("gap").isNotNull()).groupBy(bins.alias("gap")).agg(F.sum("times").alias("pairs"))


def gap_suspects(facts: DataFrame, k: int = 15) -> DataFrame:
    """The pairs too far apart in time, most frequent first."""
    far = (F.col("gap") > DOUBTFUL_HIGH) | (F.col("gap") < DOUBTFUL_LOW)
    return facts.where(far).select("src", "dst", "gap", "times").orderBy(F.desc("times"), "src", "dst").limit(k)


def generation_order(facts: DataFrame) -> DataFrame:
    """Neighbouring pairs in and out of the order of generations (A10)."""
    both = facts.where(F.col("src_generation").isNotNull() & F.col("dst_generation").isNotNull())
    bad = F.col("src_generation") < F.col("dst_generation")
    return both.agg(F.coalesce(F.sum(F.when(~bad, F.col("times"))), F.lit(0)).alias("in_order"),
                    F.coalesce(F.sum(F.when(bad, F.col("times"))), F.lit(0)).alias("out_of_order"))


def order_suspects(facts: DataFrame, k: int = 15) -> DataFrame:
    """The pairs whose student is of an earlier generation than the teacher (A10)."""
    return (facts.where(F.col("src_generation") < F.col("dst_generation")).select("src", "dst", "times")
            .orderBy(F.desc("times"), "src", "dst").limit(k))


def rating_cells(ratings: DataFrame, profiles: DataFrame, by: str = "weakest") -> DataFrame:
    """Per (collection, rater): how many rated reports fall in each cell of (weakest group | length capped at 9) ×
    grade place, strongest first (A11). ``ratings(report_id, rater, grade)``."""
    if by == "weakest":
        rows = (profiles.where(F.col("weakest").isNotNull()).groupBy("report_id", "collection", "scale")
                .agg(F.min("weakest").alias("row")))
    else:
        first = profiles.where(F.col("length") > 0).groupBy("report_id", "collection", "scale")
        rows = first.agg((F.least(F.min_by("length", "chain_id"), F.lit(9)) - 1).cast("int").alias("row"))
    place = by_scale(F.col("scale"), SCALE_A.grade_index(F.col("grade")), SCALE_B.grade_index(F.col("grade")))
    joined = ratings.join(rows, "report_id").withColumn("col", place).where(F.col("col").isNotNull())
    return joined.groupBy("collection", "rater", "row", "col").agg(F.count(F.lit(1)).alias("n"))


def rating_distribution(ratings: DataFrame, reports: DataFrame, grades: int = 5) -> DataFrame:
    """Ratings per (collection, rater), one column per grade."""
    rows = ratings.join(reports.select("report_id", "collection"), "report_id")
    return rows.groupBy("collection", "rater").agg(
        F.count(F.lit(1)).alias("rated"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in range(grades)])


def shared_persons(links: DataFrame, chains: DataFrame) -> DataFrame:
    """Jaccard share of persons between every two collections (A14). Pairs of collections are counted from each
    person's list of collections, which is as long as there are collections."""
    pairs = (links.where(F.col("person_id").isNotNull()).join(chains.select("chain_id", "collection"), "chain_id")
             .select("collection", "person_id").distinct())
    sizes = pairs.groupBy("collection").agg(F.count(F.lit(1)).alias("size"))
    held = pairs.groupBy("person_id").agg(F.collect_list("collection").alias("_all"))
    both = (held.withColumn("a", F.explode("_all")).withColumn("b", F.explode("_all")).groupBy("a", "b")
            .agg(F.count(F.lit(1)).alias("shared")))
    every = (sizes.select(F.col("collection").alias("a"), F.col("size").alias("_sa"))
             .crossJoin(sizes.select(F.col("collection").alias("b"), F.col("size").alias("_sb"))))  # collections only
    out = every.join(both, ["a", "b"], "left").na.fill(0, ["shared"])
    return out.select("a", "b", "shared", F.coalesce(
        F.try_divide("shared", F.col("_sa") + F.col("_sb") - F.col("shared")), F.lit(0.0)).alias("jaccard"))


def compiler_profile(links: DataFrame, chains: DataFrame, persons: DataFrame, k: int = 12) -> DataFrame:
    """Per collection the k commonest first-link persons and the k commonest origin persons (last link, generation 1)
    (A15)."""
    placed = links.join(chains.select("chain_id", "collection"), "chain_id")
    first = (placed.where((F.col("position") == 1) & F.col("person_id").isNotNull()).groupBy("collection", "person_id")
             .agg(F.count(F.lit(1)).alias("links")).withColumn("part", F.lit("first")))
    origins = persons.where(F.col("generation") == 1).select("person_id")
    end = (placed.groupBy("collection", "chain_id").agg(F.max_by("person_id", "position").alias("person_id"))
           .where(F.col("person_id").isNotNull()).groupBy("collection", "person_id")
           .agg(F.count(F.lit(1)).alias("links")).join(origins, "person_id", "left_semi")
           .withColumn("part", F.lit("origin")).select("collection", "person_id", "links", "part"))
    return top_within(first.union(end), ["collection", "part"], [F.desc("links"), F.asc("person_id")], k)


def ends_distribution(chains: DataFrame, end: str = "ends_with") -> DataFrame:
    """Chains of a collection by where they end."""
    return chains.groupBy("collection", end).agg(F.count(F.lit(1)).alias("chains"))


def corpus_in_numbers(profiles: DataFrame, reports: DataFrame, collections: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per scale: collections, reports, chains, links, identified, median length, rated reports."""
    counts = profiles.groupBy("scale").agg(
        F.countDistinct("collection").alias("collections"), F.count(F.lit(1)).alias("chains"),
        F.sum("length").alias("links"), F.sum("identified").alias("identified"))
    rated = (reports.join(ratings.select("report_id").distinct(), "report_id").join(collections, "collection")
             .groupBy("scale").agg(F.count(F.lit(1)).alias("rated_reports")))
    books = reports.join(collections, "collection").groupBy("scale").agg(F.count(F.lit(1)).alias("reports"))
    return (counts.join(books, "scale").join(median_length(profiles, ["scale"]), "scale", "left")
            .join(rated, "scale", "left").na.fill(0, ["rated_reports"]))


def listed_generations(listed: DataFrame, persons: DataFrame, uses: DataFrame) -> DataFrame:
    """A list of persons by its own generations: how many, dated, quartile years, links.
    ``listed(key, generation, year)``; ``uses(person_id, links)``; the list's year comes first, else the person's."""
    joined = (listed.join(persons.select(F.col("person_id").alias("key"), "death_year"), "key", "left")
              .join(uses.select(F.col("person_id").alias("key"), "links"), "key", "left")
              .withColumn("year", F.coalesce("year", "death_year")))
    counts = joined.groupBy("generation").agg(F.count(F.lit(1)).alias("persons"), F.count("year").alias("dated"),
                                              F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    years = joined.where(F.col("year").isNotNull()).groupBy("generation", "year").agg(F.count(F.lit(1)).alias("_m"))
    placed = running_total(years, ["generation"], [F.col("year")], F.col("_m"), "_upto", hot=False).join(
        counts.select("generation", F.col("dated").alias("_n")), "generation")

    def at(share: float) -> Column:
        index = F.least(F.col("_n") - 1, F.floor(F.lit(share) * F.col("_n")))
        return F.min(F.when(F.col("_upto") > index, F.col("year")))

    quartiles = placed.groupBy("generation").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    return counts.join(quartiles, "generation", "left")


def by_century(persons: DataFrame) -> DataFrame:
    """Dated persons by century of death."""
    century = (F.floor((F.col("death_year") - 1) / 100) + 1).cast("int")
    return persons.where(F.col("death_year").isNotNull()).groupBy(century.alias("century")).agg(
        F.count(F.lit(1)).alias("persons"))


def group_members(members: DataFrame, links: DataFrame, chains: DataFrame) -> DataFrame:
    """Links and distinct reports of each member of a group, members without links included.
    ``members(person_id)``."""
    chosen = links.join(members, "person_id", "left_semi").join(chains.select("chain_id", "report_id"), "chain_id")
    counts = (chosen.groupBy("person_id", "report_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("person_id")
              .agg(F.sum("_n").alias("links"), F.count(F.lit(1)).alias("reports")))
    return members.join(counts, "person_id", "left").na.fill(0, ["links", "reports"])


def totals(texts: DataFrame) -> DataFrame:
    """Reports and texts per collection and language, with subtotals and the grand total."""
    return texts.rollup("collection", "language").agg(
        F.countDistinct("report_id").alias("reports"), F.count(F.lit(1)).alias("texts"))


def collections_with_raters(ratings: DataFrame, reports: DataFrame, least: int = 20) -> DataFrame:
    """Collections by how many raters rated them ``least`` times or more."""
    enough = (ratings.join(reports.select("report_id", "collection"), "report_id").groupBy("collection", "rater").count()
              .where(F.col("count") >= least))
    return enough.groupBy("collection").agg(F.count(F.lit(1)).alias("raters"))


def critic_profile(verdicts: DataFrame) -> DataFrame:
    """Verdicts of each critic by rank and creed (A17). ``verdicts(critic, rank, creed)``."""
    return verdicts.groupBy("critic", "rank", "creed").agg(F.count(F.lit(1)).alias("verdicts"))


def rank_by_teachers(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Distinct teachers and students of every person in the graph (A23 totals)."""
    teachers = edges.groupBy(F.col("src").alias("person_id")).agg(F.count(F.lit(1)).alias("teachers"))
    students = edges.groupBy(F.col("dst").alias("person_id")).agg(F.count(F.lit(1)).alias("students"))
    return teachers.join(students, "person_id", "full").na.fill(0).join(persons, "person_id")


def person_card(counts: DataFrame, degrees: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One line of facts per person: first verdict, totals, distinct teachers and students.
    ``verdicts(person_id, verdict_id, phrase)``."""
    first = verdicts.groupBy("person_id").agg(F.min_by("phrase", "verdict_id").alias("first_verdict"))
    return (counts.select("person_id", "name", "links", "reports")
            .join(degrees.select("person_id", "teachers", "students"), "person_id", "left")
            .join(first, "person_id", "left").na.fill(0, ["teachers", "students"]))


def fingerprint(sources: dict[str, tuple[DataFrame, str]], scope: str, method: str) -> DataFrame:
    """One row naming the state of the inputs: count, greatest key and sum of keys of each, with the scope and the
    method (A24). Equal fingerprints mean a stored result may be used again."""
    rows = None
    for name, (df, key) in sorted(sources.items()):
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(key).cast("long")).alias("top"),
                     F.sum(F.col(key).cast("long")).alias("total")).select(F.lit(name).alias("input"), "rows", "top", "total")
        rows = row if rows is None else rows.union(row)
    text = F.concat_ws("|", "input", F.col("rows").cast("string"), F.coalesce(F.col("top"), F.lit(0)).cast("string"),
                       F.coalesce(F.col("total"), F.lit(0)).cast("string"))
    joined = F.concat_ws(";", F.sort_array(F.collect_list(text)))  # one string per input table
    return rows.agg(F.concat_ws("#", F.lit(method), F.lit(scope), joined).alias("state")).withColumn(
        "fingerprint", F.sha2("state", 256))


def roles_present(people: DataFrame, compiled: DataFrame, rated: DataFrame, judged: DataFrame) -> DataFrame:
    """Which of ``people(person_id)`` have a collection, ratings or verdicts in the data."""
    out = people
    for name, source in (("has_collection", compiled), ("has_ratings", rated), ("has_verdicts", judged)):
        there = source.select("person_id").distinct().withColumn(name, F.lit(True))
        out = out.join(there, "person_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def alias_owners(aliases: DataFrame, uses: DataFrame, least: int = 10, lead: int = 2) -> DataFrame:
    """To whom a shared alias belongs: its only holder, else the one used at least ``least`` times and ``lead`` times
    as often as the next, else nobody (A26). ``aliases(alias, person_id)``, ``uses(person_id, links)``."""
    held = (aliases.distinct().join(uses.select("person_id", "links"), "person_id", "left")
            .withColumn("links", F.coalesce("links", F.lit(0))))
    holders = held.groupBy("alias").agg(F.count(F.lit(1)).alias("holders"))
    two = top_within(held, ["alias"], [F.desc("links"), F.asc("person_id")], 2)
    best = two.groupBy("alias").agg(
        F.max(F.when(F.col("place") == 1, F.col("person_id"))).alias("person_id"),
        F.max(F.when(F.col("place") == 1, F.col("links"))).alias("links"),
        F.max(F.when(F.col("place") == 2, F.col("links"))).alias("_next"))
    owned = (F.col("holders") == 1) | ((F.col("links") >= least) & (F.col("links") >= lead * F.col("_next")))
    return best.join(holders, "alias").where(owned).select("alias", "person_id", "links", "holders")
