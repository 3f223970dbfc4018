"""The graph of who narrates from whom, and the trees of sections and of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.plans.ordered import last_before, next_in_chain, number_within, top_within
from corpuslink.session import frozen


def pairs_of_links(links: DataFrame) -> DataFrame:
    """Each neighbouring pair of identified persons: (chain_id, position, src, dst)."""
    paired = next_in_chain(links.select("chain_id", "position", "person_id"), "chain_id", "position", ["person_id"])
    return (paired.where(F.col("person_id").isNotNull() & F.col("person_id_next").isNotNull())
            .select("chain_id", "position", F.col("person_id").alias("src"), F.col("person_id_next").alias("dst")))


def edges(links: DataFrame, self_loops: bool = True, minimum: int = 1) -> DataFrame:
    """Weighted edges (src narrates from dst) from consecutive links (G1)."""
    pairs = pairs_of_links(links)
    if not self_loops:
        pairs = pairs.where(F.col("src") != F.col("dst"))
    counted = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return counted.where(F.col("weight") >= minimum) if minimum > 1 else counted


def degrees(edges_: DataFrame) -> DataFrame:
    """Distinct teachers (out) and students (in) of every person."""
    ends = edges_.select(F.col("src").alias("person_id"), F.lit(1).alias("t"), F.lit(0).alias("s")).union(
        edges_.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("person_id").agg(F.sum("t").alias("teachers"), F.sum("s").alias("students"))


def pagerank(edges_: DataFrame, damping: float = 0.85, iterations: int = 60) -> DataFrame:
    """PageRank weighted by how often, sink mass shared evenly, a fixed number of rounds.

    The edges with their shares are frozen once and the ranks once a round (a round reads them twice, so an unfrozen
    plan would double each time). A teacher with very many students costs one combined row per task: sums are combined
    before the shuffle."""
    out = edges_.groupBy("src").agg(F.sum("weight").alias("_out"))
    shares = frozen(edges_.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")))
    nodes = frozen(shares.select(F.col("src").alias("person_id"), F.lit(0).alias("sink")).union(
        shares.select("dst", F.lit(1))).groupBy("person_id").agg(F.min("sink").alias("sink")))
    n = nodes.count()
    ranks = nodes.select("person_id", F.lit(1.0 / n).alias("score"), "sink")
    for _ in range(iterations):
        flow = (shares.join(ranks.select(F.col("person_id").alias("src"), "score"), "src")
                .groupBy(F.col("dst").alias("person_id")).agg(F.sum(F.col("score") * F.col("share")).alias("flow")))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink") == 1, F.col("score"))), F.lit(0.0)).alias("lost"))
        new = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)
        ranks = frozen(nodes.join(flow, "person_id", "left").crossJoin(lost)  # lost is one row
                       .select("person_id", new.alias("score"), "sink"), ranks)
    return ranks.select("person_id", "score")


def top_neighbours(edges_: DataFrame, persons: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The k commonest teachers and students of every person (G4); of some persons when ``persons`` is given."""
    both = edges_.select(F.col("src").alias("person_id"), F.lit("teacher").alias("part"), F.col("dst").alias("other"),
                         "weight").union(edges_.select("dst", F.lit("student"), "src", "weight"))
    if persons is not None:
        both = both.join(persons.select("person_id"), "person_id", "left_semi")
    return top_within(both, ["person_id", "part"], [F.desc("weight"), F.asc("other")], k)


def compilers_of(links: DataFrame, chains: DataFrame) -> DataFrame:
    """The collections whose chains begin with a person, and how often."""
    first = links.where((F.col("position") == 1) & F.col("person_id").isNotNull())
    return (first.join(chains.select("chain_id", "collection"), "chain_id").groupBy("person_id", "collection")
            .agg(F.count(F.lit(1)).alias("chains")))


def reports_of_persons(links: DataFrame, chains: DataFrame, reports: DataFrame) -> DataFrame:
    """(person, report) pairs with the report's place for reading order."""
    pairs = (links.where(F.col("person_id").isNotNull()).join(chains.select("chain_id", "report_id"), "chain_id")
             .select("person_id", "report_id").distinct())
    return pairs.join(reports.select("report_id", "collection", "number_sort"), "report_id")


def father_edges(people: DataFrame) -> DataFrame:
    """Son → father read from names (G6). ``people(person_id, segments, generation)``: the name's patronymic segments;
    the son's segments 2–4 (or 2–3) are the father's first ones. The deepest fitting key counts; fathers of an earlier
    generation are preferred, later ones never; the father must be the only one left.

    Fathers of one key and generation are one row with the smallest, the greatest and whether there are more than two, which is
    all that is asked of them: a son meets as many rows as there are generations, not as there are namesakes."""
    kept = people.select("person_id", "segments", "generation")
    sides = []
    for depth in (3, 2):
        key = lambda start: F.array_join(F.slice("segments", start, depth), "|")
        sons = kept.where(F.size("segments") >= depth + 1).select(
            F.col("person_id").alias("son"), F.col("generation").alias("son_generation"), key(2).alias("key"),
            F.lit(depth).alias("depth"))
        fathers = kept.where(F.size("segments") >= depth).select(
            F.col("person_id").alias("father"), F.col("generation").alias("father_generation"), key(1).alias("key")).distinct()
        alike = fathers.groupBy("key", "father_generation").agg(
            F.min("father").alias("_low"), F.max("father").alias("_high"), (F.count(F.lit(1)) > 2).alias("_more"))
        sides.append(sons.join(alike, "key").drop("key"))
    pairs = sides[0].union(sides[1])
    # the son himself is no father; where there are more than two, two are left without him
    other = lambda end, beside: F.when(F.col("_more") | (F.col(end) != F.col("son")), F.col(end)).when(F.col(beside) != F.col("son"), F.col(beside))
    pairs = pairs.select("son", "son_generation", "father_generation", "depth", other("_low", "_high").alias("_low"), other("_high", "_low").alias("_high"))
    later = F.col("father_generation") > F.col("son_generation")
    pairs = pairs.where(F.col("_low").isNotNull() & ~F.coalesce(later, F.lit(False)))
    earlier = F.coalesce(F.col("father_generation") < F.col("son_generation"), F.lit(False)).cast("int")
    ends = pairs.groupBy("son", "depth", earlier.alias("earlier")).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    best = ends.groupBy("son").agg(F.max_by(F.struct("_low", "_high"), F.struct("depth", "earlier")).alias("_best"))
    return best.where("_best._low = _best._high").select("son", F.col("_best._low").alias("father"))


def closure(tree: DataFrame, parent: str = "parent_id", node: str = "node_id") -> DataFrame:
    """(ancestor, node, depth) of a forest, each node under itself at depth 0."""
    return _below(tree, tree.select(F.col(node).alias("chosen")), parent, node).withColumnRenamed("chosen", "ancestor")


def _below(tree: DataFrame, chosen: DataFrame, parent: str = "parent_id", node: str = "node_id", up: bool = False) -> DataFrame:
    """(chosen, node, depth): everything below each chosen node (``up``: above it), itself at depth 0.

    Steps double each round, so a tree of depth d takes log2(d) joins; a node met again is not followed, and the search
    ends when a round finds nothing new (cycle-safe at any depth)."""
    hop = tree.where(F.col(parent).isNotNull()).select(F.col(parent).alias("from"), F.col(node).alias("to"), F.lit(1).alias("step"))
    hop = frozen(hop.select(F.col("to").alias("from"), F.col("from").alias("to"), "step") if up else hop)
    known = frozen(chosen.distinct().select("chosen", F.col("chosen").alias("node"), F.lit(0).alias("depth")))
    before = known.count()
    while True:
        further = known.join(hop, F.col("node") == F.col("from")).select("chosen", F.col("to").alias("node"), (F.col("depth") + F.col("step")).alias("depth"))
        known = frozen(known.union(further).groupBy("chosen", "node").agg(F.min("depth").alias("depth")), known)
        now = known.count()
        if now == before:
            return known
        before = now
        twice = hop.alias("a").join(hop.alias("b"), F.col("a.to") == F.col("b.from")).select(
            F.col("a.from").alias("from"), F.col("b.to").alias("to"), (F.col("a.step") + F.col("b.step")).alias("step"))
        hop = frozen(twice.groupBy("from", "to").agg(F.min("step").alias("step")), hop)


def reading_order(tree: DataFrame) -> DataFrame:
    """Every node with its path of (ordinal, id) from the root: sorting by the path is the depth-first reading order
    (G11). One equi-join per level from the roots down, until a level is empty."""
    place = lambda: F.concat(F.lpad(F.col("ordinal").cast("string"), 12, "0"), F.lit(":"), F.col("node_id"))
    level = tree.where(F.col("parent_id").isNull()).select("node_id", "kind", "label", place().alias("path"),
                                                           F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:
        depth += 1
        parents = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_above"))
        level = frozen(tree.join(parents, "parent_id").select(
            "node_id", "kind", "label", F.concat_ws("/", "_above", place()).alias("path"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.union(level)


def child_counts(tree: DataFrame, leaf: str) -> DataFrame:
    """Every container with its children and, of them, its leaves."""
    return tree.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("children"), F.count_if(F.col("kind") == leaf).alias("leaves"))


def leaves_under(tree: DataFrame, chosen: DataFrame, leaf: str) -> DataFrame:
    """The leaves under each chosen node (G11, Q11). ``chosen(node_id)``."""
    found = _below(tree, chosen.select(F.col("node_id").alias("chosen"))).select("chosen", F.col("node").alias("node_id"))
    return found.join(tree.where(F.col("kind") == leaf).select("node_id", "label"), "node_id")


def path_to_root(tree: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node_id, distance) from each start node up to its root (G9); a repeated node ends the path."""
    return _below(tree, start.select(F.col("node_id").alias("chosen")), up=True).select(
        F.col("chosen").alias("start"), F.col("node").alias("node_id"), F.col("depth").alias("distance"))


def family_tree(fathers: DataFrame, person: int) -> DataFrame:
    """The eldest ancestor of a person and all descendants of that ancestor, with depth (G7). Cycle-safe: a person met
    before is not followed. ``fathers(son, father)``, one father a son."""
    start = fathers.sparkSession.createDataFrame([(person,)], "chosen long")
    eldest = _below(fathers, start, "father", "son", up=True).orderBy(F.desc("depth"), "node").limit(1)
    found = _below(fathers, eldest.select(F.col("node").alias("chosen")), "father", "son").select(F.col("node").alias("person_id"), "depth")
    own = fathers.select(F.col("son").alias("person_id"), "father")
    return found.join(own, "person_id", "left").select("person_id", F.when(F.col("depth") > 0, F.col("father")).alias("father"), "depth")


def learning_tree(edges_: DataFrame, roots: DataFrame, depth: int = 3, width: int = 3) -> DataFrame:
    """From each root, the ``width`` commonest teachers of every person, ``depth`` levels down, each person once per
    tree: at the first level, under the commonest parent (G8). ``roots(person_id)``."""
    pairs = edges_.where(F.col("src") != F.col("dst"))
    level = roots.select(F.col("person_id").alias("root"), "person_id")
    out = level.select("root", F.lit(None).cast("long").alias("parent"), "person_id", F.lit(0).alias("level"),
                       F.lit(None).cast("long").alias("weight"))
    for n in range(1, depth + 1):
        met = out.select("root", F.col("person_id").alias("dst"))
        found = (level.withColumnRenamed("person_id", "src").join(pairs, "src").join(met, ["root", "dst"], "left_anti"))
        found = top_within(found, ["root", "src"], [F.desc("weight"), F.asc("dst")], width)
        once = top_within(found.drop("place"), ["root", "dst"], [F.desc("weight"), F.asc("src")], 1)
        level = frozen(once.select("root", F.col("src").alias("parent"), F.col("dst").alias("person_id"), "weight"))
        out = out.union(level.select("root", "parent", "person_id", F.lit(n).alias("level"), "weight"))
        level = level.select("root", "person_id")
    return out


def work_tree(reports: DataFrame, titles: DataFrame) -> DataFrame:
    """The tree of one level of sections over reports (G10): sections with titles first, in order, then the untitled
    section 0, then unknown; reports numbered inside their section. ``reports(report_id, collection, section,
    number_sort)``, ``titles(collection, section, title)``."""
    used = reports.select("collection", "section").distinct().join(titles, ["collection", "section"], "left")
    last = F.when(F.col("section").isNull(), 2).when((F.col("section") == 0) & F.col("title").isNull(), 1).otherwise(0)
    key = F.concat_ws("/", "collection", F.coalesce(F.col("section").cast("string"), F.lit("?")))
    containers = used.withColumn("_last", last).withColumn(
        "ordinal", F.row_number().over(W.partitionBy("collection").orderBy("_last", "section"))).select(
        F.concat(F.lit("s:"), key).alias("node_id"), F.concat(F.lit("w:"), "collection").alias("parent_id"),
        F.col("ordinal").cast("long"), F.lit("section").alias("kind"), F.coalesce("title", F.lit("")).alias("label"))
    works = reports.select("collection").distinct().select(
        F.concat(F.lit("w:"), "collection").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(1).cast("long").alias("ordinal"), F.lit("work").alias("kind"), F.col("collection").alias("label"))
    numbered = number_within(reports, ["collection", "section"], [F.col("number_sort"), F.col("report_id")], "_n")
    leaves = numbered.select(
        F.concat(F.lit("h:"), "report_id").alias("node_id"), F.concat(F.lit("s:"), key).alias("parent_id"),
        F.col("_n").cast("long").alias("ordinal"), F.lit("report").alias("kind"),
        F.col("report_id").cast("string").alias("label"))
    return works.union(containers).union(leaves)


def assign_chapters(reports: DataFrame, starts: DataFrame, key: str = "collection", at: str = "number_sort") -> DataFrame:
    """Each report with the chapter that begins last before or at it (G12): an as-of join. ``starts(collection,
    number_sort, chapter)``; reports before the first start get null."""
    rows = reports.select(*reports.columns, F.lit(None).cast("string").alias("_chapter"), F.lit(1).alias("_kind"))
    heads = starts.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(reports.schema[c].dataType).alias(c)
                            for c in reports.columns],
                          F.col("chapter").cast("string").alias("_chapter"), F.lit(0).alias("_kind"))
    both = rows.unionByName(heads)
    order = [F.col(at), F.col("_kind"), *[F.col(c) for c in reports.columns if c not in (key, at)], F.col("_chapter")]
    filled = last_before(both, [key], order, F.col("_chapter"), "chapter", inclusive=True)
    return filled.where(F.col("_kind") == 1).drop("_chapter", "_kind")


def nodes_by_prefix(tree: DataFrame, prefix: str) -> DataFrame:
    """Nodes whose label begins with a prefix, whatever its case."""
    return tree.where(F.startswith(F.lower("label"), F.lit(prefix.lower())))
