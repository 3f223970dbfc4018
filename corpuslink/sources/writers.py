"""Writing the library's tables out (K1–K8): every result is a DataFrame, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslink.functions.text import normalize
from corpuslink.operators.graph import edges


def report_records(reports: DataFrame, texts: DataFrame, ratings: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """One nested record per report (K1): texts by language, ratings, and its chains with links.
    ``chains(report_id, ordinal, position, name)``. The lists are one report's."""
    said = texts.groupBy("report_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "text")))).alias("texts"))
    given = ratings.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("rater", "grade"))).alias("ratings"))
    out = reports.join(said, "report_id", "left").join(given, "report_id", "left")
    if chains is not None:
        one = chains.groupBy("report_id", "ordinal").agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("links"))
        out = out.join(one.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "links"))).alias("chains")), "report_id", "left")
    return out


def flat_reports(reports: DataFrame, texts: DataFrame, ratings: DataFrame, languages: list[str], chains: DataFrame | None = None) -> DataFrame:
    """The flat report table (K2): a ``text_<language>`` column each, ratings ``rater: grade; …``, chains joined by ‖.
    ``chains(report_id, ordinal, text)``."""
    wide = texts.groupBy("report_id").pivot("language", languages).agg(F.min("text"))
    wide = wide.select("report_id", *[F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias(f"text_{lang}") for lang in languages])
    label = lambda r: F.concat(r["rater"].cast("string"), F.lit(": "), r["grade"].cast("string"))
    given = ratings.groupBy("report_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rater", "grade"))), label), "; ").alias("ratings"))
    out = reports.join(wide, "report_id", "left").join(given, "report_id", "left").na.fill("")
    if chains is not None:
        roads = chains.groupBy("report_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"]), " ‖ ").alias("chains"))
        out = out.join(roads, "report_id", "left").na.fill("", ["chains"])
    return out


def person_table(persons: DataFrame, links: DataFrame, text: str = "") -> DataFrame:
    """Persons with rank, generation and how often they stand in chains (K3), all or those a text names."""
    uses = links.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count(F.lit(1)).alias("in_chains"))
    chosen = persons if not text else persons.where(normalize(F.col("name")).contains(normalize(F.lit(text))))
    return chosen.join(uses, "person_id", "left").na.fill(0, ["in_chains"])


def network(links: DataFrame, persons: DataFrame, minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """The network as nodes and edges of at least a weight (K4)."""
    kept = edges(links, self_loops=False, minimum=minimum)
    used = kept.select(F.col("src").alias("person_id")).union(kept.select("dst")).distinct()
    return persons.join(used, "person_id", "left_semi"), kept


def write_tables(tables: dict[str, DataFrame], folder: str, scope: str, form: str = "json") -> None:
    """Statistics tables, one folder per table, the scope beside every row (K5)."""
    for name, df in tables.items():
        write(df.withColumn("scope", F.lit(scope)), f"{folder}/{name}", form)


def write(df: DataFrame, path: str, form: str, by: list[str] | None = None) -> None:
    """A DataFrame as json, csv, tsv or parquet, in a folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif form == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    elif form in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.parquet(path)


def select_collections(df: DataFrame, collections: DataFrame, selector: str) -> DataFrame:
    """The rows of one collection, or of ``all``, ``scale:A``, ``scale:B`` (K6)."""
    if selector == "all":
        return df
    chosen = collections.where(F.col("scale") == selector[6:]) if selector.startswith("scale:") else collections.where(F.col("collection") == selector)
    return df.join(chosen.select("collection"), "collection", "left_semi")


def write_per_collection(df: DataFrame, path: str, form: str = "json") -> None:
    """One output per collection (K6)."""
    write(df, path, form, ["collection"])


def exchange(reports: DataFrame, texts: DataFrame, ratings: DataFrame, path: str) -> None:
    """The exchange form of collections (K7): numbers with ratings, and texts, a folder per collection and language."""
    given = ratings.groupBy("report_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rater", "grade")))).alias("ratings"))
    write(reports.join(given, "report_id", "left"), f"{path}/reports", "json", ["collection"])
    keyed = texts.join(reports.select("report_id", "collection", "number"), "report_id").select("collection", "language", "number", "text")
    write(keyed, f"{path}/texts", "json", ["collection", "language"])


REFS_PER_ROW = 10_000


def reference_lists(tags: DataFrame, reports: DataFrame) -> DataFrame:
    """Tagged groups as lists of [collection, number] (K8): ``(tag, part, refs)``; a long list goes on in further parts, by a
    hash of the report, so that no list outgrows a row."""
    rows = tags.join(reports.select("report_id", "collection", "number"), "report_id")
    sizes = rows.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / REFS_PER_ROW).alias("_parts"))
    part = F.pmod(F.xxhash64("report_id"), F.col("_parts")).cast("int")
    return rows.join(sizes, "tag").groupBy("tag", part.alias("part")).agg(F.sort_array(F.collect_list(F.array("collection", "number"))).alias("refs"))
