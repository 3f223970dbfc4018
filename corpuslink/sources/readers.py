"""Reading sources into the library's tables (S1–S18), and the registry of readers.

JSON documents are read as variants, so that fields are picked by path and the shape of a source is not inferred from
its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.functions.text import clean, normalize, number_key, number_text
from corpuslink.plans.ordered import last_before, number_within

# ------------------------------------------------------------------ registry
READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register_reader(name: str, reader: Callable[[SparkSession, dict], DataFrame]) -> None:
    """Make a source format known by name: ``reader(spark, options) -> DataFrame``."""
    READERS[name] = reader


def read(spark: SparkSession, name: str, options: dict) -> DataFrame:
    """Read a source by the name of its format."""
    if name not in READERS:
        raise KeyError(f"no reader named {name!r}; known: {sorted(READERS)}")
    return READERS[name](spark, options)


# ------------------------------------------------------------------ files
ORDER = ["_file", "_block", "_row"]


def with_file_order(df: DataFrame) -> DataFrame:
    """Rows of a file scan with their order in the file: the file, where its split begins, the row in the split."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))


def json_items(spark: SparkSession, paths, records: str = "") -> DataFrame:
    """The records of JSON documents as variants ``(path, place, key, item)`` (S1): a list, or the values of an object, at a
    dotted path. One document is one row until it is exploded; many records belong in many files or in JSON Lines."""
    documents = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    where = "$" + "".join(f".{part}" for part in records.split(".") if part)
    found = documents.select("path", F.try_variant_get("v", where, "variant").alias("v"))
    return spark.sql("SELECT path, pos AS place, key, value AS item FROM {found}, LATERAL variant_explode(v)", found=found)


def json_lines(spark: SparkSession, paths) -> DataFrame:
    """One record a line, as variants: a splittable scan."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("key"),
                                         F.try_parse_json("value").alias("item"))


def field(name: str, item: str = "item") -> Column:
    """A field of a variant record by dotted path, as text."""
    return F.try_variant_get(item, "$" + "".join(f".{part}" for part in name.split(".")), "string")


@dataclass(frozen=True)
class Mapping:
    """Which columns of a source hold what (S1). Columns are header names, positions ``#N`` or dotted JSON paths."""

    collection: str
    number: str
    texts: tuple[tuple[str, str], ...]
    section: str = ""
    section_titles: tuple[tuple[str, str], ...] = ()
    ratings: tuple[tuple[str, str, str, str], ...] = ()  # (rater, column, pattern with a group, word that skips)
    refs: tuple[tuple[str, str], ...] = ()
    format: str = "csv"
    header: bool = True
    separator: str = ","
    records: str = ""
    multiline: bool = False


def read_mapped(spark: SparkSession, paths, mapping: Mapping, volume: int | None = None) -> dict[str, DataFrame]:
    """A table of any shape as reports, texts, sections, ratings and references."""
    if mapping.format == "csv":
        raw = with_file_order(spark.read.option("header", mapping.header).option("sep", mapping.separator).option(
            "multiLine", mapping.multiline).option("escape", '"').csv(paths))
        pick = lambda name: F.col(f"_c{int(name[1:])}" if name.startswith("#") else f"`{name}`")
    else:
        items = json_lines(spark, paths) if mapping.format == "jsonl" else json_items(spark, paths, mapping.records)
        raw = items.select("item", F.col("path").alias("_file"), F.lit(0).alias("_block"), F.col("place").alias("_row"))
        if mapping.format == "jsonl":
            raw = raw.withColumn("_row", F.monotonically_increasing_id())
        pick = field
    number = number_text(pick(mapping.number))
    section = number_key(number_text(pick(mapping.section))).cast("int") if mapping.section else F.lit(None).cast("int")
    if volume is not None:
        number, section = F.concat(F.lit(f"{volume}:"), number), section + 1000 * volume
    columns = [pick(c).alias(f"_t{i}") for i, (_l, c) in enumerate(mapping.texts)]
    columns += [pick(c).alias(f"_s{i}") for i, (_l, c) in enumerate(mapping.section_titles)]
    columns += [pick(r[1]).alias(f"_r{i}") for i, r in enumerate(mapping.ratings)]
    columns += [pick(c).alias(f"_f{i}") for i, (_l, c) in enumerate(mapping.refs)]
    rows = raw.select(*ORDER, F.lit(mapping.collection).alias("collection"), number.alias("number"), section.alias("section"), *columns)
    rows = dedupe_number(rows.where(F.coalesce(F.length("number"), F.lit(0)) > 0), [F.col(c) for c in ORDER])
    rows = rows.withColumn("number_sort", number_key(F.col("number")))
    key = ["collection", "number"]
    long = lambda pairs, prefix, name, value: reduce(
        DataFrame.union, [rows.select(*key, F.lit(label).alias(name), clean(F.col(f"{prefix}{i}")).alias(value)) for i, (label, _c) in enumerate(pairs)])
    out = {"reports": rows.select(*key, "number_sort", "section"),
           "texts": long(mapping.texts, "_t", "language", "text").where(F.length("text") > 0)}
    if mapping.section_titles:
        titles = reduce(DataFrame.union, [rows.select("collection", "section", F.lit(lang).alias("language"), clean(F.col(f"_s{i}")).alias("title"))
                                          for i, (lang, _c) in enumerate(mapping.section_titles)])
        out["sections"] = titles.where(F.length("title") > 0).groupBy("collection", "section", "language").agg(F.min("title").alias("title"))
    if mapping.ratings:
        out["ratings"] = ratings_from(rows, [(r[0], f"_r{i}", r[2], r[3]) for i, r in enumerate(mapping.ratings)])
    if mapping.refs:
        out["refs"] = long(mapping.refs, "_f", "scheme", "reference").where(F.length("reference") > 0)
    return out


def read_volumes(spark: SparkSession, parts: list[tuple[str, int]], mapping: Mapping) -> dict[str, DataFrame]:
    """Several parts with a volume number each, as one source (S2): numbers ``volume:n``, sections volume·1000 + n."""
    read_parts = [read_mapped(spark, path, mapping, volume) for path, volume in parts]
    return {name: reduce(DataFrame.unionByName, [p[name] for p in read_parts]) for name in read_parts[0]}


def dedupe_number(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Repeated numbers kept (S3): the second of a number is ``n.2``, the third ``n.3``."""
    placed = number_within(rows, ["collection", "number"], order, "_again")
    return placed.withColumn("number", F.when(F.col("_again") > 1, F.concat_ws(".", "number", F.col("_again").cast("string"))).otherwise(
        F.col("number"))).drop("_again")


def ratings_from(rows: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Ratings read out of fields (S5): the pattern's group, fields with the skip word left out.
    ``rules``: (rater, column, pattern, skip)."""
    found = []
    for rater, column, pattern, skip in rules:
        grade = clean(F.regexp_extract(column, pattern, 1)) if pattern else clean(F.col(column))
        kept = rows if not skip else rows.where(~F.coalesce(F.contains(F.col(column), F.lit(skip)), F.lit(False)))
        found.append(kept.select("collection", "number", F.lit(rater).alias("rater"), grade.alias("grade")))
    return reduce(DataFrame.union, found).where(F.length("grade") > 0)


# ------------------------------------------------------------------ nested book and editions
def read_book(spark: SparkSession, folder: str, languages: list[str], offered: list[str]) -> dict[str, DataFrame]:
    """A book in one file of numbers, references and ratings and one file per language (S6): ``book.json`` with
    ``reports`` and ``<language>.json`` with ``texts`` and ``sections`` by number. The chosen languages that are offered,
    else the first offered."""
    chosen = [lang for lang in languages if lang in offered] or offered[:1]
    items = json_items(spark, f"{folder}/book.json", "reports").select(field("collection").alias("collection"), field("number").alias("number"),
                                                                       field("section").try_cast("int").alias("section"), "item")
    reports = items.select("collection", "number", number_key(F.col("number")).alias("number_sort"), "section")
    rated = items.select("collection", "number", F.try_variant_get("item", "$.ratings", "variant").alias("v"))
    ratings = spark.sql("SELECT collection, number, key AS rater, CAST(value AS STRING) AS grade FROM {rated}, LATERAL variant_explode(v)", rated=rated)
    texts, titles = [], []
    for lang in chosen:
        texts.append(json_items(spark, f"{folder}/{lang}.json", "texts").select(F.col("key").alias("number"), F.lit(lang).alias("language"),
                                                                               F.col("item").cast("string").alias("text")))
        titles.append(json_items(spark, f"{folder}/{lang}.json", "sections").select(F.col("key").try_cast("int").alias("section"), F.lit(lang).alias("language"),
                                                                                    F.col("item").cast("string").alias("title")))
    known = reports.select("collection", "number")
    return {"reports": reports, "ratings": ratings, "texts": reduce(DataFrame.union, texts).join(known, "number"), "sections": reduce(DataFrame.union, titles)}


def edition_index(spark: SparkSession, path: str, with_plain: bool = False) -> DataFrame:
    """The editions an index offers (S7); duplicates without diacritics are left out unless asked for."""
    books = json_items(spark, path).select(F.col("key").alias("collection"), F.try_variant_get("item", "$.collection", "variant").alias("v"))
    rows = spark.sql("SELECT collection, value AS item FROM {books}, LATERAL variant_explode(v)", books=books)
    out = rows.select("collection", field("name").alias("name"), field("language").alias("language"), field("comments").alias("comments"))
    plain = F.coalesce(F.lower("comments").contains("diacritics removed"), F.lit(False)) | F.col("name").rlike(r"^ara-.*\d$")
    return out if with_plain else out.where(~plain)


def read_editions(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Editions: an object with ``metadata`` and a list of reports (S7): texts and ratings."""
    reports = json_items(spark, paths, "hadiths")
    texts = reports.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("edition"), field("hadithnumber").alias("number"), field("text").alias("text"), "item")
    graded = texts.select("edition", "number", F.try_variant_get("item", "$.grades", "variant").alias("v"))
    ratings = spark.sql("""SELECT edition, number, variant_get(value, '$.name', 'string') AS rater, variant_get(value, '$.grade', 'string') AS grade
        FROM {graded}, LATERAL variant_explode(v)""", graded=graded)
    return texts.drop("item").where(F.length("text") > 0), ratings


# ------------------------------------------------------------------ marked-up text
ENTRY = r"^\$+\s*(\d+)\s*-?\s*(.*)"
HEAD = r"^(\|{1,3})\s*(.*)"
PAGE = r"PageV(\d+)P\d+"


def read_entries(spark: SparkSession, path: str, entry: str = ENTRY) -> DataFrame:
    """The entries of a marked-up text (S8): ``(file, number, name, text, head, volume)``. ``### $ N - heading`` opens an
    entry, ``### |`` a head; wrapped lines are joined, page marks taken out, the volume is that of the first mark.

    The file is cut at its marks by the scan itself, so a long file is read by many tasks; heads and volumes are carried
    down by an as-of lookup along the file."""
    raw = with_file_order(spark.read.option("lineSep", "\n### ").text(path))
    rows = raw.withColumn("value", F.regexp_replace("value", r"^### ", ""))
    first, rest = F.substring_index("value", "\n", 1), F.regexp_replace("value", r"^[^\n]*\n?", "")
    joined = F.regexp_replace(F.regexp_replace(rest, r"\n~~", " "), r"\n#?\s*", " ")
    rows = rows.select(*ORDER, first.alias("_first"), F.concat_ws(" ", first, joined).alias("_all"))
    heading = F.when(F.col("_first").rlike(HEAD), F.trim(F.regexp_extract("_first", HEAD, 2)))
    page = F.regexp_extract("_all", PAGE, 1)
    rows = rows.withColumn("_head", heading).withColumn("_volume", F.when(page != "", page.cast("int")))
    order = [F.col("_block"), F.col("_row")]
    rows = last_before(rows, ["_file"], order, F.col("_head"), "head", inclusive=True)
    rows = last_before(rows, ["_file"], order, F.col("_volume"), "volume", inclusive=True)
    body = F.regexp_replace(F.regexp_replace("_all", PAGE, " "), r"^\$+\s*\d+\s*-?\s*", "")
    return rows.where(F.col("_first").rlike(entry)).select(
        F.col("_file").alias("file"), F.regexp_extract("_first", entry, 1).cast("int").alias("number"),
        F.trim(F.regexp_extract("_first", entry, 2)).alias("name"), clean(body).alias("text"), F.coalesce("head", F.lit("Introduction")).alias("head"), "volume")


def long_sections(texts: DataFrame, width: int) -> DataFrame:
    """Long sections cut between paragraphs (S8): ``part`` numbers the pieces of about ``width`` characters."""
    paragraphs = texts.select("*", F.posexplode(F.split("text", r"\n\s*\n")).alias("_i", "paragraph"))
    keys = [c for c in texts.columns if c != "text"]
    so_far = F.sum(F.length("paragraph")).over(W.partitionBy(*keys).orderBy("_i").rowsBetween(W.unboundedPreceding, -1))
    return paragraphs.withColumn("part", F.floor(F.coalesce(so_far, F.lit(0)) / width).cast("int")).groupBy(*keys, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "paragraph"))), lambda p: p["paragraph"]), "\n\n").alias("text"))


# ------------------------------------------------------------------ references, upserts, removals
def resolve_refs(refs: DataFrame, reports: DataFrame, parallel: bool = False) -> tuple[DataFrame, DataFrame]:
    """A list of [collection, number] as the leaves of chapters (S9): ``book:<key>`` or, for parallels, ``par:<key>``,
    numbered in list order; and what is missing. ``refs(place, collection, number)``."""
    found = refs.join(reports.select("collection", "number", "report_id"), ["collection", "number"])
    leaves = number_within(found, ["collection"], [F.col("place")], "ordinal")
    chapter = F.concat(F.lit("par:" if parallel else "book:"), "collection")
    return leaves.select(chapter.alias("chapter"), "ordinal", "report_id", "number"), refs.join(reports, ["collection", "number"], "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """The target after a batch (S10): ``ignore`` keeps what is there, ``replace`` takes the batch's rows of equal keys."""
    batch = batch.select(*target.columns)
    if mode == "ignore":
        return target.unionByName(batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))
    if mode == "replace":
        return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)
    raise ValueError("mode must be 'ignore' or 'replace'")


def remove_source(tables: dict[str, DataFrame], source_id) -> dict[str, DataFrame]:
    """The tables without a source and what depends on it (S11), orphans cleaned up."""
    out = dict(tables)
    gone = tables["editions"].where(F.col("source_id") == source_id).select("edition_id")
    out["editions"] = tables["editions"].where(F.col("source_id") != source_id)
    out["texts"] = tables["texts"].join(gone, "edition_id", "left_anti")
    if "ratings" in tables:
        out["ratings"] = tables["ratings"].where(F.col("source_id") != source_id)
    return cleanup(out)


def cleanup(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Reports without texts, then ratings, sections and collections without reports, are dropped."""
    out = dict(tables)
    out["reports"] = tables["reports"].join(tables["texts"].select("report_id").distinct(), "report_id", "left_semi")
    if "ratings" in tables:
        out["ratings"] = tables["ratings"].join(out["reports"].select("report_id"), "report_id", "left_semi")
    used = out["reports"].select("collection").distinct()
    for name in ("sections", "collections"):
        if name in tables:
            out[name] = tables[name].join(used, "collection", "left_semi")
    return out


def manifest_diff(have: DataFrame, offered: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """What an offer changes (S12): ``new``, ``changed`` (another fingerprint) or ``languages`` (one added that is read
    elsewhere). ``have`` and ``offered``: ``(entry, fingerprint, languages)``; entries in ``removed(entry)`` are left out."""
    read = have.select(F.explode("languages").alias("l")).agg(F.collect_set("l").alias("_read"))
    mine = have.select("entry", F.col("fingerprint").alias("_f"), F.col("languages").alias("_l"))
    rows = offered.join(mine, "entry", "left").crossJoin(read)  # one row
    added = F.array_intersect(F.array_except("languages", "_l"), "_read")
    change = F.when(F.col("_f").isNull(), "new").when(F.col("_f") != F.col("fingerprint"), "changed").when(F.size(added) > 0, "languages")
    out = rows.withColumn("change", change).where(F.col("change").isNotNull()).select("entry", "change", F.when(F.col("change") == "languages", added).alias("added"))
    return out if removed is None else out.join(removed, "entry", "left_anti")


# Licences that allow reuse, and those that allow it with conditions.
FREE = ("unlicense", "cc0", "cc0-1.0", "public domain", "public-domain", "pd", "cc-by", "cc-by-4.0", "cc by", "cc by 4.0", "mit")
CONDITIONAL = ("odbl", "odbl-1.0", "cc-by-sa", "cc-by-sa-4.0", "cc by-sa", "cc-by-nc", "cc-by-nc-4.0", "cc-by-nc-sa", "cc-by-nc-sa-4.0", "cc by-nc-sa")


def license_tier(name: Column) -> Column:
    """A, B or C by the licence's name; unknown is C."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(low.isin(*FREE), "A").when(low.isin(*CONDITIONAL) | low.contains("-nc") | low.contains("-sa"), "B").otherwise("C")


def publishable(sources: DataFrame) -> DataFrame:
    """Built-in sources whose licence allows publication."""
    return sources.where((F.col("origin") == "builtin") & F.col("tier").isin("A", "B"))


def run_batch(spark: SparkSession, sources: list[tuple[str, dict]], write: Callable[[str, DataFrame], None], refresh: Callable[[], None]) -> dict[str, str]:
    """Read several sources, then refresh the derived tables once (S14); a source that fails does not stop the others:
    ``{source: "ok" | reason}``."""
    outcome = {}
    for name, options in sources:
        try:
            write(name, read(spark, options.get("format", name), options))
            outcome[name] = "ok"
        except Exception as error:  # noqa: BLE001 - whatever a source's files hold
            outcome[name] = f"{type(error).__name__}: {str(error)[:200]}"
    if any(v == "ok" for v in outcome.values()):
        refresh()
    return outcome


def read_export(flat: DataFrame) -> dict[str, DataFrame]:
    """A flat export (``text_<language>`` columns, ratings ``rater: grade; …``) back as long tables."""
    languages = [c for c in flat.columns if c.startswith("text_")]
    key = ["collection", "number"]
    texts = flat.unpivot(key, languages, "language", "text").withColumn("language", F.substring("language", 6, 100)).where(F.length("text") > 0)
    one = flat.select(*key, F.explode(F.split("ratings", r";\s*")).alias("_r")).where(F.length("_r") > 0)
    ratings = one.select(*key, F.trim(F.regexp_extract("_r", r"^(.*?):\s*", 1)).alias("rater"), F.trim(F.regexp_replace("_r", r"^.*?:\s*", "")).alias("grade"))
    return {"reports": flat.select(*key), "texts": texts, "ratings": ratings}


def read_verse_editions(spark: SparkSession, folder: str, wanted: list[str] | None = None) -> DataFrame:
    """Verse editions (a JSON list of chapters, each a list of verses, one file per edition) as one long table (S16):
    ``(chapter, verse, edition, text, norm)``."""
    chapters = json_items(spark, f"{folder}/*.json").select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("edition"), (F.col("place") + 1).alias("chapter"),
                                                            F.col("item").alias("v"))
    if wanted:
        chapters = chapters.where(F.col("edition").isin(wanted))
    verses = spark.sql("SELECT edition, chapter, pos + 1 AS verse, CAST(value AS STRING) AS text FROM {chapters}, LATERAL variant_explode(v)", chapters=chapters)
    return verses.select("chapter", "verse", "edition", "text", normalize(F.col("text")).alias("norm"))


def without_edition(verses: DataFrame, edition: str) -> DataFrame:
    """The verses without one edition."""
    return verses.where(F.col("edition") != edition)


def wanted_editions(editions: DataFrame, languages: list[str], defaults: list[str]) -> DataFrame:
    """The editions of the wanted languages, the default ones first."""
    return editions.where(F.col("language").isin(languages)).withColumn("default", F.col("edition").isin(defaults)).orderBy(F.desc("default"), "edition")


def fingerprints(spark: SparkSession, paths) -> DataFrame:
    """``(entry, fingerprint, bytes)`` of source files, the folder being the entry (S17). Each file is hashed in its own
    task; an entry's hash is of its files' hashes in name order."""
    files = spark.read.format("binaryFile").load(paths).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("entry"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha"), "length")
    listed = F.sort_array(F.collect_list(F.struct("file", "sha")))
    return files.groupBy("entry").agg(F.sha2(F.concat_ws("|", F.transform(listed, lambda x: x["sha"])), 256).alias("fingerprint"), F.sum("length").alias("bytes"))


def status(entries: DataFrame, reports: DataFrame, texts: DataFrame) -> DataFrame:
    """Each catalogue entry with what is imported of it (S18). ``entries(entry, collection)``."""
    counts = reports.groupBy("collection").agg(F.count(F.lit(1)).alias("reports"))
    languages = texts.groupBy("collection").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
    return (entries.join(counts, "collection", "left").join(languages, "collection", "left")
            .withColumn("imported", F.col("reports").isNotNull()).na.fill(0, ["reports"]).na.fill("", ["languages"]))


register_reader("entries", lambda spark, o: read_entries(spark, o["path"]))
register_reader("table", lambda spark, o: read_mapped(spark, o["path"], o["mapping"])["texts"])
register_reader("book", lambda spark, o: read_book(spark, o["folder"], o.get("languages", []), o["offered"])["texts"])
register_reader("editions", lambda spark, o: read_editions(spark, o["path"])[0])
register_reader("verses", lambda spark, o: read_verse_editions(spark, o["folder"], o.get("editions")))
