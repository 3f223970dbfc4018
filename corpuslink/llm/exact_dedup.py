"""Exact dedup by content sort: sampled splitters range-partition the normalised texts, an external sort places equals next
to each other, and full comparisons of neighbours find the groups.

The range key is a bounded head of the normalised text, a hash of the whole and a salt of the identifier, so that what Spark
samples for its splitters is a hundred bytes a row whatever the texts' length, a group of copies that holds a third of all
rows is dealt over up to ``SALTS`` ranges, and equal texts of one salt always meet. Within a range the window operator sorts
(and spills) and compares whole neighbouring texts. Each (text, salt) then gives one summary row, at most ``SALTS`` a group,
and the summaries are put together by the text's SHA-256; the texts themselves are shuffled once.

Everything is DataFrame functions. Defined cases: null counts as empty; all texts without a character but white space are
one group; a null identifier comes after all others; repeated rows are rows of their own, of which one stays; an empty table
gives an empty table; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslink.llm.keys import only
from corpuslink.session import frozen

SALTS = 32
WHITE = r"[\x20\x09-\x0D]+"
HEAD = 64


def groups_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (of the group's row with the most code points, then the smallest id),
    group_size, kept, text_sha256 (of the normalised text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n"), F.regexp_replace(text, WHITE, "").alias("norm"),
                       F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"))
    rows = rows.select("id", "n", "norm", "salt", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("code"))
    ranged = rows.repartitionByRange("head", "code", "salt")
    same = Window.partitionBy("head", "code", "salt", "norm")
    best = same.orderBy(F.col("n").desc(), F.col("id").asc_nulls_last())
    placed = ranged.select("id", "n", "salt", F.sha2("norm", 256).alias("sha"), F.row_number().over(best).alias("place"))
    placed = frozen(placed)

    first = F.min(F.struct((-F.col("n")).alias("short"), F.col("id").isNull().alias("missing"), F.col("id")))
    parts = placed.groupBy("sha", "salt").agg(first.alias("best"), F.count("*").alias("size"))
    whole = Window.partitionBy("sha")  # at most one row per salt
    parts = parts.select("sha", "salt", F.min("best").over(whole).alias("best"), F.sum("size").over(whole).alias("group_size"))
    out = placed.join(parts, ["sha", "salt"])
    stays = (F.col("place") == 1) & (F.col("n") == -F.col("best.short")) & F.col("id").eqNullSafe(F.col("best.id"))
    return out.select("id", F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns. Only ids of rows that go are carried back. Where rows share an id, one
    row of each of the id's texts that stay is kept, the longest."""
    found = frozen(groups_of_copies(docs, id_col, text_col).select(F.col("id").alias(id_col), "kept", "text_sha256"))
    by_id = found.groupBy(id_col).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = frozen(by_id.where(~F.col("kept")).select(id_col))
    shared = frozen(by_id.where("kept AND n > 1").select(id_col))
    stays = only(docs, gone, id_col, "left_anti")
    if shared.isEmpty():
        return stays
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, ""), 256)
    rows = only(stays, shared, id_col, "left_semi").withColumn("_sha", sha)
    kept = found.where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_kept_sha"))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    longest = Window.partitionBy(id_col, "_sha").orderBy(F.char_length(text_col).desc(), text_col)
    once = rows.withColumn("_place", F.row_number().over(longest)).where("_place = 1")
    return only(stays, shared, id_col, "left_anti").unionByName(once.select(*docs.columns))
