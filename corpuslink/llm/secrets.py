"""Secret scans: pattern candidates in every text, judged by who else holds the same value.

Candidates are hashed where they are found; no value is stored or shuffled. Their hashes are counted over the whole corpus by
distinct repositories and owners: a value that more than ``max_owners`` owners hold, or that more than ``max_repositories``
repositories of one owner hold, is a copied example; one that is held by fewer looks live. Three kinds are always reported: ``assign`` (a named value of eight or more characters), ``access`` (key identifiers)
and ``hex`` (32 or more hexadecimal digits). A fourth, ``opaque`` (20 or more characters of mixed case with digits), is far
too broad to report by its pattern; its spans are added only where the value looks live.

Counting goes from (value, owner, repository) to (value, owner) to value, each step combined before its shuffle, so that a
value which a third of all rows hold is a few rows per task. The counts go back to the candidates over salted keys.
Everything is DataFrame functions. Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no span; a null owner or repository counts as one of its own; ties cannot occur
(spans are ordered by start, kind and end); repeated rows each get their result, and count as one repository; a text of any length
is matched whole (a row has to fit a JVM string); an empty table gives an empty table; other columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.llm.arrays import running
from corpuslink.session import frozen

MAX_OWNERS = 1
MAX_REPOSITORIES = 3
SALTS = 8
JUDGED = "array<struct<start:bigint,rank:int,end:bigint,hash:string,owners:bigint,repositories:bigint,live:boolean>>"


@dataclass(frozen=True)
class Kind:
    """``first`` is a cheaper pattern that every match contains. ``group`` is the value, of ``least`` characters or more; a
    match with a shorter value counts as found and is then dropped."""

    name: str
    pattern: str
    group: int
    least: int
    first: str | None = None


BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    # whole runs: of a run of hexadecimal digits only the length decides, and shorter runs are not worth a match
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
)
OPAQUE = Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 0, 20)
KINDS = (*BASE, OPAQUE)
MIXED = r"(?=.*[0-9])(?=.*[a-z]).*[A-Z]"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,hash:string>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """The kind's spans in ``text``: its parts between the matches and the matches give the positions."""
    whole, value = (F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(g)) for g in (0, kind.group))
    parts = F.slice(F.split(text, kind.pattern, -1), 1, F.size(whole))
    starts = running(F.zip_with(parts, whole, lambda p, m: F.char_length(p) + F.char_length(m)))
    inner = F.zip_with(starts, parts, lambda s, p: s + F.char_length(p))
    spans = F.zip_with(inner, F.zip_with(whole, value, lambda m, v: F.struct(m.alias("m"), v.alias("v"))),
                       lambda s, x: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (s + F.char_length(x["m"])).alias("end"), x["v"].alias("value")))
    good = F.filter(spans, lambda s: F.char_length(s["value"]) >= kind.least)
    if kind is OPAQUE:
        good = F.filter(good, lambda s: s["value"].rlike(MIXED))
    hashed = F.transform(good, lambda s: F.struct(s["start"], s["rank"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    seen = text.rlike(kind.pattern)
    if kind.first is not None:
        seen = F.contains(text, F.lit(kind.first)) & seen
    return F.when(seen, hashed).otherwise(F.array().cast(SPANS))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value in ``found`` (hash, owner, repo)."""
    per_repo = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = MAX_OWNERS,
         max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``: id, base (spans of the three kinds), added (opaque spans of values that look live), judged (all
    spans with the owners and repositories of their values and the verdict), n_live and n_copied (spans of any kind of either
    verdict). ``repo_col``: what counts as a repository, the row's id if none is named."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"), text.alias("text"))
    rows = rows.select("id", "owner", "repo", F.xxhash64("id", "owner", "repo", "text").alias("key"),
                       F.concat(*(spans_of(F.col("text"), k) for k in BASE)).alias("base"), spans_of(F.col("text"), OPAQUE).alias("opaque"))
    rows = frozen(rows)

    spans = rows.where((F.size("base") > 0) | (F.size("opaque") > 0)).select("key", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s")).select("key", "owner", "repo", "s.*")
    owners = ownership(spans).select("hash", "owners", "repositories", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = spans.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(owners, ["hash", "salt"])
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    verdict = F.struct("start", "rank", "end", "hash", "owners", "repositories", live.alias("live"))
    judged = judged.groupBy("key").agg(F.sort_array(F.collect_set(verdict)).alias("judged"))  # rows that repeat add nothing
    rows = rows.join(judged, "key", "left").withColumn("judged", F.coalesce("judged", F.array().cast(JUDGED)))
    opaque = F.filter("judged", lambda s: s["live"] & (s["rank"] == KINDS.index(OPAQUE)))
    added = F.transform(opaque, lambda s: F.struct(s["start"], s["rank"], s["end"], s["hash"]))
    return rows.select("id", F.sort_array("base").alias("base"), F.sort_array(added).alias("added"), "judged",
                       F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_copied"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced; overlapping spans become one mark."""
    every = spans.select(F.col("id").alias("_id"), F.sort_array(F.concat("base", "added")).alias("_spans"))
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"] + 1).alias("at"), F.when(s["start"] + 1 >= a["at"], F.concat(a["out"], F.substr(text, a["at"].cast("int"), (s["start"] + 1 - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"]).alias("out"))
    done = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"].cast("int"))))
    out = docs.join(every, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.withColumn(text_col, F.when(F.size("_spans") > 0, done).otherwise(text)).select(*docs.columns)
