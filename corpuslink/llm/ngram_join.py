"""N-gram Jaccard join: a grouped prefix join over word shingles, and the classes its links make.

Two texts link when the Jaccard similarity of their sets of shingles reaches ``percent``. All sets are ordered by one rule, and
of linked sets the heads (as long as the threshold asks) share a shingle. The order is by hash, with shingles that many texts
hold last, so that shared passages hardly come into a head; which shingles those are is counted over all texts, and only ever
changes the speed: any one order is exact.

Texts with equal sets are one variant, and variants with an equal head and size are one group: only groups are posted under
their heads' shingles. Candidates are found in two rounds. First every group of a shingle meets that shingle's first group
alone, its members are expanded and verified, and the links are put together to classes; a class of near copies of any size
costs one candidate a member and shingle. Then, for shingles that still join different classes, all pairs of variants of
different classes are verified as well that pass the size, position and parity filters. Pairs within a class cannot change
the classes, so none that matters is left out; there is no cap. Verification counts the shared shingles of the two texts.

The parity filter compares bit fields in which every shingle of a set turns one bit: two fields differ in at most as many
bits as the sets differ in shingles, so a pair whose fields differ in more than linked sets may can be left out safely. Lists
carry a field of ``BITS`` bits; before texts are compared, pairs of large sets are held against wider fields, of at least a bit
for each shingle (fields of two widths are compared by folding the wider one).

Defined cases: a null text, and one without words, has an empty set and links with nothing; a text shorter than a shingle is
one shingle; repeated rows are texts of their own with equal sets; a null id is never the smallest unless all are null; an
empty table gives an empty table; other columns are not read. A text's row is known by a 64-bit hash of id and text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslink.llm.components import components
from corpuslink.llm.keys import BROADCAST_KEYS, only
from corpuslink.llm.memory import tidy
from corpuslink.llm.words import NOT_WHITE, U64, Words, mixed, signed, words_of
from corpuslink.session import frozen, removed

WORDS, PERCENT = 5, 80
CROWDED = 200_000
CHUNK, OFTEN = 1_000_000, 4
BITS = 2048


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    codes = words.windows(size)
    short: dict[int, np.ndarray] = {}
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(codes[a:b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            width = b - a
            if width not in short:
                short[width] = words.windows(width)
            out.append(short[width][a:a + 1])
        else:
            out.append(np.zeros(0, U64))
    return out


def crowded(texts: DataFrame, size: int, most: int = CROWDED) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts hold, sorted, and their rank (0: the rarest of them). Each task counts some millions of
    shingles at a time and hands on those that several of its texts hold; at most ``most`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        held = 0

        def summary() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U64), np.zeros(0, np.int64))
            often = counts >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(signed(codes[often])), pa.array(counts[often].astype(np.int64))], ["code", "n"])

        for batch in batches:
            for _, _, words in words_of(batch.column(0), NOT_WHITE, True):
                sets += shingle_sets(words, size)
                held += len(words)
                if held >= CHUNK:
                    yield summary()
                    sets, held = [], 0
        yield summary()

    found = texts.select("text").mapInArrow(tidy(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "code").limit(most).toPandas()
    codes = rows["code"].to_numpy(np.int64, copy=True).view(U64)
    order = np.argsort(codes)
    return codes[order], np.arange(len(codes) - 1, -1, -1)[order]


def parity(own: np.ndarray, width: int) -> np.ndarray:
    """A field of ``width`` bits in which every shingle turns the bit of its low bits."""
    odd = np.bincount((own & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def heads(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, id, n, one, two, head, bits, wide): every text's set by its size, a 128-bit sum and its parity fields (``wide`` is empty
    for sets of at most BITS shingles), and the head of the ordered set."""
    shared = texts.sparkSession.sparkContext.broadcast(crowded(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = shared.value
        for batch in batches:
            n, one, two, head, bits, wide = [], [], [], [], [], []
            for _, _, words in words_of(batch.column(2), NOT_WHITE, True):
                for own in shingle_sets(words, size):
                    n.append(len(own))
                    bits.append(parity(own, BITS))
                    wide.append(parity(own, 1 << (len(own) - 1).bit_length()) if len(own) > BITS else [])
                    with np.errstate(over="ignore"):
                        one.append(int(signed(mixed(own).sum(keepdims=True, dtype=U64))[0]))
                        two.append(int(signed(mixed(own ^ U64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=U64))[0]))
                    need = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                    if len(last) and len(own):
                        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
                        late = last[at] == own
                        rare = own[~late]
                        if len(rare) < need:
                            rare = np.concatenate((rare, own[late][np.argsort(rank[at[late]], kind="stable")]))
                        head.append(signed(rare[:need]))
                    else:
                        head.append(signed(own[:need]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                              pa.array(head, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))],
                                             ["row", "id", "n", "one", "two", "head", "bits", "wide"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("row", "id", "text").mapInArrow(tidy(run), f"row bigint, id {kind}, n int, one bigint, two bigint, head array<bigint>, bits array<bigint>, wide array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts reach the threshold, written. ``reps``: one row of ``texts`` for each variant."""
    own = lambda side: reps.select(F.col("variant").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}"))
    pairs = pairs.join(own("a"), "a").join(own("b"), "b").where(_differ_little("wide_a", "wide_b", "n_a", "n_b", percent))
    pairs = frozen(pairs.select("a", "b"))
    sides = pairs.select(F.explode(F.array("a", "b")).alias("variant")).distinct()
    wanted = frozen(sides.join(reps, "variant").select("variant", "row"))
    n = wanted.count()
    named = frozen(texts.join(F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted, "row").select("variant", "text"))
    if named.count() > n:  # rows that stand in the table more than once
        named = frozen(named.dropDuplicates(["variant"]), named)
    both = pairs.join(named.select(F.col("variant").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(named.select(F.col("variant").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for side in (2, 3):
                own: list[np.ndarray] = []
                for _, _, words in words_of(batch.column(side), NOT_WHITE, True):
                    own += shingle_sets(words, size)
                sets.append(own)
            linked = []
            for x, y in zip(*sets, strict=True):
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    done = frozen(both.mapInArrow(tidy(run), "a bigint, b bigint"))
    for table in (pairs, wanted, named):
        removed(table)
    return done


def _may_link(n: str, m: str, i: str, j: str, percent: int) -> str:
    """Size and position filter for a common shingle at places i and j (from 0) of two ordered sets of n and m."""
    return (f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND "
            f"{100 + percent} * (1 + least({n} - {i} - 1, {m} - {j} - 1)) >= {percent} * ({n} + {m})")


def _differ_little(x: str, y: str, n: str, m: str, percent: int) -> str:
    """Parity filter, by fields of the same or of twice the width: sets of n and m that link differ in at most (100 - percent) / (100 + percent) of n + m shingles."""
    halves = lambda f: f"zip_with(slice({f}, 1, size({f}) div 2), slice({f}, size({f}) div 2 + 1, size({f}) div 2), (a, b) -> a ^ b)"
    distance = lambda f, g: f"aggregate(zip_with({f}, {g}, (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b)"
    apart = (f"CASE WHEN size({x}) = size({y}) THEN {distance(x, y)} WHEN size({x}) = 2 * size({y}) THEN {distance(halves(x), y)} "
             f"WHEN size({y}) = 2 * size({x}) THEN {distance(x, halves(y))} ELSE 0 END")
    return f"{100 + percent} * {apart} <= {100 - percent} * ({n} + {m})"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("row", F.xxhash64("id", "text"))
    sets = heads(texts, words, percent)
    sets = frozen(sets.withColumn("variant", F.xxhash64("n", "one", "two")).withColumn("group", F.xxhash64("n", "head")).drop("one", "two"))
    full = sets.where("n > 0")
    reps = frozen(full.groupBy("variant").agg(F.min("row").alias("row"), F.min("group").alias("group"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    members = reps.groupBy("group").agg(F.min("variant").alias("lead"), F.count("*").alias("variants"))
    posted = full.select("group", "n", "head").dropDuplicates(["group"]).select("group", "n", F.size("head").alias("held"), F.posexplode("head").alias("place", "shingle"))
    posted = frozen(posted)

    # shingles of one group join nothing; of the others each group meets the group most of whose head others hold too, which
    # in a family of copies is the text that they were made from
    lists = posted.groupBy("shingle").agg(F.count("*").alias("groups")).where("groups > 1").select("shingle")
    shared = frozen(posted.join(lists, "shingle"))
    common = shared.groupBy("group").agg((F.count("*") / F.max("held")).alias("common"))
    first = F.min(F.struct((-F.col("common")).alias("own"), "n", "group", "place")).alias("first")
    firsts = frozen(shared.join(common, "group").groupBy("shingle").agg(first))
    removed(posted)
    shared = frozen(shared.drop("held").join(firsts, "shingle"), shared)
    meet = shared.where("group <> first.group").where(_may_link("n", "first.n", "place", "first.place", percent)).select("group", F.col("first.group").alias("to")).distinct()
    leads = members.select(F.col("group").alias("to"), F.col("lead").alias("b"))
    across = meet.join(leads, "to").join(reps.select("group", F.col("variant").alias("a")), "group").select("a", "b")
    within = reps.join(members.where("variants > 1"), "group").where("variant <> lead").select(F.col("variant").alias("a"), F.col("lead").alias("b"))
    fields = reps.select("variant", "n", "bits")
    tried = frozen(across.unionByName(within).distinct().join(fields.select(F.col("variant").alias("a"), F.col("n").alias("_n"), F.col("bits").alias("_x")), "a")
                   .join(fields.select(F.col("variant").alias("b"), F.col("n").alias("_m"), F.col("bits").alias("_y")), "b")
                   .where(_differ_little("_x", "_y", "_n", "_m", percent)).select("a", "b"))
    links = _verified(tried, texts, reps, words, percent)
    found = components(links)

    # what still joins different classes: by shingle, and within groups of several variants
    of = reps.join(found.withColumnRenamed("node", "variant"), "variant", "left").select("variant", "group", "n", F.coalesce("component", "variant").alias("class"))
    of = frozen(of)
    lists = shared.select("shingle", "group", "place").join(of, "group")
    within = of.join(members.where("variants > 1").select("group"), "group").select(F.col("group").alias("shingle"), "group", F.lit(0).alias("place"), "variant", "n", "class")
    lists = frozen(lists.select("shingle", "group", "place", "variant", "n", "class").unionByName(within))
    open_ = lists.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("shingle")
    lists = frozen(lists.join(open_, "shingle").join(fields.select("variant", "bits"), "variant"), lists)
    x, y = lists.alias("x"), lists.alias("y")
    pairs = x.join(y, F.expr("x.shingle = y.shingle AND x.class < y.class AND " + _may_link("x.n", "y.n", "x.place", "y.place", percent)
                            + " AND " + _differ_little("x.bits", "y.bits", "x.n", "y.n", percent)))
    pairs = pairs.select(F.col("x.variant").alias("a"), F.col("y.variant").alias("b")).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    more = _verified(pairs, texts, reps, words, percent)
    for table in (shared, lists, firsts, of):
        removed(table)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    labels = reps.select("variant").join(found.withColumnRenamed("node", "variant"), "variant", "left").select("variant", F.coalesce("component", "variant").alias("class"))
    smallest = full.groupBy("variant").agg(F.min("id").alias("id")).join(labels, "variant")
    smallest = smallest.groupBy("class").agg(F.min("id").alias("component_id")).join(labels, "class").select("variant", "component_id")
    out = sets.select("id", F.col("n").cast("long").alias("n_shingles"), "variant").join(smallest, "variant", "left")
    done = frozen(out.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))
    for table in (sets, reps, tried, links, more):
        removed(table)
    return done


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that belong to the class of a smaller id, with all columns. Rows that share an id
    share its fate."""
    found = classes(docs, id_col, text_col, words, percent)
    gone = frozen(found.where(F.col("id") > F.col("component_id")).select(F.col("id").alias(id_col)).distinct())
    return only(docs, gone, id_col, "left_anti")
