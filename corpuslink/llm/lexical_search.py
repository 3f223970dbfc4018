"""Ranked lexical search without a document index: one automaton of all items' terms scans the texts.

A term is a run of digits, ASCII letters (A-Z taken as a-z) and non-ASCII characters. The terms of all items, each between two
guards, make an Aho-Corasick automaton; a text in which every other character has become a guard is read once, and what the
automaton puts out are whole terms, counted at once. The counts of a text's item terms go to a table in the shared checkpoint
folder (an id and a number for each different term that it holds; texts are not kept). From it come the corpus' figures and each
term's weight, and a second pass over it adds up the scores: a term leads to the items that ask for it, a task keeps the best few
documents of each item, and their best few overall are found by two bounded windows.

What is broadcast has a bound: terms travel in slices of ``SLICE_CHARS`` characters (more slices are further passes over the
texts), items in slices of ``SLICE_PAIRS`` (item, term) pairs (more slices are further passes over the counts), a term longer
than ``LONG`` characters is known by its beginning and compared with the text, and an item with more terms than a slice holds
is joined to the counts instead.

Defined cases: a null text has no terms; an item without terms has no row; repeated rows of the documents are documents of
their own and repeated items are ranked each by itself; among equal scores smaller ids come first and null ids last (ids that
are no integers are ordered as text); empty tables give an empty result; other columns are not read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslink.llm.words import ALNUM, LOWER, pieces
from corpuslink.session import frozen, removed

TOP = 10
SLICE_CHARS = 1_000_000
SLICE_PAIRS = 500_000
LONG = 1_000
SALTS = 32
CELLS = 1_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IS_TERM = ALNUM[LOWER]
GUARDED = np.where(IS_TERM, LOWER, 0x20).astype(np.uint8)


def asked(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, terms): each item's different terms under a number of its own."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, SMALL), F.lit(TERM), F.lit(0)))
    return items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), terms.alias("terms"))


def sliced(rows: DataFrame, key: str, weight: str, most: int) -> list[DataFrame]:
    """``rows`` in parts by a hash of ``key``, none with more than ``most`` of ``weight`` in all unless by one row alone."""
    n = 1
    while True:
        part = F.pmod(F.xxhash64(key), F.lit(n))
        sums = rows.groupBy(part.alias("part")).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).where((F.col("w") > most) & (F.col("n") > 1))
        if not sums.limit(1).count():
            return [rows.where(part == i) for i in range(n)]
        n *= 2


class Terms:
    """The automata of one slice: whole guarded terms, and beginnings of those longer than ``LONG`` characters."""

    def __init__(self, rows: list[tuple[str, int]], long: int):
        import ahocorasick

        self.whole, self.begun, starts = ahocorasick.Automaton(), None, {}
        for term, number in rows:
            if len(term) > long:
                starts.setdefault(f" {term[:long]}", []).append((term, number))
            else:
                self.whole.add_word(f" {term} ", number)
        if len(self.whole):
            self.whole.make_automaton()
        if starts:
            self.begun = ahocorasick.Automaton()
            for start, ends in starts.items():
                self.begun.add_word(start, ends)
            self.begun.make_automaton()
        self.long = long

    def counts(self, text: str) -> Counter[int]:
        """How often each term occurs in a text whose characters are those of terms and guards."""
        found: Counter[int] = Counter(map(itemgetter(1), self.whole.iter(text))) if len(self.whole) else Counter()
        for end, terms in self.begun.iter(text) if self.begun else ():
            start = end + 1 - self.long
            for term, number in terms:
                if text.startswith(f"{term} ", start):
                    found[number] += 1
        return found


def _counted(docs: DataFrame, place: int, shared: Broadcast, long: int, keep_text: bool) -> DataFrame:
    """``docs`` (with ``n_terms``, ``terms`` and ``tfs``, which earlier slices may have begun) after one slice."""
    kept = [f for i, f in enumerate(docs.schema.fields) if (keep_text or i != place) and f.name not in ("n_terms", "terms", "tfs")]
    numbers = pa.list_(pa.int64())
    result = T.StructType([*kept, T.StructField("n_terms", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value, long)
        for batch in batches:
            n_terms, sizes, ids, tfs = [], [], [], []
            before = [batch.column(name).to_pylist() for name in ("terms", "tfs")] if "terms" in batch.schema.names else None
            for row, stop, data, offsets in pieces(batch.column(place)):
                inside = IS_TERM[data]
                inside[1:] &= ~IS_TERM[data[:-1]]
                filled = offsets[:-1][offsets[:-1] < offsets[1:]]
                inside[filled] = IS_TERM[data[filled]]
                n_terms += np.diff(np.searchsorted(np.flatnonzero(inside), offsets)).tolist()
                guarded = GUARDED[data].tobytes()
                for d in range(stop - row):
                    found = terms.counts(f" {guarded[offsets[d]:offsets[d + 1]].decode()} ")
                    ids += found.keys()
                    tfs += found.values()
                    sizes.append(len(found))
                    if before:
                        ids += before[0][row + d]
                        tfs += before[1][row + d]
                        sizes[-1] += len(before[0][row + d])
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())).cast(numbers) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(n_terms, pa.int64()), *lists], result.names)

    return docs.mapInArrow(run, result)


def counted(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS, long: int = LONG) -> DataFrame:
    """(doc_id, n_terms, terms, tfs, row) of every text with a term, written: the numbers of the terms of ``words`` (term, number)
    in it and how often each occurs."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context, sent = docs.sparkSession.sparkContext, []
    slices = sliced(words.withColumn("size", F.least(F.char_length("term"), F.lit(long))), "term", "size", slice_chars)
    for k, part in enumerate(slices):
        sent.append(context.broadcast([(r[0], r[1]) for r in part.select("term", "number").collect()]))  # at most slice_chars characters
        last = k == len(slices) - 1
        before, out = out, _counted(out, 1, sent[-1], long, not last)
        out = out if last else frozen(out, before)
    done = frozen(out.where("n_terms > 0").withColumn("row", F.monotonically_increasing_id()))
    removed(before)
    for one in sent:
        one.destroy()
    return done


class Best:
    """The best ``top`` documents of each of ``n`` items among those offered, ties by id."""

    def __init__(self, n: int, top: int, text_ids: bool):
        self.n, self.top = n, top
        self.least = np.ones(n, np.int64)  # a score below it is of no use any more
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.none, self.id = np.zeros(0, bool), np.zeros(0, "U1" if text_ids else np.int64)

    def offer(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: documents x items."""
        if len(scores) > self.top:
            place = len(scores) - self.top
            self.least = np.maximum(self.least, np.partition(scores, place, axis=0)[place])
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        self.item, self.score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[row, item]))
        self.none, self.id = np.concatenate((self.none, none[row])), np.concatenate((self.id, ids[row]))
        order = np.lexsort((self.id, self.none, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.top]
        self.item, self.score, self.none, self.id = self.item[order], self.score[order], self.none[order], self.id[order]
        last = rank[rank < self.top] == self.top - 1
        self.least[self.item[last]] = np.maximum(self.least[self.item[last]], self.score[last])


def _best(counts: DataFrame, rows: list[tuple[int, int, int]], n_docs: int, all_terms: int, top: int) -> tuple[DataFrame, Broadcast]:
    """(item, doc_id, score): in each task the best ``top`` documents of each item of one slice; ``rows``: (item, number, weight)."""
    items, of = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
    number, weight = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    order = np.argsort(number, kind="stable")
    numbers, first = np.unique(number[order], return_index=True)
    shared = counts.sparkSession.sparkContext.broadcast((items, numbers, np.append(first, len(order)), of[order], weight[order][first]))
    kind = counts.schema["doc_id"].dataType
    text_ids = not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, numbers, first, of, weights = shared.value
        best = Best(len(items), top, text_ids)
        block = max(1, CELLS // len(items))
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                ids = part.column(0)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = np.array(ids.cast(pa.string()).fill_null("").to_pylist()) if text_ids else ids.cast(pa.int64()).fill_null(0).to_numpy()
                m = np.array([10 + 90 * n * n_docs // all_terms for n in part.column(1).to_pylist()], np.int64)
                row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                place = np.minimum(np.searchsorted(numbers, term), len(numbers) - 1)
                known = numbers[place] == term
                row, place, tf = row[known], place[known], tf[known]
                worth = weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                each = first[place + 1] - first[place]
                asked_by = of[np.repeat(first[place] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                scores = np.zeros((len(part), len(items)), np.int64)
                np.add.at(scores.reshape(-1), np.repeat(row, each) * len(items) + asked_by, np.repeat(worth, each))
                best.offer(scores, none, ids)
        ids = pa.array(best.id.tolist(), mask=best.none)
        yield pa.RecordBatch.from_arrays([pa.array(items[best.item]), ids if text_ids else ids.cast(pa.int64()), pa.array(best.score)], ["item", "doc_id", "score"])

    out = counts.select("doc_id", "n_terms", "terms", "tfs").mapInArrow(run, f"item bigint, doc_id {'string' if text_ids else 'bigint'}, score bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)), shared


def _joined(counts: DataFrame, pairs: DataFrame, n_docs: int, all_terms: int) -> DataFrame:
    """(item, doc_id, score) of all documents for the items of ``pairs``, by a join."""
    held = counts.select("row", "doc_id", "n_terms", F.explode(F.arrays_zip(F.col("terms").alias("number"), F.col("tfs").alias("tf"))).alias("t"))
    long = "CAST(10 + (CAST(90 * n_terms AS DECIMAL(38, 0)) * {n}) div {all} AS BIGINT)".format(n=n_docs, all=all_terms)
    held = held.select("row", "doc_id", F.expr(long).alias("m"), F.col("t.number").alias("number"), F.col("t.tf").alias("tf"))
    worth = F.col("weight") * F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    return held.join(pairs, "number").groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(worth).alias("score")).where("score > 0").drop("row")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, found in every salt first."""
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= top).drop("salt")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, slice_chars: int = SLICE_CHARS, slice_pairs: int = SLICE_PAIRS, long: int = LONG) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, the best first."""
    wanted = frozen(asked(items, item_id, item_text))
    words = frozen(wanted.select(F.explode("terms").alias("term")).distinct().withColumn("number", F.monotonically_increasing_id()))
    counts = counted(docs, words, id_col, text_col, slice_chars, long)
    n_docs, all_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = counts.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    pairs = wanted.select("item", F.explode("terms").alias("term")).join(words, "term").join(held, "number")
    pairs = frozen(pairs.select("item", "number", weight.alias("weight")).where("weight > 0"))
    sizes = pairs.groupBy("item").agg(F.count("*").alias("pairs"))
    vast = frozen(sizes.where(F.col("pairs") > slice_pairs))
    found = []
    if n_docs:
        for part in sliced(sizes.where(F.col("pairs") <= slice_pairs), "item", "pairs", slice_pairs):
            rows = [tuple(r) for r in pairs.join(part, "item", "left_semi").collect()]  # at most slice_pairs rows
            if rows:
                best, shared = _best(counts, rows, n_docs, all_terms, top)
                found.append(frozen(best))
                shared.destroy()
        if vast.count():
            found.append(_joined(counts, pairs.join(vast, "item", "left_semi"), n_docs, all_terms))
    best = found[0] if found else counts.limit(0).select(F.lit(0).cast("long").alias("item"), "doc_id", F.lit(0).cast("long").alias("score"))
    for more in found[1:]:
        best = best.unionByName(more)
    out = frozen(_ranked(best, top).join(wanted.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    for table in (counts, pairs, vast, words, wanted, *found):
        removed(table)
    return out
