"""Packing into sequences of a fixed length by cutting stock: a linear program over patterns of a length histogram.

Each document is tokenized, ended with one id and cut into whole sequences and a rest. Pieces fall into classes of length (in
units of ``UNIT`` tokens, rounded up), and only the histogram of classes, at most ``size / UNIT`` numbers, reaches the driver.
There column generation solves the cutting-stock program: the basis prices the classes, a knapsack by dynamic programming
finds the pattern of most value, and it enters until none is worth more than the sequence it fills. The patterns' amounts are
rounded down and what is left is packed greedily, pattern by pattern. The documents of a class are ranked, by counts per
(class, salt) and a rank within each, and a rank gives sequence and slot; offsets are sums within a sequence. No step collects
rows or sorts more than one (class, salt) or one sequence in a task.

Rounding a piece up to its class wastes less than ``UNIT`` tokens, and only in a sequence that no further piece would fit.

Defined cases: a null text is empty and is its end id alone; repeated rows are documents of their own (ranks break ties by
place, and equal rows are interchangeable); an empty table gives an empty table; other columns are not read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslink.llm.memory import forgotten, tidy
from corpuslink.session import frozen

SIZE = 2048
UNIT = 8
SALTS = 256
STEADY, GAP = 0.5, 5e-4
END_ID = 1
WORDS, CHUNKS = 250_000, 100_000
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
# Latin letters without combining marks, then ASCII marks other than the apostrophe: always two pre-tokens, letters in lower case
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
SIMPLE_CHAR = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\\[-`{-~]")


class WordIds:
    """The ids of a text by the tokenizer file, from those of its parts between spaces and line feeds.

    The tokenizer normalises and splits at white space before all else and drops it, so parts are independent; parts seen
    before come from a cache, and a part of plain letters and marks from the cache of its letters in lower case. Those are one
    pre-token each, so that the model itself encodes them, without normalising and splitting once more; a probe of all their
    characters checks this when the file is loaded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spelt = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): "".join(x for x, _ in spelt.pre_tokenize_str(c)) for c in map(chr, range(0x21, 0x100)) if SIMPLE_CHAR.fullmatch(c)}
        letters = [chr(c) for c in self.bytes if chr(c).isalpha()]
        probe = [c.lower() for c in letters] + [(a + b).lower() for a, b in zip(letters, letters[7:], strict=False)] + ["".join(letters).lower(), "the", "walking"]
        probe += [chr(c) for c in self.bytes if not chr(c).isalpha()] + ["...", "?!", "$%%"]
        self.direct = all(self._modelled(w) == self._encoded(w) == self._encoded(w.upper() if len(w.upper()) == len(w) else w) for w in probe)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encoded(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _modelled(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.translate(self.bytes))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of lower-case letters or of marks."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            ids = self._modelled(word)
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def _chunk(self, part: str) -> bytes:
        simple = SIMPLE.fullmatch(part) if self.direct else None
        if not simple:
            return self._encoded(part)
        ids = self._word(simple[1].lower())
        return ids + self._word(simple[2]) if simple[2] else ids

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids, little-endian, one after another."""
        chunks = self.chunks
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(chunks.__getitem__, parts))
        except KeyError:
            pass
        if len(chunks) >= CHUNKS:
            chunks.clear()
        out = []
        for part in parts:
            ids = chunks.get(part)
            if ids is None:
                ids = self._chunk(part) if part else b""
                if len(part) <= 64:
                    chunks[part] = ids
            out.append(ids)
        return b"".join(out)


_loaded: dict[str, WordIds] = forgotten({})


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), with ``ids`` also the ids: every document cut into whole sequences and
    a rest."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for name, text in zip(names, batch.column(1), strict=True):
                data = model.ids(text.as_py() or "") + end
                view = memoryview(data)
                for at in range(0, len(data), step):
                    part = view[at:at + step]
                    rows.append((name, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, *((bytes(part),) if ids else ())))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + ids)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:5 + ids])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = PIECE.replace("doc_id bigint", f"doc_id {source.schema['doc_id'].dataType.simpleString()}")
    return source.mapInArrow(tidy(run), kind + (", ids binary" if ids else ""))


def best_pattern(prices: np.ndarray, lengths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value among those of ``room`` units: an unbounded knapsack, one state per unit."""
    value = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = np.searchsorted(lengths, r, side="right")
        value[r], taken[r] = value[r - 1], -1
        if fits:
            with_one = value[r - lengths[:fits]] + prices[:fits]
            k = int(np.argmax(with_one))
            if with_one[k] > value[r] + 1e-12:
                value[r], taken[r] = with_one[k], k
    pattern, r = np.zeros(len(lengths), np.int64), room
    while r > 0:
        if taken[r] < 0:
            r -= 1
        else:
            pattern[taken[r]] += 1
            r -= int(lengths[taken[r]])
    return float(value[room]), pattern


def cutting_stock(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern as class -> pieces, how often): sequences of ``room`` units that hold every piece of ``demand`` (class ->
    pieces), and no slot more."""
    lengths = np.array(sorted(demand), np.int64)
    if not len(lengths):
        return []
    wanted = np.array([demand[int(c)] for c in lengths], float)
    plans: list[tuple[np.ndarray, int]] = []
    n = len(lengths)
    basis, costs = np.diag((room // lengths).astype(float)), np.ones(n)
    bound, centre = 0.0, np.zeros(n)
    for _ in range(40 * n):  # stops far earlier; a basis short of the best is still a right packing
        prices, amounts = np.linalg.solve(basis.T, costs), np.linalg.solve(basis, wanted)
        if prices.min() < -1e-9:  # more pieces of a class than wanted cost nothing
            column, cost = -np.eye(n)[int(np.argmin(prices))], 0.0
        else:
            # prices near the best bound's so far make steadier patterns; where those fail, the prices themselves decide
            for trial in ((1 - STEADY) * prices + STEADY * centre, prices):
                value, pattern = best_pattern(np.maximum(trial, 0), lengths, room)
                fair = np.maximum(trial, 0) / max(1.0, value)
                if fair @ wanted > bound:
                    bound, centre = fair @ wanted, fair
                if prices @ pattern > 1 + 1e-7:
                    break
            if prices @ pattern <= 1 + 1e-7 or costs @ amounts <= bound * (1 + GAP):
                break
            column, cost = pattern.astype(float), 1.0
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, np.maximum(amounts, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out], costs[out] = column, cost
    amounts = np.floor(np.linalg.solve(basis, wanted) + 1e-9).astype(np.int64)
    left = wanted.astype(np.int64)
    for k in np.flatnonzero((amounts > 0) & (costs > 0)):
        pattern, open_ = np.rint(basis[:, k]).astype(np.int64), int(amounts[k])
        while open_ and (pattern := np.minimum(pattern, left)).any():  # slots of a class that is used up stay out
            times = int(min(open_, (left[pattern > 0] // pattern[pattern > 0]).min()))
            plans.append((pattern, times))
            left = left - pattern * times
            open_ -= times
    while left.any():
        pattern, free = np.zeros(len(lengths), np.int64), room
        for k in range(len(lengths) - 1, -1, -1):
            pattern[k] = min(left[k], free // lengths[k])
            free -= int(pattern[k] * lengths[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plans.append((pattern, times))
        left -= pattern * times
    return [({int(lengths[k]): int(p[k]) for k in np.flatnonzero(p)}, t) for p, t in plans]


def packed(cut: DataFrame, size: int = SIZE, unit: int = UNIT, salts: int = SALTS) -> DataFrame:
    """The pieces with sequence_id, offset and sequence_length."""
    spark = cut.sparkSession
    rows = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    rows = frozen(rows)
    counts = rows.groupBy("class", "salt").agg(F.count("*").alias("n")).collect()  # at most classes x salts numbers
    demand: dict[int, int] = {}
    firsts = []
    for r in sorted(counts):
        firsts.append((r[0], r[1], demand.get(r[0], 0)))
        demand[r[0]] = demand.get(r[0], 0) + r[2]
    slots, sequence, reached = [], 0, dict.fromkeys(demand, 0)
    for pattern, times in cutting_stock(demand, size // unit):
        for c, n in pattern.items():
            slots.append((c, reached[c], reached[c] + n * times, n, sequence))
            reached[c] += n * times
        sequence += times
    firsts = spark.createDataFrame(firsts, "class int, salt int, before bigint")
    slots = spark.createDataFrame(slots, "class int, lo bigint, hi bigint, each bigint, base bigint")
    place = F.row_number().over(Window.partitionBy("class", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "start"))
    ranked = rows.withColumn("place", place).join(F.broadcast(firsts), ["class", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    fits = (ranked["class"] == slots["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    dealt = ranked.join(F.broadcast(slots), fits).drop(slots["class"]).withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
    own = Window.partitionBy("sequence_id")
    before = own.orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), F.sum("length").over(own).alias("sequence_length"))


def sequences(cut: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, length): the packed ids themselves; ``cut`` must carry ids. Padded to ``size`` unless the length is
    a power of two."""
    rows = packed(cut, size)
    joined = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.first("sequence_length").alias("length"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    power = F.expr("bit_count(length) = 1")
    pad = F.when(power, F.lit(b"").cast("binary")).otherwise(F.expr(f"CAST(unhex(repeat('{np.array([pad_id], '<u4').tobytes().hex()}', CAST({size} - length AS INT))) AS BINARY)"))
    return joined.select("sequence_id", F.concat(ids, pad).alias("ids"), "length")
