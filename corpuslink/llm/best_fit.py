"""Best-fit packing in bulk-synchronous rounds.

Each document is tokenized, ended with one id and, if longer than a sequence, cut into whole sequences behind a first, shorter
piece. A piece of more than half a sequence opens a sequence of its own; what it leaves is a gap. In each round

1. as many empty sequences are opened as the waiting pieces need at the least, by a bound over the counts of their lengths;
2. pieces and gaps are sorted together by size into ranges, the largest first, a gap before a piece of its size;
3. every range sweeps its own rows: a piece goes into the smallest gap that holds it, the rest of a gap is a gap again. Pieces
   that found none and gaps left over are numbered;
4. the ranges' counts (a few numbers for each range) are matched like brackets: the pieces that a range could not place take the
   nearest gaps of the ranges before it. Where they claim the same gap their rank decides: the k-th claim takes the gap of that
   rank, and as many follow it into one gap as the longest of them fits;
5. gaps shrink by what came in, those too small for any piece close, and the next round takes what waits.

No step holds more than one range of about ``RANGE_ROWS`` pieces and gaps; broadcasts are the counts of ranges. A round without a match opens sequences for all that is
left, so that every round places pieces and the rounds end.

Ids: the file's vocabulary and merges are those of a byte-level model whose merges are numbered in order; ``tiktoken`` then gives
the same ids several times faster, and is used after a check of this property of the file. What it refuses (runs of a
hundred thousand blanks) and files without the property are encoded by ``tokenizers``.

Defined cases: a null text is empty and is its end id alone; repeated rows are documents of their own; an empty table gives an
empty table; other columns are not read."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslink.session import frozen, removed

SIZE = 1024
END_ID = 2
RANGE_ROWS = 100_000
# fixed values: how byte-level models spell bytes, and the pattern of their pre-tokens
PRINTED = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteIds:
    """The ids of texts by a tokenizer file."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as file:
            self.fast = self._numbered(json.load(file))

    def _numbered(self, said: dict):
        """The same model by ranks, or None where the file is not such a model."""
        import tiktoken

        model, split = said["model"], said.get("pre_tokenizer") or {}
        own = {t["content"]: t["id"] for t in said["added_tokens"]}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in said["added_tokens"])
        same = said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not (plain and same and model["type"] == "BPE"):
            return None
        rest = [b for b in range(256) if b not in PRINTED]
        byte = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in own}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if not all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=own)

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids, little-endian, one after another."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()
            except ValueError:
                pass
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, ByteIds] = {}  # one model while a worker tokenizes; the sweeps let it go


def byte_ids(path: str) -> ByteIds:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = ByteIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ``ids`` also the ids: every document in pieces of at most ``size``, of
    which only the first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_ids(path)
        for batch in batches:
            names, at, starts, lengths, crcs, parts = batch.column(0), [], [], [], [], []
            places = []
            for row, text in enumerate(batch.column(1)):
                data = memoryview(model.ids(text.as_py() or "") + end)
                n = len(data) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = data[4 * a:4 * b]
                    places.append(row)
                    at.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(part))
                    if ids:
                        parts.append(bytes(part))
            columns = [names.take(pa.array(places, pa.int64())), pa.array(at, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if ids else ""))


def needed(waiting: dict[int, int], gaps: dict[int, int], size: int) -> int:
    """Sequences that the waiting pieces (length -> number) need beside the gaps (size -> number) in any packing: for every
    length, what is at least as long goes into gaps at least as large, or into new sequences."""
    most = volume = held = 0
    free = sorted(gaps, reverse=True)
    for length in sorted(waiting, reverse=True):
        volume += length * waiting[length]
        while free and free[0] >= length:
            held += free[0] * gaps[free.pop(0)]
        most = max(most, -(-(volume - held) // size))
    return most


class Sweep:
    """The gaps that a sweep from large to small has passed: those that hold the next piece on a stack, the smallest on top;
    rests that are still larger than no row to come aside."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int]] = []
        self.aside: list[tuple[int, int]] = []

    def down_to(self, size: int) -> None:
        while self.aside and -self.aside[0][0] >= size:
            free, key = heapq.heappop(self.aside)
            self.open.append((-free, key))

    def gap(self, free: int, key: int) -> None:
        self.down_to(free)
        self.open.append((free, key))

    def place(self, length: int) -> int | None:
        """The gap that takes a piece."""
        self.down_to(length)
        if not self.open:
            return None
        free, key = self.open.pop()
        if free - length >= length:
            self.open.append((free - length, key))
        elif free > length:
            heapq.heappush(self.aside, (length - free, key))
        return key


def _swept(rows: DataFrame) -> DataFrame:
    """The sorted rows with the range they lie in; a piece with the gap it found there (``bin``) or its ``rank`` among those
    that found none; a gap with what is left of it and its rank, the smallest first, if it can take pieces of later ranges."""
    names = [f.name for f in rows.schema.fields if f.name != "spread"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.clear()
        sweep, part, failed = Sweep(), TaskContext.get().partitionId(), 0
        blank = None
        for batch in batches:
            blank = batch.slice(0, 0)
            is_piece, sizes, keys = (batch.column(c).to_pylist() for c in ("is_piece", "size", "key"))
            bins, ranks, at = [], [], []
            for i, (piece, size, key) in enumerate(zip(is_piece, sizes, keys, strict=True)):
                if piece:
                    found = sweep.place(size)
                    at.append(i)
                    bins.append(found)
                    ranks.append(failed if found is None else None)
                    failed += found is None
                else:
                    sweep.gap(size, key)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), pa.array([part] * len(at), pa.int32()), pa.array(bins, pa.int64()), pa.array(ranks, pa.int64())],
                                             [*names, "part", "bin", "rank"])
        left = [*reversed(sweep.open), *((-free, key) for free, key in sweep.aside)]
        if left:
            n = len(left)
            own = {"is_piece": pa.array([False] * n), "size": pa.array([x[0] for x in left], pa.int64()), "key": pa.array([x[1] for x in left], pa.int64())}
            ranked = [i if i < len(sweep.open) else None for i in range(n)]
            yield pa.RecordBatch.from_arrays([*(own.get(name, pa.nulls(n, blank.schema.field(name).type)) for name in names),
                                              pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(ranked, pa.int64())], [*names, "part", "bin", "rank"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "spread")
    return rows.mapInArrow(run, f"{kinds}, part int, bin bigint, rank bigint")


def claims(ranges: list[tuple[int, bool, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(range, first rank, rank after the last, range of the gaps, rank of the first gap, pieces a gap): which gaps the pieces
    take that found none in their own range. ``ranges``: (range, is_piece, number, longest piece or smallest gap)."""
    found, gaps = [], []
    pieces_of = {part: (n, size) for part, is_piece, n, size in ranges if is_piece}
    gaps_of = {part: (n, size) for part, is_piece, n, size in ranges if not is_piece}
    for part in sorted(pieces_of.keys() | gaps_of.keys()):
        n, longest = pieces_of.get(part, (0, 0))
        at = 0
        while at < n and gaps and gaps[-1][3] >= longest:
            where, rank, left, least = gaps[-1]
            each = least // longest
            used = min(left, -(-(n - at) // each))
            stop = min(n, at + used * each)
            found.append((part, at, stop, where, rank, each))
            at = stop
            gaps.pop()
            if used < left:
                gaps.append((where, rank + used, left - used, least))
        if part in gaps_of:
            n, least = gaps_of[part]
            gaps.append((part, 0, n, least))
    return found


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut.sparkSession
    carried = [c for c in cut.columns if c != "length"]
    rows = frozen(cut.withColumn("key", F.monotonically_increasing_id()))
    own = F.col("length") * 2 > size
    placed = [rows.where(own).select(*carried, "length", "key", F.col("key").alias("bin"))]
    waiting = rows.where(~own).select(*carried, F.col("length").alias("size"), "key")
    gaps = rows.where(own & (F.col("length") < size)).select(F.col("key").alias("bin"), (size - F.col("length")).alias("free"))
    opened, before, old = 0, None, []
    while True:
        counts = waiting.groupBy(F.lit(True).alias("k"), "size").count().unionByName(gaps.groupBy(F.lit(False).alias("k"), F.col("free").alias("size")).count()).collect()  # at most 2 x size numbers
        lengths, room = ({r["size"]: r["count"] for r in counts if r["k"] == kind} for kind in (True, False))
        if not lengths:
            break
        total = sum(lengths.values())
        new = needed(lengths, room, size) if total != before else max(1, -(-sum(k * n for k, n in lengths.items()) // size))
        before = total
        if new:
            gaps = gaps.unionByName(spark.range(opened, opened + new).select((-1 - F.col("id")).alias("bin"), F.lit(size).cast("long").alias("free")))
            opened += new
        none = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in carried]
        both = waiting.withColumn("is_piece", F.lit(True)).unionByName(gaps.where(F.col("free") >= min(lengths)).select(*none, F.col("free").alias("size"), F.col("bin").alias("key"), F.lit(False).alias("is_piece")))
        order = [F.desc("size"), F.asc("is_piece"), F.asc("spread"), F.asc("key")]
        both = both.withColumn("spread", F.xxhash64("key"))
        ranges = -(-(total + new + sum(room.values())) // RANGE_ROWS)
        swept = frozen(_swept(both.repartitionByRange(ranges, *order).sortWithinPartitions(*order)))
        open_ = swept.where(F.col("rank").isNotNull())
        sizes = open_.groupBy("part", "is_piece").agg(F.count("*"), F.when(F.col("is_piece"), F.max("size")).otherwise(F.min("size")))
        taken = spark.createDataFrame(claims([tuple(r) for r in sizes.collect()]), "part int, lo bigint, hi bigint, gap_part int, gap_rank bigint, each bigint")  # a few numbers a range
        free = open_.where(~F.col("is_piece")).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("key").alias("found"))
        claim = open_.where("is_piece").join(F.broadcast(taken.withColumnRenamed("gap_rank", "first_gap")), (open_["part"] == taken["part"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").drop(taken["part"])
        claim = claim.withColumn("gap_rank", F.col("first_gap") + F.expr("(rank - lo) div each")).join(free, ["gap_part", "gap_rank"], "left")
        done = frozen(swept.where(F.col("is_piece") & F.col("bin").isNotNull()).select(*carried, "size", "key", "bin").unionByName(claim.select(*carried, "size", "key", F.col("found").alias("bin"))).coalesce(ranges))
        left = swept.where(~F.col("is_piece")).select(F.col("key").alias("bin"), F.col("size").alias("free"))
        came = claim.where(F.col("found").isNotNull()).select(F.col("found").alias("bin"), (-F.col("size")).alias("free"))
        gaps = frozen(left.unionByName(came).groupBy("bin").agg(F.sum("free").alias("free")).where(F.col("free") > 0).coalesce(ranges))
        for table in (swept, *old):
            removed(table)
        old = [gaps]
        placed.append(done.where(F.col("bin").isNotNull()).select(*carried, F.col("size").alias("length"), "key", "bin"))
        waiting = done.where(F.col("bin").isNull()).select(*carried, "size", "key")
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    ahead = Window.partitionBy("bin").orderBy(F.desc("length"), "key").rowsBetween(Window.unboundedPreceding, -1)
    return every.select(*cut.columns, F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
