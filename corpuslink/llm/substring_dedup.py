"""Substring dedup: words covered by a window of ``SIZE`` words that also starts elsewhere, found by level-wise doubling.

A window of the full length stays a candidate only while a shorter window inside it repeats. At each length of ``lengths``
(each twice the one before, the last the full one) a candidate is stood for by the shorter window of smallest hash inside
it; equal candidates choose equal ones, so a candidate whose choice occurs once in the whole table cannot repeat and goes.
Only survivors are extended to the next length, and at the full length every survivor stands for itself. One choice serves
many neighbouring candidates, so the first level handles a small part of all positions.

Each level is one aggregate over hashes, combined before its shuffle: a window that a third of all rows hold is one row per
task. What comes back are only the places of windows seen once, by text; a text's places are at most its own words. Texts
that lost all candidates are not read again. Windows of the full length are told apart by 96 bits of hash, shorter ones by 64
(there a collision only keeps a candidate for the next level).

Defined cases: a null text has no words; a text shorter than a window loses nothing; repeated rows are texts of their own and
repeat each other; overlapping repeats of a text with itself count; an empty table gives an empty table; other columns are
carried along, and those that clash with a result column are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslink.llm.keys import only
from corpuslink.llm.words import NOT_WHITE, STEP2, U64, Words, signed, words_of
from corpuslink.session import frozen

SIZE = 35
TOP = U64(0xFFFFFFFFFFFFFFFF)


def lengths_up_to(size: int, first: int) -> list[int]:
    """size, its half rounded up, and so on, down to ``first`` or more; shortest first."""
    out = [size]
    while (out[0] + 1) // 2 >= first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[:len(out) - step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out


class Level:
    """The candidates of some texts at one length. ``choice[i]``: the smallest hash among the shorter windows inside the
    window of ``size`` words from word ``i`` on."""

    def __init__(self, words: Words, size: int, length: int):
        self.words, self.size, self.length = words, size, length
        self.codes = words.windows(length)
        self.whole = words.whole(size)
        self.choice = sliding(self.codes, size - length + 1, np.minimum)[:len(self.whole)]

    def once(self, places: np.ndarray) -> np.ndarray:
        """Which windows chose a shorter window at ``places``, where each stands for the only one of its hash."""
        seen = np.full(len(self.codes), TOP)
        seen[places] = self.codes[places]
        return sliding(seen, self.size - self.length + 1, np.minimum)[:len(self.whole)] == self.choice

    def chosen(self, alive: np.ndarray) -> np.ndarray:
        """The places of the shorter windows that the windows in ``alive`` chose."""
        width = self.size - self.length + 1
        wanted = np.where(alive, self.choice, U64(0))
        padded = np.concatenate((np.zeros(width - 1, U64), wanted, np.zeros(len(self.codes) - len(wanted), U64)))
        return np.flatnonzero((sliding(padded, width, np.maximum)[:len(self.codes)] == self.codes) & (self.codes != 0))


def _alive(words: Words, size: int, lengths: list[int], singles: list[list[np.ndarray]]) -> np.ndarray:
    """Which windows are left after the lengths whose places are given. ``singles``: by length, by text."""
    alive = words.whole(size)
    for length, places in zip(lengths, singles, strict=False):
        at = np.concatenate([p + f for p, f in zip(places, words.first[:-1], strict=True)]) if len(places) else np.zeros(0, np.int64)
        level = Level(words, size, length)
        alive = alive & ~level.once(at.astype(np.int64))
    return alive


def _places(column: pa.Array, row: int, stop: int) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if not x.is_valid else np.asarray(x.values, np.int64) for x in (column[i] for i in range(row, stop))]


def _occurrences(texts: DataFrame, size: int, lengths: list[int], level: int) -> DataFrame:
    """(code, row, place) of what the candidates left in ``texts`` (row, text, once_0 …) choose at ``level``. The first level
    has also ``chosen``, how many choices the text has; the last also ``more``, further bits of the hash."""
    extra = (["chosen"] if level == 0 else []) + (["more"] if level == len(lengths) - 1 else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0), np.int64)
            for row, stop, words in words_of(batch.column(1), NOT_WHITE, False):
                if len(words) < size:
                    continue
                alive = _alive(words, size, lengths[:level], [_places(batch.column(2 + k), row, stop) for k in range(level)])
                if not alive.any():
                    continue
                at = Level(words, size, lengths[level]).chosen(alive)
                text = np.searchsorted(words.first, at, side="right") - 1
                columns = [pa.array(signed(words.windows(lengths[level])[at])), pa.array(keys[row:stop][text]), pa.array((at - words.first[text]).astype(np.int32))]
                if "chosen" in extra:
                    columns.append(pa.array(np.bincount(text, minlength=stop - row)[text].astype(np.int32)))
                if "more" in extra:
                    columns.append(pa.array((words.windows(lengths[level], STEP2)[at] >> U64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["code", "row", "place", *extra])

    return texts.mapInArrow(run, "code bigint, row bigint, place int" + "".join(f", {x} int" for x in extra))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(text_col, text).withColumn("row", F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]))


def repeated(docs: DataFrame, text_col: str = "text", size: int = SIZE, first: int = 9) -> tuple[DataFrame, list[int]]:
    """((row, text, once_0, …) of every text with a repeated window, the lengths): what each level found to occur once."""
    lengths = lengths_up_to(size, first)
    texts = _keyed(docs, text_col).select("row", F.col(text_col).alias("text"))
    before = None
    for level in range(len(lengths)):
        found = _occurrences(texts, size, lengths, level)
        known = [c for c in ("code", "more") if c in found.columns]
        others = [F.min(c).alias(c) for c in found.columns if c not in known]
        once = found.groupBy(*known).agg(F.count("*").alias("n"), *others).where("n = 1")
        by_text = once.groupBy("row").agg(F.collect_list("place").alias(f"once_{level}"), *([F.min("chosen").alias("chosen")] if level == 0 else []))
        if level == 0:
            singles = frozen(by_text)
            dead = frozen(singles.where(F.size("once_0") == F.col("chosen")).select("row"))
            texts = frozen(only(texts, dead, "row", "left_anti").join(singles.drop("chosen"), "row", "left"), singles)
        else:
            texts = frozen(texts.join(by_text, "row", "left"), before)
        before = texts
    return texts, lengths


def without_repeats(docs: DataFrame, text_col: str = "text", size: int = SIZE, first: int = 9) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, one space between them)."""
    docs = docs.drop("n_words", "n_removed", "kept_text", "row")
    texts, lengths = repeated(docs, text_col, size, first)
    onces = [f"once_{k}" for k in range(len(lengths))]
    keyed = _keyed(docs, text_col)
    marks = texts.select("row", *onces).dropDuplicates(["row"])
    marked = frozen(marks.select("row"))
    clean = only(keyed, marked, "row", "left_anti")
    cut = only(keyed, marked, "row", "left_semi").join(marks, "row")
    return _kept(cut, text_col, size, lengths, onces).unionByName(_kept(clean, text_col, size, lengths, []))


def _kept(docs: DataFrame, text_col: str, size: int, lengths: list[int], onces: list[str]) -> DataFrame:
    carried = [f for f in docs.schema.fields if f.name not in ("row", *onces)]
    names = docs.columns
    place = names.index(text_col)
    result = T.StructType([*carried, *(T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for row, stop, words in words_of(batch.column(place), NOT_WHITE, False):
                gone = np.zeros(len(words), bool)
                if onces and len(words) >= size:
                    hit = np.flatnonzero(_alive(words, size, lengths, [_places(batch.column(names.index(c)), row, stop) for c in onces]))
                    delta = np.zeros(len(words) + 1, np.int32)
                    np.add.at(delta, hit, 1)
                    np.add.at(delta, hit + size, -1)
                    gone = np.cumsum(delta)[:-1] > 0
                data = words.data.tobytes()
                for d in range(stop - row):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    left = np.flatnonzero(~gone[a:b]) + a
                    n_words.append(b - a)
                    n_removed.append(b - a - len(left))
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)]))
            columns = [batch.column(f.name) for f in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             [*(f.name for f in carried), "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(run, result)
