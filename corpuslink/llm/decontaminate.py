"""Benchmark decontamination: a broadcast hash set of the test items' word n-grams, one scan over the training texts.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is ``size`` consecutive words of
an item; an item of fewer words, but not none, is one window. Every hash hit is compared with the item's own words before it
counts. Spark reads the training texts in splits and nothing of them is shuffled; only the windows of the test items travel,
in slices of at most ``SLICE`` windows, so what is broadcast has a bound whatever the size of the test set: more windows are
scanned in more passes, whose hits are put together by row.

Defined cases: a null text has no words; an empty text, a text without words and an empty test set give no hit; repeated
test items are items of their own (a null item id counts as the empty string); repeated rows of the training table are
judged each by itself; columns of other names are carried along and those that clash with a result column are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslink.llm.memory import tidy
from corpuslink.llm.words import ALNUM, U64, signed, words_of
from corpuslink.session import frozen

SIZE = 10
SLICE = 2_000_000
SPAN = "array<struct<start:bigint,end:bigint>>"
FOUND = f"n_words bigint, n_hit bigint, items array<string>, hit_spans {SPAN}"


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(code, words, gram, item): each different window of each item with its hash and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.string()).fill_null("").to_pylist()
            for row, stop, words in words_of(batch.column(1), ALNUM, True):
                seen: dict[tuple[int, bytes, str], int] = {}
                for d in range(stop - row):
                    first, last = int(words.first[d]), int(words.first[d + 1])
                    width = min(size, last - first)
                    if not width:
                        continue
                    codes = signed(words.windows(width))
                    for at in range(first, last - width + 1):
                        seen.setdefault((width, words.joined(at, width), ids[row + d]), int(codes[at]))
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([seen[k] for k in keys], pa.int64()), pa.array([k[0] for k in keys], pa.int32()),
                                                  pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.string())],
                                                 ["code", "words", "gram", "item"])

    return items.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), "code bigint, words int, gram binary, item string").distinct()


class _Set:
    """The windows of one slice: sorted hashes by width for the scan, words and items for the comparison."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[str]] = {}
        codes: dict[int, set[int]] = {}
        for code, width, gram, item in rows:
            self.items.setdefault(bytes(gram), []).append(item)
            codes.setdefault(width, set()).add(code)
        self.codes = {width: np.sort(np.array(list(v), np.int64)) for width, v in codes.items()}
        # a table of one bit per low hash bits rules out nearly every window before the search
        self.bits = {}
        for width, v in self.codes.items():
            table = np.zeros(1 << max(16, int(np.ceil(np.log2(len(v) + 1))) + 5), bool)
            table[v.view(U64) & U64(len(table) - 1)] = True
            self.bits[width] = table


def _scan(words, windows: _Set) -> tuple[np.ndarray, dict[int, set[str]]]:
    """(which words lie in an occurring window, items by text)."""
    delta = np.zeros(len(words) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for width, codes in windows.codes.items():
        found = words.windows(width)
        table = windows.bits[width]
        maybe = np.flatnonzero(table[found & U64(len(table) - 1)])
        if not len(maybe):
            continue
        values = signed(found[maybe])
        place = np.minimum(np.searchsorted(codes, values), len(codes) - 1)
        maybe = maybe[(codes[place] == values)]
        maybe = maybe[words.whole(width)[maybe]] if len(maybe) else maybe
        texts = np.searchsorted(words.first, maybe, side="right") - 1
        for at, d in zip(maybe.tolist(), texts.tolist(), strict=True):
            owners = windows.items.get(words.joined(at, width))
            if owners is None:
                continue
            delta[at] += 1
            delta[at + width] -= 1
            items.setdefault(d, set()).update(owners)
    return np.cumsum(delta)[:-1] > 0, items


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def _pass(docs: DataFrame, text_col: str, rows: list, keep_text: bool) -> DataFrame:
    """``docs`` with FOUND's columns in ``_found``, by one slice of the windows."""
    shared = docs.sparkSession.sparkContext.broadcast(_Set(rows))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    result = T.StructType([*kept, T.StructField("_found", T._parse_datatype_string(FOUND))])
    place = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for row, stop, words in words_of(batch.column(place), ALNUM, True):
                hit, owners = _scan(words, windows)
                n_words += np.diff(words.first).tolist()
                for d in range(stop - row):
                    own = owners.get(d)
                    part = hit[words.first[d]:words.first[d + 1]] if own else None
                    n_hit.append(int(part.sum()) if own else 0)
                    items.append(sorted(own) if own else [])
                    spans.append(_runs(part) if own else [])
            found = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                                               ["n_words", "n_hit", "items", "hit_spans"])
            carried = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), found], [*carried, "_found"])

    return docs.mapInArrow(tidy(run), result)


def hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         size: int = SIZE, slice_windows: int = SLICE, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text if ``keep_text`` is false) with n_words, n_hit, items (ids of the test items with an occurring window, sorted) and hit_spans (runs of hit
    words, by word number, end exclusive)."""
    docs = docs.drop("n_words", "n_hit", "items", "hit_spans", "_found")
    windows = frozen(test_windows(items, item_id, item_text, size))
    total = windows.count()
    slices = max(1, -(-total // slice_windows))
    part = F.pmod(F.xxhash64("gram"), F.lit(slices))
    out = None
    for i in range(slices):
        rows = [tuple(r) for r in windows.where(part == i).collect()]  # at most about SLICE windows of the test set, never training data
        keep = keep_text or i < slices - 1
        out = _pass(docs, text_col, rows, keep) if out is None else _merged(_pass(out.withColumnRenamed("_found", "_before"), text_col, rows, keep))
    return out.select(*[c for c in out.columns if c != "_found"], "_found.*")


def _merged(df: DataFrame) -> DataFrame:
    """Two slices' findings of one row as one: hit words are the union of both."""
    every = F.expr("array_distinct(flatten(transform(concat(_before.hit_spans, _found.hit_spans), s -> sequence(s.start, s.end - 1))))")
    runs = F.expr("""aggregate(sort_array(_all), CAST(array() AS array<struct<start:bigint,end:bigint>>), (a, w) ->
        CASE WHEN size(a) > 0 AND element_at(a, -1).end = w
        THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, w + 1 AS end)))
        ELSE concat(a, array(struct(w AS start, w + 1 AS end))) END)""")
    df = df.withColumn("_all", every)
    found = F.struct(F.col("_found.n_words").alias("n_words"), F.size("_all").cast("long").alias("n_hit"),
                     F.sort_array(F.array_union("_before.items", "_found.items")).alias("items"), runs.alias("hit_spans"))
    return df.withColumn("_found", found).drop("_before", "_all")


def without_hits(docs: DataFrame, items: DataFrame, mode: str = "spans", text_col: str = "text", **how) -> DataFrame:
    """The training table after decontamination, with the columns of ``docs``. ``mode`` "documents": rows with a hit go.
    "spans": hit words go from the text together with what stands between them; rows whose words all go are dropped."""
    columns = docs.columns
    found = hits(docs, items, text_col, **how)
    if mode == "documents":
        return found.where(F.col("n_hit") == 0).select(*columns)
    if mode != "spans":
        raise ValueError(f"mode is spans or documents, not {mode}")
    place = found.columns.index(text_col)
    spans = found.columns.index("hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list = []
            runs = batch.column(spans)
            for row, stop, words in words_of(batch.column(place), ALNUM, True):
                for d in range(stop - row):
                    own = runs[row + d].as_py()
                    text = batch.column(place)[row + d].as_py()
                    texts.append(_cut(text, words, d, own) if own else text)
            columns_ = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns_, batch.schema.names)

    cut = found.mapInArrow(tidy(run), found.schema)
    return cut.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).select(*columns)


def _cut(text: str, words, d: int, spans: list[dict]) -> str:
    data, base, first = text.encode(), int(words.offsets[d]), int(words.first[d])
    out, at = [], 0
    for s in spans:
        out.append(data[at:int(words.start[first + s["start"]]) - base])
        at = int(words.end[first + s["end"] - 1]) - base
    return b"".join([*out, data[at:]]).decode()
