"""Token counts without a tokenizer run over every text: a two-tier lookup of pre-token lengths on the map side.

In a piece model whose pieces hold the blank mark only at their start, no merge crosses from a word to the blank after it, so
that a text's tokens are those of its pre-tokens: a run of blanks and the word behind it. ``Pieces`` checks this property of
the vocabulary before it is relied on; for a model without it every text is encoded as a whole.

Tier one is a table of the most frequent pre-tokens and their lengths, at most ``TABLE`` entries, broadcast as two compact
arrays. It is learnt from all texts: each task counts its own pre-tokens a few megabytes at a time and hands on only those
frequent there, so that summaries are shuffled and never the pre-tokens. Tier two is a cache in each Python worker, emptied
when it reaches ``CACHE`` entries; what neither holds is encoded, many at a time. The table and the cache decide the speed
alone; the counts are the library's.

Defined cases: a null text is empty; an empty text has no token; repeated rows are counted each; an empty table gives an
empty table; other columns are carried along, and those that clash with a result column are replaced."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE = 50_000
CACHE = 400_000
SEEN = 8
BLANK = "▁"
RUN = re.compile("( *)([^ ]+)| +$")
CHUNK = 2_000_000


class Pieces:
    """A sentencepiece model with the lengths of the pre-tokens seen so far. A pre-token is named by its text without the
    first blank."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # the properties that make pre-tokens independent: blanks only at the start of a piece, every blank kept, one added in front
        self.split = not any(re.search(f"[^{BLANK}]{BLANK}", n) for n in names) and self.model.encode("a  b", out_type=str)[0].startswith(BLANK) \
            and "".join(self.model.encode(" a  b ", out_type=str)) == f"{BLANK * 2}a{BLANK * 2}b{BLANK}"
        self.table: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def lengths(self, names: list[str]) -> list[int]:
        # the library gives nothing at all for an empty text; as a pre-token it is the single blank at a text's end
        return [len(x) if n else 1 for n, x in zip(names, self.model.encode(names, num_threads=1), strict=True)]

    def learn(self, names: set[str]) -> None:
        """``known`` holds the table and the cache, so that a lookup is one step."""
        new = names - self.known.keys()
        if len(self.known) + len(new) > len(self.table) + CACHE:
            self.known = dict(self.table)
            new = names - self.known.keys()
        named = list(new)
        self.known.update(zip(named, self.lengths(named), strict=True))


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that is not empty, each without its first blank."""
    text = text.replace(BLANK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return [m[0][1:] for m in RUN.finditer(" " + text)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def frequent(texts: DataFrame, text_col: str, table: int = TABLE) -> list[str]:
    """The most frequent pre-tokens over all texts, as far as they are frequent anywhere: at most ``table`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        size = 0

        def summary() -> pa.RecordBatch:
            often = [(k, n) for k, n in counts.items() if n >= SEEN and len(k) <= 64]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["name", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pre_tokens(text))
                    size += len(text)
                if size >= CHUNK:
                    yield summary()
                    counts, size = Counter(), 0
        yield summary()

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    return [r[0] for r in found.orderBy(F.desc("n"), "name").limit(table).collect()]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", table: int = TABLE, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text if ``keep_text`` is false) with n_bytes and n_tokens. ``path``: the model file, at the same
    place on every machine."""
    docs = docs.drop("n_bytes", "n_tokens").withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names = frequent(docs, text_col, table)
    lengths = np.array(pieces(path).lengths(names) if names else [], np.uint16)
    shared = docs.sparkSession.sparkContext.broadcast((names, lengths))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    place = docs.columns.index(text_col)
    result = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        names, lengths = shared.value
        model.table = dict(zip(names, lengths.tolist(), strict=True))
        model.known.update(model.table)
        for batch in batches:
            n_bytes = pa.compute.binary_length(batch.column(place))
            counts: list[int] = []
            for group in _groups(batch.column(place)):
                counts += _counts(model, group)
            carried = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), n_bytes.cast(pa.int64()), pa.array(counts, pa.int64())], [*carried, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, result)


def _groups(column: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for text in column:
        group.append(text.as_py())
        size += len(group[-1])
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _counts(model: Pieces, texts: list[str]) -> list[int]:
    if not model.split:
        return [len(x) for x in model.model.encode(texts, num_threads=1)]
    split = [pre_tokens(t) if t else [] for t in texts]
    model.learn(set().union(*split))
    return [sum(map(model.known.__getitem__, parts)) for parts in split]
