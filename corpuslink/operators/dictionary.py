"""A dictionary of strings looked for in texts: each text is read once for any number of them.

The strings make Aho-Corasick automata that are broadcast in slices of at most ``SLICE_CHARS`` characters; more strings are
further passes over the texts. Strings of one length that would fill several automata are looked up by hash instead: every window
of that length is hashed, in slices of at most ``HASHED_CHARS``. What comes back is a row for each text and string that occurs in
it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.session import frozen

SLICE_CHARS, HASHED_CHARS = 2_000_000, 16_000_000
# Characters of texts whose windows are hashed at once, and bits of a hash that a window is first tried by.
AT_ONCE, TRIED_BITS = 400_000, 24


def slices(strings: DataFrame, most: int = SLICE_CHARS) -> list[DataFrame]:
    """``strings(kind, string)`` in parts by hash, none of more than ``most`` characters unless of one string."""
    n = 1
    while True:
        part = F.pmod(F.xxhash64("kind", "string"), F.lit(n))
        large = strings.groupBy(part.alias("part")).agg(F.sum(F.length("string")).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > most) & (F.col("n") > 1))
        if large.limit(1).isEmpty():
            return [strings.where(part == i) for i in range(n)]
        n *= 2


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of ``length`` characters, put together from windows of powers of two."""
    out, have, window, span, factor = None, 0, codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while True:
        if length & span:
            if out is None:
                out, have = window, span
            else:  # ``out`` stands before ``window``
                n = len(codes) - have - span + 1
                out, have = out[:n] * np.uint64(factor) + window[have:have + n], have + span
        if 2 * span > length:
            break
        window = window[:-span] * np.uint64(factor) + window[span:]
        factor, span = factor * factor % (1 << 64), 2 * span
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(rows: DataFrame, column: int, kind: str, kind_of_key: str, listed: list[str], length: int) -> DataFrame:
    """The strings of ``listed``, all of ``length`` characters, that occur in the column of ``rows``: every window's hash is tried
    by its first bits, looked up, and the letters are compared."""
    some = max(1, AT_ONCE // length)
    hashes = np.concatenate([_hashes(_codes("".join(listed[k:k + some])), length)[::length] for k in range(0, len(listed), some)])
    order = np.argsort(hashes)
    shared = rows.sparkSession.sparkContext.broadcast((hashes[order], "".join(listed[i] for i in order)))
    cut = np.uint64(64 - TRIED_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = shared.value
        tried = np.zeros(1 << TRIED_BITS, bool)
        tried[known >> cut] = True
        string = lambda i: letters[i * length:(i + 1) * length]

        def found_in(texts: list[str]) -> set[tuple[int, int]]:
            joined = "".join(texts)
            if len(joined) < length:
                return set()
            hashed = _hashes(_codes(joined), length)
            places = np.flatnonzero(tried[hashed >> cut])
            at = np.searchsorted(known, hashed[places])
            hit = known[np.minimum(at, len(known) - 1)] == hashed[places]
            places, at = places[hit], at[hit]
            ends = np.cumsum([len(t) for t in texts])
            row = np.searchsorted(ends, places, "right")
            inside = places + length <= ends[row]
            _, first = np.unique(row[inside] << 32 | at[inside], return_index=True)
            out = set()
            for place, i, r in zip(*(x[inside][first].tolist() for x in (places, at, row))):
                said = joined[place:place + length]
                while i < len(known) and string(i) != said and known[i] == hashed[place]:  # strings of one hash stand together
                    i += 1
                if i < len(known) and string(i) == said:
                    out.add((r, i))
            return out

        for batch in batches:
            texts, size, at, found = [], 0, [], []
            for row, hay in enumerate([*batch.column(column), None]):
                text = None if hay is None else hay.as_py()
                if text is not None:
                    texts.append((row, text))
                    size += len(text)
                if texts and (size > AT_ONCE or hay is None):
                    for r, i in sorted(found_in([t for _, t in texts])):
                        at.append(texts[r][0])
                        found.append(string(i))
                    texts, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([kind] * len(at), pa.string()), pa.array(found, pa.string())], ["_key", "kind", "string"])

    return rows.mapInArrow(run, f"_key {kind_of_key}, kind string, string string")


def occurring(texts: DataFrame, key: str, hays: dict[str, Column], strings: DataFrame, most: int = SLICE_CHARS) -> DataFrame:
    """``(key, kind, string)``: each string of ``strings(kind, string)`` once for each row of ``texts`` whose ``hays[kind]`` holds
    it. A null hay holds nothing, the empty string is held by any other."""
    wanted = frozen(strings.select("kind", "string").where(F.col("string").isNotNull()).distinct())
    kinds = list(hays)
    rows = texts.select(F.col(key).alias("_key"), *[h.cast("string").alias(f"_{i}") for i, h in enumerate(hays.values())])
    kind_of_key = rows.schema["_key"].dataType.simpleString()
    out = None
    # lengths whose strings fill more than one automaton: at most as many as there are automata
    sizes = wanted.where(F.col("kind").isin(kinds) & (F.length("string") > 0)).groupBy("kind", F.length("string").alias("n")).agg(F.sum(F.length("string")).alias("size"))
    for r in sizes.where(F.col("size") > most).collect():
        same = (F.col("kind") == r["kind"]) & (F.length("string") == r["n"])
        for part in slices(wanted.where(same), max(most, HASHED_CHARS)):
            listed = part.select("string").toArrow().column(0).to_pylist()  # at most ``HASHED_CHARS`` characters
            if listed:
                hits = _windows(rows, 1 + kinds.index(r["kind"]), r["kind"], kind_of_key, listed, r["n"])
                out = hits if out is None else out.unionByName(hits)
        wanted = wanted.where(~same)
    for part in [] if out is not None and wanted.isEmpty() else slices(wanted, most):
        listed = [(kinds.index(r["kind"]), r["string"]) for r in part.collect() if r["kind"] in hays]  # at most ``most`` characters
        shared = texts.sparkSession.sparkContext.broadcast(listed)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automata = [ahocorasick.Automaton() for _ in kinds]
            always = [[] for _ in kinds]
            for kind, string in shared.value:
                if string:
                    automata[kind].add_word(string, string)
                else:
                    always[kind].append(string)
            for automaton in automata:
                if len(automaton):
                    automaton.make_automaton()
            for batch in batches:
                at, named, found = [], [], []
                for i, automaton in enumerate(automata):
                    if not len(automaton) and not always[i]:
                        continue
                    for row, hay in enumerate(batch.column(1 + i)):
                        text = hay.as_py()
                        if text is None:
                            continue
                        held = {s for _, s in automaton.iter(text)} if len(automaton) else set()
                        for string in (*held, *always[i]):
                            at.append(row)
                            named.append(kinds[i])
                            found.append(string)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(named, pa.string()), pa.array(found, pa.string())], ["_key", "kind", "string"])

        hits = rows.mapInArrow(run, f"_key {kind_of_key}, kind string, string string")
        out = hits if out is None else out.unionByName(hits)
    return out.withColumnRenamed("_key", key)
