"""Toxicity by a weighted finite-state grammar over clauses.

A clause is the words between two marks. Its words become symbols (insult, threat, target, negation, reported speech, other),
and the composition of five transducers reads the symbols: whether an insult stands there, whether a threat meets a target,
whether a target is addressed, whether a negation stands shortly before the insult, whether the clause reports another's
words. The state reached is the clause's kind. A text is known by its matched clauses: how heavy the heaviest is, how many different insults
stand in them, whether all are negated or reported. Its score is the logistic of the log odds of such texts, which without
evidence are those of its heaviest clause; a text without a matched clause has the log odds of such texts.

The insult lexicon (words, and stems of ``STEM_FROM`` or more letters with any ending) and the weights are learnt from
labelled texts: from at most about ``SAMPLE`` of them, chosen by a hash of the id, which is the bound of all that reaches the
driver. A feature is learnt if it is significantly more frequent in toxic texts, counting occurrences after different words, so
that words which merely come along in copies of a toxic text are not learnt; further ones are taken greedily, each for the
toxic texts that none before explains. Each has its own weight, and a clause weighs no more than its best insult. Function words of the other symbols are fixed lists.

Defined cases: a null or empty text, or one without words, is a text without a matched clause; ids labelled more than once
are toxic if any label says so; without toxic labels nothing is learnt and all texts score the same; repeated rows are scored
each; an empty table gives an empty table; other columns are carried along, and those that clash with a result column are
replaced. Language, source and labels are no inputs of a score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslink.llm.memory import tidy
from corpuslink.session import frozen

SAMPLE = 12_000
# features a task holds before it hands their counts on
HELD = 200_000
STEM_FROM, STEM_TO = 4, 8
# a feature is worth its newly explained toxic texts less COST times its clean ones, and is learnt if that is at least LEAST
# and SHARE of the toxic texts
LEAST, SHARE = 2, 0.005
COST = 1
LIMIT = 0.3
NEAR = 3

# Function words of English, German, French and Spanish.
TARGETS = frozenset("you your yours du dich dir dein deine ihr euch tu toi te vous votre tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie niemals pas jamais ni nunca jamás".split())
REPORTED = frozenset("said says say told called calls wrote sagte sagt nannte nennt schrieb dit disait appelle écrit dijo dice llamó llama escribió".split())
THREATS = frozenset("kill hurt destroy stab shoot töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split())
MARKS = re.compile(r"[.,;:!?\n\r]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """States from 0; ``arcs``: (state, symbol) -> state, all others stay; ``ends``: state -> output."""

    arcs: dict
    ends: dict

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), self.arcs.get((state, None), state))


def _negated() -> Transducer:
    """State 0: nothing near; 1 … NEAR: a negation within so many words; then: an insult so negated; then: a plain one."""
    denied, plain = NEAR + 1, NEAR + 2
    arcs = {(k, None): k - 1 for k in range(1, NEAR + 1)}
    for k in range(NEAR + 1):
        arcs[k, NEGATION] = NEAR
        arcs[k, INSULT] = denied if k else plain
    arcs[denied, INSULT] = plain
    return Transducer(arcs, {denied: "negated"})


PARTS = (
    Transducer({(0, INSULT): 1}, {1: "insult"}),
    Transducer({(0, THREAT): 1, (0, TARGET): 2, (1, TARGET): 3, (2, THREAT): 3}, {3: "threat"}),
    Transducer({(0, TARGET): 1}, {1: "target"}),
    _negated(),
    Transducer({(0, REPORT): 1}, {1: "reported"}),
)


def composed(parts: tuple[Transducer, ...] = PARTS) -> tuple[list[list[int]], list[tuple[str, ...]]]:
    """(next state by state and symbol, outputs by state) of the parts run side by side."""
    start = (0,) * len(parts)
    number, rows, outputs, todo = {start: 0}, [], [], [start]
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(6):
            after = tuple(p.step(s, symbol) for p, s in zip(parts, state, strict=True))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
        outputs.append(tuple(p.ends[s] for p, s in zip(parts, state, strict=True) if s in p.ends))
    return rows, outputs


NEXT, OUTPUTS = composed()
# what a clause loses while nothing is known of its kind, what a threat weighs, texts that a guess counts for
SOFTENED, THREATENS, GUESS = 2.0, 4.0, 2.0


def kind_of(outputs: tuple[str, ...]) -> str | None:
    """The clause's kind, None if it says nothing."""
    if "insult" not in outputs and "threat" not in outputs:
        return None
    return " ".join(outputs)


def softened(kind: str) -> bool:
    parts = kind.split()
    return "threat" not in parts and ("negated" in parts or "reported" in parts)


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@dataclass
class Grammar:
    """``words`` and ``stems``: weights of the insult lexicon. ``odds``: log odds by text cell. ``all`` and ``rest``: of all
    texts, and of those without a matched clause."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    odds: dict[tuple, float] = field(default_factory=dict)
    all: float = -2.0
    rest: float = -4.0

    def insult(self, word: str) -> tuple[float, str] | None:
        """The word's weight, if it or a stem of it is in the lexicon, and its name. A word speaks for itself before its
        stems do, and a stem is no stem of itself."""
        if word in self.words:
            return self.words[word], word
        return max(((self.stems[word[:k]], word) for k in range(STEM_FROM, min(len(word) - 1, STEM_TO) + 1) if word[:k] in self.stems), default=None)

    def symbol(self, word: str) -> int:
        return NEGATION if word in NEGATIONS else TARGET if word in TARGETS else REPORT if word in REPORTED else THREAT if word in THREATS else OTHER

    def triggers(self):
        """An automaton over the strings that a matched clause holds at least one of."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in {*self.words, *self.stems, *THREATS}:
            found.add_word(word, word)
        found.make_automaton()
        return found

    def clauses(self, text: str, triggers=None) -> dict[tuple[str, str], float]:
        """(kind, its heaviest insult) of the text's matched clauses -> that insult's weight. Without a trigger no
        clause can match."""
        low = text.lower()
        if triggers is not None and next(triggers.iter(low), None) is None:
            return {}
        out: dict[tuple[str, str], float] = {}
        for clause in MARKS.split(low):
            state, best = 0, (-math.inf, "")
            for word in WORD.findall(clause):
                entry = self.insult(word)
                best = best if entry is None else max(best, entry)
                state = NEXT[state][self.symbol(word) if entry is None else INSULT]
            kind = kind_of(OUTPUTS[state])
            if kind:
                out[kind, best[1]] = max(best[0], THREATENS) if "threat" in OUTPUTS[state] else best[0]
        return out

    def guess(self, clauses: dict[tuple[str, str], float]) -> float:
        """The log odds of a text before any of its cell has been seen."""
        return self.all + max(weight - SOFTENED * softened(kind) for (kind, _), weight in clauses.items())

    def score(self, clauses: dict[tuple[str, str], float]) -> float:
        if not clauses:
            return logistic(self.rest)
        return logistic(self.odds.get(cell(clauses), self.guess(clauses)))


def cell(clauses: dict[tuple[str, str], float]) -> tuple:
    """What a text is known by: (different insults up to 3, heaviest weight in whole numbers, whether all are softened)."""
    return min(3, len({name for _, name in clauses})), math.floor(min(8.0, max(clauses.values()))), all(softened(kind) for kind, _ in clauses)


def features(text: str) -> set[str]:
    """The words of a text, and their beginnings marked with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(STEM_FROM, min(len(w) - 1, STEM_TO) + 1)}


def sample(labelled: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """About ``bound`` of the labelled rows (id, text, toxic), the same ones every time; one of equal texts."""
    n = labelled.count()
    chosen = labelled if n <= bound else labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    rows = chosen.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return frozen(rows.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("key"))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): texts of either label with the feature, as far as some toxic text has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def summary() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())],
                                              ["feature", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[toxic == 1].update(features(text.as_py()))
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield summary()
                    counts = (Counter(), Counter())
        yield summary()

    counted = rows.select("text", "toxic").mapInArrow(tidy(run), "feature string, toxic bigint, clean bigint")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(labelled: DataFrame, bound: int = SAMPLE) -> Grammar:
    """The grammar learnt from (id, text, toxic)."""
    rows = sample(labelled, bound)
    totals = dict(rows.groupBy("toxic").count().collect())
    least = max(LEAST, math.ceil(SHARE * totals.get(1, 0)))
    counted = frozen(_counted(rows))
    good = counted.where(F.col("toxic") - COST * F.col("clean") >= least).where(~F.col("feature").rlike("[0-9]"))
    candidates = {r[0]: (r[1], r[2]) for r in good.collect()}
    if not candidates:
        return Grammar()
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(_in_context(t, shared.value)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["held"])

    held = [r[0] for r in rows.where("toxic = 1").select("text").mapInArrow(tidy(hold), "held array<string>").collect()]
    contexts = Counter(x.rpartition(" ")[0] for x in {x for text in held for x in text})
    texts = [{x.rpartition(" ")[0] for x in text} for text in held]
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    needed = math.log(max(2, counted.count())) + 2
    chosen = {c for c, (_, clean) in candidates.items() if _surprise(contexts[c], clean, share) >= needed}
    chosen |= set(_cover([t for t in texts if not t & chosen], {c: v[1] for c, v in candidates.items()}, least))
    base = math.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))
    odds = {c: math.log((candidates[c][0] + 0.5) / (candidates[c][1] + 0.5)) - base for c in chosen}
    stems = {c[:-1]: o for c, o in odds.items() if c[-1] == "*"}
    # words of a learnt stem have counts of their own, with the stem's as what is known without them
    own = counted.where(F.substring("feature", -1, 1) != "*").where(F.col("toxic") + F.col("clean") >= LEAST)
    begins = F.array(*(F.substring("feature", 1, k) for k in range(STEM_FROM, STEM_TO + 1)))
    own = own.where(F.arrays_overlap(begins, F.array(*(F.lit(x) for x in stems))) if stems else F.lit(False))
    words = {c: o for c, o in odds.items() if c[-1] != "*"}
    for name, toxic, clean in own.select("feature", "toxic", "clean").collect():
        known = max((stems[name[:k]] for k in range(STEM_FROM, min(len(name) - 1, STEM_TO) + 1) if name[:k] in stems), default=-base - 4)
        share = logistic(known + base)
        words[name] = math.log((toxic + GUESS * share) / (clean + GUESS * (1 - share))) - base
    grammar = Grammar(words, stems, all=base)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers = grammar.triggers()
        for batch in batches:
            found = [grammar.clauses(t, triggers) for t in batch.column(0).to_pylist()]
            known = [(*map(int, cell(f)), grammar.guess(f)) if f else (0, 0, 0, 0.0) for f in found]
            columns = [pa.array([k[i] for k in known], pa.int32() if i < 3 else pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["n", "heavy", "soft", "guess", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(tidy(cells), "n int, heavy int, soft int, guess double, toxic int")
    for n, heavy, soft, guess, toxic, clean in seen.groupBy("n", "heavy", "soft").agg(F.avg("guess"), F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect():
        share = logistic(guess) if n else 0.02
        value = math.log((toxic + GUESS * share) / (clean + GUESS * (1 - share)))
        if n:
            grammar.odds[n, heavy, bool(soft)] = value
        else:
            grammar.rest = value
    return grammar


def _in_context(text: str, wanted) -> set[str]:
    """The text's wanted features, each with the word before it."""
    out, before = set(), ""
    for word in WORD.findall(text.lower()):
        for name in (word, *(word[:k] + "*" for k in range(STEM_FROM, min(len(word) - 1, STEM_TO) + 1))):
            if name in wanted:
                out.add(f"{name} {before}")
        before = word
    return out


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Chernoff's bound on the negative log of the chance of so many toxic ones where ``share`` is expected."""
    n = toxic + clean
    if not 0 < share < 1 or not toxic or toxic / n <= share:
        return 0.0
    return toxic * math.log(toxic / n / share) + (clean * math.log(clean / n / (1 - share)) if clean else 0.0)


def _cover(texts: list[set[str]], clean: dict[str, int], least: int) -> list[str]:
    """Features taken greedily by the texts that they explain and none before did, less COST times their clean texts; of equal
    ones the longest, then whole words."""
    left = [t for t in texts if t]
    out = []
    while left:
        gain = Counter(f for t in left for f in t)
        worth = {f: n - COST * clean[f] for f, n in gain.items()}
        best = max(worth, key=lambda f: (worth[f], len(f.rstrip("*")), f[-1] != "*", f))
        if worth[best] < least:
            break
        out.append(best)
        left = [t for t in left if best not in t]
    return out


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, toxic) of the labelled rows that may be learnt from."""
    marks = labels.where(~held_out(id_col)).where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")


def scored(docs: DataFrame, grammar: Grammar, text_col: str = "text", keep_text: bool = True, limit: float = LIMIT) -> DataFrame:
    """``docs`` (without the text if ``keep_text`` is false) with score and predicted."""
    docs = docs.drop("score", "predicted")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers = grammar.triggers()
        for batch in batches:
            scores = [grammar.score(grammar.clauses(t.as_py() or "", triggers)) for t in batch.column(place)]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64()), pa.array([int(s >= limit) for s in scores], pa.int32())], [*names, "score", "predicted"])

    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return docs.mapInArrow(tidy(run), T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def not_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    return scored(docs, grammar, text_col).where("predicted = 0").select(*docs.columns)
