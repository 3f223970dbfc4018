"""Several raters of the same units on ordered categories.

Units rated alike are one *pattern*: the sorted list of (rater, grade) with the number of units. Every measure is a
function of the patterns, of which there are far fewer than units; EM rounds and resamples cost the same for any
number of units."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.functions.pvalues import poisson_draw
from corpuslink.functions.rules import chain_only, rating_group, second_group
from corpuslink.plans.ordered import top_within
from corpuslink.session import frozen

# Categories, the raters counted, resamples, seed, the agreement that makes two raters one voice.
K, LEAST, BOOT, SEED, ONE_VOICE = 5, 20, 300, 1405, 0.95


def first_ratings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first rating of each (rater, unit) as a group, and how many of a rater were of the chain only.
    ``raw(unit, rater, wording, place)``. A chain-only first rating is set aside, a wording of no group dropped."""
    first = raw.groupBy("unit", "rater").agg(F.min_by("wording", "place").alias("wording"))
    marked = first.withColumn("_only", chain_only(F.col("wording")))
    kept = marked.where("not _only").select("unit", "rater", rating_group(F.col("wording")).alias("grade"))
    return kept.where(F.col("grade").isNotNull()), marked.where("_only").groupBy("rater").agg(F.count(F.lit(1)).alias("chain_only"))


def first_second_ratings(raw: DataFrame) -> DataFrame:
    """The first readable rating of each (rater, unit) on the second scale."""
    read = raw.withColumn("grade", second_group(F.col("wording"))).where(F.col("grade").isNotNull())
    return read.groupBy("unit", "rater").agg(F.min_by("grade", "place").alias("grade"))


def patterns(ratings: DataFrame) -> DataFrame:
    """``(pattern, votes, n)``: how many units were rated in each way. A unit's list is as long as its raters."""
    votes = F.sort_array(F.collect_list(F.struct(F.col("rater").cast("string").alias("rater"), F.col("grade").cast("int").alias("grade"))))
    units = ratings.groupBy("unit").agg(votes.alias("votes"))
    return (units.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pattern", F.concat_ws(",", F.transform("votes", lambda v: F.concat_ws(":", v["rater"], v["grade"].cast("string"))))))


def pair_tables(patterns_: DataFrame) -> DataFrame:
    """``(a, b, i, j, n)``: for every two raters how often a gave i and b gave j."""
    left = patterns_.select("n", "votes", F.posexplode("votes").alias("_p", "x"))
    both = left.select("n", "x", F.explode(F.slice("votes", F.col("_p") + 2, F.size("votes"))).alias("y"))
    return both.groupBy(F.col("x.rater").alias("a"), F.col("y.rater").alias("b"), F.col("x.grade").alias("i"),
                        F.col("y.grade").alias("j")).agg(F.sum("n").alias("n"))


def agreement(tables: DataFrame, by: list[str], least: int = LEAST, weight: str = "n") -> DataFrame:
    """Per group of a K × K table: common, share equal, Cohen's κ, quadratic κ, within one, order difference."""
    w, i, j = F.col(weight), F.col("i"), F.col("j")
    total = lambda keep: F.sum(F.when(keep, w).otherwise(0)).cast("double")
    rows = tables.groupBy(*by).agg(
        F.sum(w).cast("double").alias("_n"), total(i == j).alias("_eq"), total(F.abs(i - j) <= 1).alias("_one"),
        total(i < j).alias("_lower"), total(i > j).alias("_higher"), F.sum(w * F.pow((i - j) / (K - 1), F.lit(2))).alias("_do"),
        *[total(i == k).alias(f"_a{k}") for k in range(K)], *[total(j == k).alias(f"_b{k}") for k in range(K)])
    n = F.col("_n")
    add = lambda terms: reduce(lambda x, y: x + y, terms)
    pe = add([F.col(f"_a{k}") * F.col(f"_b{k}") for k in range(K)]) / (n * n)
    de = add([F.col(f"_a{k}") * F.col(f"_b{m}") * ((k - m) / (K - 1)) ** 2 for k in range(K) for m in range(K) if k != m]) / (n * n)
    po = F.col("_eq") / n
    return rows.where(n >= least).select(
        *by, n.cast("long").alias("common"), po.alias("agree"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"),
        F.when(de > 0, 1 - F.col("_do") / n / de).otherwise(1.0).alias("wkappa"), (F.col("_one") / n).alias("within_one"),
        ((F.col("_lower") - F.col("_higher")) / n).alias("order"))


def resampled(cells: DataFrame, keys: list[str], weight: str = "n", replicates: int = BOOT, seed: int = SEED) -> DataFrame:
    """``cells`` once per replicate with a resampled ``weight`` (A13): a unit drawn with replacement is a Poisson weight
    of its cell, so a resample costs a cell, not a unit. The draw is a hash of seed, replicate and cell: repeatable."""
    reps = cells.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    hashed = F.pmod(F.xxhash64(F.lit(seed), "rep", *keys), F.lit(1 << 52)) / float(1 << 52)
    drawn = cells.crossJoin(reps).withColumn(weight, poisson_draw(F.col(weight).cast("double"), hashed))  # a fixed number of replicates
    return drawn.where(F.col(weight) > 0)


def interval(values: DataFrame, by: list[str], column: str, least: int = 20, high_minus_one: bool = False) -> DataFrame:
    """The 95% percentile interval of a statistic over its replicates, by the two index rules in use (A13, I2). The
    list is as long as there are replicates."""
    v = F.sort_array(F.collect_list(column))
    listed = values.where(F.col(column).isNotNull()).groupBy(*by).agg(v.alias("_v"))
    size = F.size("_v")
    low = F.floor(0.025 * (size if high_minus_one else size - 1)).cast("int")
    high = (F.floor(0.975 * size) - 1 if high_minus_one else F.floor(0.975 * (size - 1))).cast("int")
    return listed.where(size >= least).select(*by, F.get("_v", low).alias(f"{column}_low"), F.get("_v", high).alias(f"{column}_high"))


def agreement_intervals(tables: DataFrame, replicates: int = BOOT, least: int = LEAST) -> DataFrame:
    """Agreement of every two raters with 95% intervals."""
    out = agreement(tables, ["a", "b"], least)
    draws = frozen(agreement(resampled(tables, ["a", "b", "i", "j"], replicates=replicates), ["a", "b", "rep"], 1))
    for measure in ("agree", "kappa", "wkappa", "order"):
        out = out.join(interval(draws, ["a", "b"], measure), ["a", "b"], "left")
    return out


# ------------------------------------------------------------------ association of an ordered table
def kendall(cells: DataFrame, by: list[str], weight: str = "n") -> DataFrame:
    """Kendall's τ-b, Goodman–Kruskal's γ and Somers' D of an ordered table (A12, I13): ``cells(…by, row, col, n)``. The
    pairs are of cells of one table, never of cases."""
    base = cells.groupBy(*by, "row", "col").agg(F.sum(weight).cast("double").alias("n"))
    other = base.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("n").alias("_m"))
    same = [base[c].eqNullSafe(other[f"_{c}"]) for c in by]
    condition = reduce(lambda a, b: a & b, same, F.col("row") < F.col("_row"))
    pairs = base.join(other, condition).groupBy(*by).agg(
        F.sum(F.when(F.col("_col") > F.col("col"), F.col("n") * F.col("_m")).otherwise(0.0)).alias("_c"),
        F.sum(F.when(F.col("_col") < F.col("col"), F.col("n") * F.col("_m")).otherwise(0.0)).alias("_d"))

    def ties(side: str, name: str) -> DataFrame:
        sums = base.groupBy(*by, side).agg(F.sum("n").alias("_s"))
        return sums.groupBy(*by).agg(F.sum(F.col("_s") * (F.col("_s") - 1) / 2).alias(name), F.sum("_s").alias(f"_n{side}"))

    rows = ties("row", "_tr").withColumnRenamed("_nrow", "n")
    right = ties("col", "_tc").drop("_ncol")
    if by:
        rows = rows.join(right, by).join(pairs, by, "left")
    else:
        rows = rows.crossJoin(right).crossJoin(pairs)  # one row each
    rows = rows.na.fill(0.0, ["_c", "_d"])
    c, d, every = F.col("_c"), F.col("_d"), F.col("n") * (F.col("n") - 1) / 2
    denominator = F.sqrt((every - F.col("_tr")) * (every - F.col("_tc")))
    return rows.select(*by, F.col("n").cast("long").alias("n"), F.when(denominator > 0, (c - d) / denominator).alias("tau"),
                       F.when(c + d > 0, (c - d) / (c + d)).alias("gamma"),
                       F.when(every - F.col("_tr") > 0, (c - d) / (every - F.col("_tr"))).alias("somers_d"))


def association(cells: DataFrame, by: list[str], replicates: int = 200, least: int = 10) -> DataFrame:
    """τ-b and γ of every table with at least ten cases, and 95% intervals from thirty on."""
    cells = frozen(cells)
    out = kendall(cells, by).where(F.col("n") >= least)
    draws = frozen(kendall(resampled(cells, [*by, "row", "col"], replicates=replicates), [*by, "rep"]))
    for measure in ("tau", "gamma"):
        out = out.join(interval(draws, by, measure, high_minus_one=True), by, "left")
        for end in ("low", "high"):
            out = out.withColumn(f"{measure}_{end}", F.when(F.col("n") >= 30, F.col(f"{measure}_{end}")))
    return out


# ------------------------------------------------------------------ Krippendorff's alpha
def coincidences(patterns_: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``(i, j, w)``: ordered pairs of grades of a unit, weighted 1/(m − 1)."""
    many = patterns_.where(F.size("votes") >= 2).withColumn("_w", F.col("n") / (F.size("votes") - 1))
    left = many.select(*(extra or []), "_w", "votes", F.posexplode("votes").alias("_p", "x"))
    both = left.select(*(extra or []), "_w", "_p", "x", F.posexplode("votes").alias("_q", "y")).where("_p <> _q")
    return both.groupBy(*(extra or []), F.col("x.grade").alias("i"), F.col("y.grade").alias("j")).agg(F.sum("_w").alias("w"))


def _alpha(table: np.ndarray) -> float | None:
    """α with the ordinal metric from one K × K coincidence table."""
    n = table.sum(axis=1)
    total = n.sum()
    if total <= 1:
        return None
    upto = np.concatenate([[0.0], np.cumsum(n)])
    low, high = np.minimum.outer(range(K), range(K)), np.maximum.outer(range(K), range(K))
    distance = (upto[high + 1] - upto[low] - np.add.outer(n, n) / 2) ** 2
    np.fill_diagonal(distance, 0.0)
    expected = (np.outer(n, n) * distance).sum() / (total - 1)
    return float(1 - (table * distance).sum() / expected) if expected > 0 else None


def alpha_of(coincidence: DataFrame, by: list[str]) -> DataFrame:
    """Krippendorff's α from coincidence tables of K × K cells."""
    def one(cells: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((K, K))
        np.add.at(table, (cells["i"].to_numpy(int), cells["j"].to_numpy(int)), cells["w"].to_numpy(float))
        return pd.DataFrame([[*cells[by].iloc[0], _alpha(table)]], columns=[*by, "alpha"])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in coincidence.schema.fields if f.name in by] + ["alpha double"])
    return coincidence.withColumn("_one", F.lit(1)).groupBy(*(by or ["_one"])).applyInPandas(one, types)


def krippendorff(patterns_: DataFrame, replicates: int = BOOT // 3) -> DataFrame:
    """α with its 95% interval and the units it rests on (I3): the resamples are of patterns."""
    many = frozen(patterns_.where(F.size("votes") >= 2))
    value = alpha_of(coincidences(many), [])
    units = many.agg(F.sum("n").alias("units"))
    draws = alpha_of(coincidences(resampled(many, ["pattern"], replicates=replicates), ["rep"]), ["rep"]).withColumn("_one", F.lit(1))
    return value.crossJoin(units).crossJoin(interval(draws, ["_one"], "alpha").drop("_one"))  # one row each


# ------------------------------------------------------------------ Dawid–Skene
class DawidSkene:
    """The fitted model: ``prior[k]``, ``theta[rater][k][grade]``, the log-likelihood and the rounds taken."""

    def __init__(self, prior: list[float], theta: dict[str, list[list[float]]], loglik: float, rounds: int):
        self.prior, self.theta, self.loglik, self.rounds = prior, theta, loglik, rounds

    def strictness(self) -> dict[str, float]:
        """P(graded above the true grade) − P(below) of each rater; negative is stricter."""
        above = lambda t, sign: sum(self.prior[k] * t[k][g] for k in range(K) for g in range(K) if (g - k) * sign > 0)
        return {r: above(t, 1) - above(t, -1) for r, t in self.theta.items()}


def posterior(prior: list[float], theta: dict[str, list[list[float]]]) -> Column:
    """The probabilities of each true grade before scaling, as an array column over ``votes``."""
    likelihood = F.create_map(*[x for r, t in sorted(theta.items()) for g in range(K) for x in (
        F.lit(f"{r}:{g}"), F.array(*[F.lit(float(t[k][g])) for k in range(K)]))])
    start = F.array(*[F.lit(max(p, 1e-12)) for p in prior])
    return F.aggregate("votes", start, lambda a, v: F.zip_with(
        a, likelihood[F.concat_ws(":", v["rater"], v["grade"].cast("string"))], lambda x, y: x * y))


def _expected_counts(data: DataFrame, raters: list[str], reps: list[int], models: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over ``data(weights, raters, grades)`` for the replicates ``reps``: their log-likelihoods, Σ p(k) and each
    rater's expected counts. A batch of patterns is one matrix of votes; the probabilities under all models and the counts are
    two matrix products. Without models the votes' own shares stand for the probabilities. A task hands on one array, and arrays
    are added in two steps."""
    place, n, a = {r: i for i, r in enumerate(raters)}, len(raters), len(reps)
    size = a * (1 + K + n * K * K)
    if models is not None:
        priors = np.log(np.maximum(models[0], 1e-12))
        logs = np.log(models[1]).transpose(1, 3, 0, 2).reshape(n * K, a * K)

    def share(batch: pa.RecordBatch) -> np.ndarray:
        sizes = pa.compute.list_value_length(batch.column("raters")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(batch)), sizes)
        who = np.array([place[r] for r in batch.column("raters").flatten().to_pylist()], int)
        votes = np.zeros((len(batch), n * K))
        np.add.at(votes, (row, who * K + batch.column("grades").flatten().to_numpy()), 1)
        weight = batch.column("weights").flatten().to_numpy().reshape(len(batch), -1)[:, reps]
        if models is None:
            p = np.repeat((votes.reshape(-1, n, K).sum(axis=1) / sizes[:, None])[:, None, :], a, axis=1)
            loglik = np.zeros(a)
        else:
            p = (votes @ logs).reshape(-1, a, K) + priors
            top = p.max(axis=2, keepdims=True)
            p = np.exp(p - top)
            total = p.sum(axis=2, keepdims=True)
            loglik = (weight * (np.log(total) + top)[:, :, 0]).sum(axis=0)
            p = p / total
        p = p * weight[:, :, None]
        counts = (votes.T @ p.reshape(-1, a * K)).reshape(n, K, a, K).transpose(2, 0, 3, 1)
        return np.concatenate([loglik, p.sum(axis=0).ravel(), counts.ravel()])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((share(b) for b in batches if len(b)), np.zeros(size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["share"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py()) for b in batches for x in b.column(0)), np.zeros(size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["share"])

    parts = max(1, math.isqrt(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = data.mapInArrow(first, "share binary").repartition(parts).mapInArrow(second, "share binary").collect()  # a few arrays
    flat = sum((np.frombuffer(r[0]) for r in rows), np.zeros(size))
    return flat[:a], flat[a:a + a * K].reshape(a, K), flat[a + a * K:].reshape(a, n, K, K)


def fit_all(data: DataFrame, limits: list[tuple[int, float]]) -> dict[int, DawidSkene]:
    """The models of all replicates of ``data(votes, weights)`` at once (I4, I5): ``weights`` holds a pattern's weight in each
    replicate, ``limits`` each one's most rounds and tolerance. One pass a round over the patterns; what returns is replicates ×
    raters × K² numbers. A replicate whose likelihood stands is left as it is; one without any weight has no model."""
    rows = frozen(data.select("weights", F.transform("votes", lambda v: v["rater"].cast("string")).alias("raters"),
                              F.transform("votes", lambda v: v["grade"].cast("int")).alias("grades")))
    raters = sorted(r[0] for r in rows.select(F.explode("raters")).distinct().collect())
    found: dict[int, DawidSkene] = {}
    reps, models, before, turn = list(range(len(limits))), None, {}, 0
    while reps and raters:
        loglik, shares, counts = _expected_counts(rows, raters, reps, models)
        going = []
        for i, rep in enumerate(reps):
            if models is not None:
                found[rep] = DawidSkene(models[0][i].tolist(), {r: models[1][i, j].tolist() for j, r in enumerate(raters)}, float(loglik[i]), turn)
                rounds, tolerance = limits[rep]
                if turn >= rounds or (rep in before and abs(loglik[i] - before[rep]) < tolerance * abs(before[rep])):
                    continue
                before[rep] = loglik[i]
            if shares[i].sum() > 0:
                going.append(i)
        turn += 1
        counts = counts[going] + 0.5
        models = (shares[going] / shares[going].sum(axis=1, keepdims=True), counts / counts.sum(axis=3, keepdims=True))
        reps = [reps[i] for i in going]
    return found


def dawid_skene(patterns_: DataFrame, iterations: int = 200, tolerance: float = 1e-6) -> DawidSkene:
    """EM for the raters' confusion matrices (I4): soft-majority start, +0.5 smoothing, until the likelihood stands."""
    return fit_all(patterns_.withColumn("weights", F.array(F.col("n").cast("double"))), [(iterations, tolerance)])[0]


def with_posterior(patterns_: DataFrame, model: DawidSkene) -> DataFrame:
    """The patterns with ``p``: the probability of each true grade."""
    rows = patterns_.withColumn("_w", posterior(model.prior, model.theta))
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", F.transform("_w", lambda x: x / total)).drop("_w")


def consensus(patterns_: DataFrame, model: DawidSkene) -> tuple[DataFrame, DataFrame]:
    """Units by most probable grade, and by how certain it is."""
    rows = with_posterior(patterns_, model).withColumn("certainty", F.array_max("p")).withColumn(
        "consensus", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    band = F.when(F.col("certainty") >= 0.95, "high").when(F.col("certainty") >= 0.6, "middle").otherwise("low")
    return (rows.groupBy("consensus").agg(F.sum("n").alias("units")), rows.groupBy(band.alias("band")).agg(F.sum("n").alias("units")))


def disputed(ratings: DataFrame, patterns_: DataFrame, model: DawidSkene, k: int = 300) -> DataFrame:
    """The units whose raters are two grades apart or leave the model unsure, widest apart first."""
    rows = with_posterior(patterns_, model)
    grades = F.transform("votes", lambda v: v["grade"])
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0)) / math.log(K)
    rows = (rows.withColumn("spread", F.array_max(grades) - F.array_min(grades)).withColumn("certainty", F.array_max("p"))
            .withColumn("entropy", entropy).withColumn("consensus", (F.array_position("p", F.array_max("p")) - 1).cast("int")))
    hot = rows.where((F.size("votes") >= 2) & ((F.col("spread") >= 2) | (F.col("certainty") < 0.6)))
    votes = F.sort_array(F.collect_list(F.struct(F.col("rater").cast("string").alias("rater"), F.col("grade").cast("int").alias("grade"))))
    units = ratings.groupBy("unit").agg(votes.alias("votes"))
    return (units.join(hot.select("votes", "pattern", "spread", "certainty", "entropy", "consensus"), "votes")
            .select("unit", "pattern", "spread", "certainty", "entropy", "consensus").orderBy(F.desc("spread"), "certainty", "unit").limit(k))


def one_voice(pairs: DataFrame, counts: DataFrame, threshold: float = ONE_VOICE) -> DataFrame:
    """Raters so alike that they are one voice (I6): ``(kept, left_out, agree)``; the one with more ratings is kept."""
    n = lambda side: counts.select(F.col("rater").cast("string").alias(side), F.col("ratings").alias(f"_n{side}"))
    rows = pairs.where(F.col("agree") >= threshold).join(n("a"), "a").join(n("b"), "b")
    first = F.col("_na") >= F.col("_nb")
    return rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("kept"),
                       F.when(first, F.col("b")).otherwise(F.col("a")).alias("left_out"), "agree")


def without_raters(patterns_: DataFrame, left_out: list[str]) -> DataFrame:
    """The patterns of the raters kept."""
    kept = patterns_.withColumn("votes", F.filter("votes", lambda v: ~v["rater"].isin(left_out))).where(F.size("votes") > 0)
    label = F.concat_ws(",", F.transform("votes", lambda v: F.concat_ws(":", v["rater"], v["grade"].cast("string"))))
    return kept.groupBy("votes").agg(F.sum("n").alias("n")).withColumn("pattern", label)


def measured_against(patterns_: DataFrame, model: DawidSkene, raters: list[str]) -> DawidSkene:
    """The model with further raters' matrices measured against it, not moving it."""
    kept = F.filter("votes", lambda v: ~v["rater"].isin(raters))
    others = F.filter("votes", lambda v: v["rater"].isin(raters))
    rows = with_posterior(patterns_.select("n", kept.alias("votes"), others.alias("_o")).where(F.size("votes") > 0), model)
    sums = (rows.select("n", "p", F.explode("_o").alias("v")).groupBy("v.rater", "v.grade")
            .agg(*[F.sum(F.col("n") * F.col("p")[k]).alias(f"p{k}") for k in range(K)]).collect())
    counts: dict[str, np.ndarray] = {}
    for row in sums:
        counts.setdefault(row["rater"], np.full((K, K), 0.5))[:, row["grade"]] += [row[f"p{k}"] for k in range(K)]
    extra = {r: (m / m.sum(axis=1, keepdims=True)).tolist() for r, m in counts.items()}
    return DawidSkene(model.prior, {**model.theta, **extra}, model.loglik, model.rounds)


def strictness(patterns_: DataFrame, refits: int = 40, seed: int = SEED) -> DataFrame:
    """Strictness of every rater with its 95% interval from refits on resampled units (I5). The fit on all units and the refits
    are the replicates of one estimation: a pattern carries its resampled weights as an array."""
    spark = patterns_.sparkSession
    n = F.col("n").cast("double")
    draw = lambda rep: poisson_draw(n, F.pmod(F.xxhash64(F.lit(seed), F.lit(rep).cast("long"), "pattern"), F.lit(1 << 52)) / float(1 << 52)).cast("double")
    drawn = [draw(rep) for rep in range(refits)]
    fits = fit_all(patterns_.withColumn("weights", F.array(n, *drawn)), [(200, 1e-6)] + [(60, 1e-5)] * refits)
    out = spark.createDataFrame(sorted(fits[0].strictness().items()), "rater string, strictness double")
    found = [(rep, r, v) for rep, model in fits.items() if rep for r, v in model.strictness().items()]
    if not found:
        return out
    draws = spark.createDataFrame(found, "rep int, rater string, strictness double")
    return out.join(interval(draws, ["rater"], "strictness", least=1), "rater", "left")


# ------------------------------------------------------------------ selections and profiles
def rater_kinds(ratings: DataFrame, least: int = LEAST) -> DataFrame:
    """Each rater with the number of ratings and whether it is few (named only), a selection (one grade only) or a
    rater (I8)."""
    rows = ratings.groupBy("rater").agg(F.count(F.lit(1)).alias("ratings"), F.min("grade").alias("_low"), F.max("grade").alias("_high"))
    kind = F.when(F.col("ratings") < least, "few").when(F.col("_low") == F.col("_high"), "selection").otherwise("rater")
    return rows.select("rater", "ratings", kind.alias("kind"))


def selections(ratings: DataFrame, kinds: DataFrame) -> DataFrame:
    """How the others grade the units a one-grade rater selected (I8): ``(selection, rater, grade, units)``."""
    chosen = ratings.join(kinds.where("kind = 'selection'").select("rater"), "rater").select("unit", F.col("rater").alias("selection"))
    others = ratings.join(kinds.where("kind <> 'few'").select("rater"), "rater")
    return (chosen.join(others, "unit").where(F.col("selection") != F.col("rater")).groupBy("selection", "rater", "grade")
            .agg(F.count(F.lit(1)).alias("units")))


def rater_wordings(raw: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest wordings of each rater (A16). ``raw(rater, wording)``."""
    counts = raw.groupBy("rater", "wording").agg(F.count(F.lit(1)).alias("ratings"))
    return top_within(counts, ["rater"], [F.desc("ratings"), F.asc("wording")], k)


def rater_profile(tables: DataFrame, least: int = LEAST) -> DataFrame:
    """Each rater beside each other (A16): agreement, within one, κ, and how often lower and higher."""
    both = tables.union(tables.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    shares = both.groupBy("a", "b").agg((F.sum(F.when(F.col("i") < F.col("j"), F.col("n")).otherwise(0)) / F.sum("n")).alias("lower"),
                                        (F.sum(F.when(F.col("i") > F.col("j"), F.col("n")).otherwise(0)) / F.sum("n")).alias("higher"))
    return agreement(both, ["a", "b"], least).drop("wkappa", "order").join(shares, ["a", "b"])
