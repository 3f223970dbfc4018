"""Rank correlations and rank tests.

Equal values are counted before they are ranked: a rank is a running total over different values. Columns for many
variables or pairs are long tables keyed by pair, so one plan serves all of them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslink.functions.pvalues import benjamini_hochberg, chi2_p, chi2_tail, holm, normal_p, t_p, t_tails
from corpuslink.plans.ordered import running_total


def value_ranks(values: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """``(…by, value, t, rank)``: how often each value occurs in its group and its average rank."""
    counts = values.groupBy(*by, value).agg(F.sum(weight).alias("t"))
    placed = running_total(counts, by, [F.col(value)], F.col("t"), "_upto")
    return placed.withColumn("rank", F.col("_upto") - (F.col("t") - 1) / 2).drop("_upto")


def average_rank(rows: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """``rows`` with the average rank of ``value`` in its group."""
    known = rows.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1))
    return rows.join(value_ranks(known, by, value, "_one").drop("t").withColumnRenamed("rank", name), [*by, value], "left")


def pair_values(rows: DataFrame, variables: list[str]) -> DataFrame:
    """``(a, b, x, y, w)``: every two variables with their values where both are known, equal rows as one."""
    grouped = rows.groupBy(*variables).agg(F.count(F.lit(1)).alias("_w"))
    every = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                      for a, b in combinations(variables, 2)])
    return (grouped.select("_w", F.explode(every).alias("p")).select("p.*", "_w").where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy("a", "b", "x", "y").agg(F.sum("_w").alias("w")))


def rank_correlations(pairs: DataFrame) -> DataFrame:
    """ρ of each pair from its values: the correlation of average ranks (I16)."""
    rank = lambda v, name: value_ranks(pairs, ["a", "b"], v, "w").select("a", "b", v, F.col("rank").alias(name))
    ranked = pairs.join(rank("x", "rx"), ["a", "b", "x"]).join(rank("y", "ry"), ["a", "b", "y"])
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy("a", "b").agg(
        F.sum("w").alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    return sums.select("a", "b", F.col("n").cast("long").alias("n"), rho.alias("rho"))


def spearman(rows: DataFrame, variables: list[str], least: int = 10) -> DataFrame:
    """Spearman's ρ of every two variables on the cases that have both, with p and the BH q over the pairs (I16)."""
    out = rank_correlations(pair_values(rows, variables))
    rho = F.when(F.col("n") >= least, F.col("rho"))
    t = rho * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - rho * rho))
    tested = out.withColumn("rho", rho).withColumn("p", t_p(t, F.col("n").cast("double") - 2))
    return benjamini_hochberg(tested.withColumn("_all", F.lit(1)).withColumn("_k", F.concat_ws("|", "a", "b")), ["_all"], "p", "_k").drop("_all", "_k")


def partial_correlations(rows: DataFrame, variables: list[str]) -> DataFrame | None:
    """Each pair with all the others held equal, on the complete cases (I17). Spark makes the k × k matrix of rank
    correlations; its inverse is numpy's. Null when there are too few cases or variables."""
    complete = rows.dropna(subset=variables)
    found = rank_correlations(pair_values(complete, variables)).collect()  # k(k−1)/2 rows
    if not found or found[0]["n"] <= len(variables) + 10:
        return None
    n = found[0]["n"]
    flat = {v for v in variables if all(r["rho"] is None for r in found if v in (r["a"], r["b"]))}
    keep = [v for v in variables if v not in flat]
    if len(keep) < 3:
        return None
    matrix = np.eye(len(keep))
    for r in found:
        if r["a"] in keep and r["b"] in keep:
            i, j = keep.index(r["a"]), keep.index(r["b"])
            matrix[i, j] = matrix[j, i] = r["rho"] or 0.0
    try:
        inverse = np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        return None
    df = n - len(keep)
    out = []
    for i, j in combinations(range(len(keep)), 2):
        scale = np.sqrt(abs(inverse[i, i] * inverse[j, j]))
        r = float(np.clip(-inverse[i, j] / scale, -1, 1)) if scale else 0.0
        out.append((keep[i], keep[j], n, r, t_tails(r * np.sqrt(df / max(1e-12, 1 - r * r)), df)))
    result = rows.sparkSession.createDataFrame(out, "a string, b string, n long, rho double, p double")
    result = result.withColumn("_all", F.lit(1)).withColumn("_k", F.concat_ws("|", "a", "b"))
    return benjamini_hochberg(result, ["_all"], "p", "_k").drop("_all", "_k")


def adjusted(rows: DataFrame, factors: list[str], outcome: str) -> DataFrame | None:
    """Each factor against one outcome with every other factor held equal, BH over the factors."""
    found = partial_correlations(rows, [*factors, outcome])
    if found is None:
        return None
    mine = found.where((F.col("a") == outcome) | (F.col("b") == outcome)).select(
        F.when(F.col("a") == outcome, F.col("b")).otherwise(F.col("a")).alias("factor"), F.lit(outcome).alias("outcome"), "n", "rho", "p")
    return benjamini_hochberg(mine, ["outcome"], "p", "factor")


def kruskal(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Kruskal–Wallis H with ties corrected, its p and ε²."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("w"))
    ranks = value_ranks(counts, by, value, "w")
    per_group = (counts.join(ranks.drop("t"), [*by, value]).groupBy(*by, group)
                 .agg(F.sum(F.col("w") * F.col("rank")).alias("_r"), F.sum("w").cast("double").alias("_m")))
    ties = ranks.groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("_ties"))
    sums = per_group.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_m")).alias("_h"), F.sum("_m").alias("_n"),
                                      F.count(F.lit(1)).alias("_g"))
    both = sums.join(ties, by) if by else sums.crossJoin(ties)  # one row each
    n = F.col("_n")
    h = 12 / (n * (n + 1)) * F.col("_h") - 3 * (n + 1)
    correction = 1 - F.col("_ties") / (n * n * n - n)
    out = both.where("_g >= 2").select(*by, n.cast("long").alias("n"), (F.col("_g") - 1).cast("int").alias("df"),
                                       F.when(correction > 0, h / correction).otherwise(0.0).alias("h"))
    return out.withColumn("epsilon2", F.col("h") / (F.col("n") - 1)).withColumn("p", chi2_p("h", F.col("df").cast("double")))


def mann_whitney(rows: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """Every two groups (a handful of collections): U, z, p with Holm's adjustment, and Cliff's δ."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).cast("double").alias("w"))
    sizes = counts.groupBy(group).agg(F.sum("w").alias("n"))
    side = lambda s, n: sizes.select(F.col(group).alias(s), F.col("n").alias(n))
    pairs = side("a", "n1").crossJoin(side("b", "n2")).where("a < b")  # groups, not rows
    first = pairs.join(counts.withColumnRenamed(group, "a"), "a").select("a", "b", value, F.col("w").alias("_a"), F.lit(0.0).alias("_b"))
    second = pairs.join(counts.withColumnRenamed(group, "b"), "b").select("a", "b", value, F.lit(0.0), "w")
    table = first.union(second).groupBy("a", "b", value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    placed = running_total(table, ["a", "b"], [F.col(value)], F.col("_b"), "_upto")
    both = F.col("_a") + F.col("_b")
    sums = placed.groupBy("a", "b").agg(F.sum(F.col("_a") * (F.col("_upto") - F.col("_b") / 2)).alias("u"),
                                        F.sum(both * both * both - both).alias("_ties")).join(pairs, ["a", "b"])
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    z = F.when(var > 0, (F.col("u") - n1 * n2 / 2) / F.sqrt(var)).otherwise(0.0)
    out = sums.where((n1 >= least) & (n2 >= least)).select(
        "a", "b", "u", z.alias("z"), (2 * F.col("u") / (n1 * n2) - 1).alias("delta"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"))
    tested = out.withColumn("p", normal_p("z")).withColumn("_all", F.lit(1)).withColumn("_k", F.concat_ws("|", "a", "b"))
    return holm(tested, ["_all"], "p", "_k").drop("_all", "_k")


def stuart_maxwell(tables: DataFrame, categories: int, least: int = 30) -> DataFrame:
    """Are two raters' distributions of grades the same (I20)? ``tables(a, b, i, j, n)``; one χ² per pair with Holm's
    adjustment. A pair's table has K² cells; its small system is solved with numpy inside the task."""
    import pandas as pd

    def solve(key, cells: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((categories, categories))
        np.add.at(table, (cells["i"].to_numpy(int), cells["j"].to_numpy(int)), cells["n"].to_numpy(float))
        keep = np.flatnonzero(table.sum(0) + table.sum(1) > 0)
        t = table[np.ix_(keep, keep)]
        m = len(keep)
        stronger, weaker = int(np.triu(table, 1).sum()), int(np.tril(table, -1).sum())
        if m < 2 or table.sum() < least:
            return pd.DataFrame(columns=["a", "b", "n", "a_stronger", "a_weaker", "chi2", "df", "p"])
        rows, cols = t.sum(1), t.sum(0)
        d = (rows - cols)[:-1]
        s = -(t + t.T)
        s[np.diag_indices(m)] = rows + cols - 2 * np.diag(t)
        try:
            x = float(d @ np.linalg.solve(s[:-1, :-1], d))
        except np.linalg.LinAlgError:
            return pd.DataFrame(columns=["a", "b", "n", "a_stronger", "a_weaker", "chi2", "df", "p"])
        return pd.DataFrame([(key[0], key[1], int(table.sum()), stronger, weaker, x, m - 1, chi2_tail(x, m - 1))],
                            columns=["a", "b", "n", "a_stronger", "a_weaker", "chi2", "df", "p"])

    small = tables.groupBy("a", "b", "i", "j").agg(F.sum("n").alias("n"))
    out = small.groupBy("a", "b").applyInPandas(solve, "a string, b string, n long, a_stronger long, a_weaker long, chi2 double, df int, p double")
    tested = out.withColumn("_all", F.lit(1)).withColumn("_k", F.concat_ws("|", "a", "b"))
    return holm(tested, ["_all"], "p", "_k").drop("_all", "_k")


def varying(rows: DataFrame, columns: list[str], least: int = 1) -> list[str]:
    """The columns that vary and are known often enough (I22): one row of counts comes back."""
    facts = rows.agg(*[F.min(c).alias(f"{c}_low") for c in columns], *[F.max(c).alias(f"{c}_high") for c in columns],
                     *[F.count(c).alias(f"{c}_n") for c in columns]).head()
    return [c for c in columns if facts[f"{c}_n"] >= least and facts[f"{c}_low"] != facts[f"{c}_high"]]


def unit_lab(features: DataFrame, ratings: DataFrame, places: DataFrame, raters: list, grade_place) -> DataFrame:
    """The units as columns (I22): factors, place in the collection (0–1), each rater's grade place, and how many grades
    apart the raters are. ``places(report_id, place)``; ``grade_place`` turns a grade into its place."""
    graded = ratings.where(F.col("rater").isin(raters)).withColumn("_g", grade_place(F.col("grade")))
    wide = graded.groupBy("report_id").agg(
        *[F.min(F.when(F.col("rater") == r, F.col("_g"))).alias(f"grade_{r}") for r in raters],
        F.when(F.count("_g") >= 2, F.max("_g") - F.min("_g")).alias("disagreement"))
    weakest = F.when(F.col("weakest") < 9, F.col("weakest"))
    return features.withColumn("weakest", weakest).join(places, "report_id", "left").join(wide, "report_id", "left")


def entity_lab(counts: DataFrame, degrees: DataFrame, ranks: DataFrame) -> DataFrame:
    """The persons as columns (I22): rank, generation, death year, links, teachers, students, PageRank."""
    return (counts.select("person_id", "rank", "generation", "death_year", "links").join(degrees, "person_id", "left")
            .join(ranks, "person_id", "left").na.fill(0, ["teachers", "students"]).na.fill(0.0, ["score"]))


def strongest_pairs(correlations: DataFrame) -> DataFrame:
    """The pairs of a correlation table, strongest first."""
    return correlations.orderBy(F.desc_nulls_last(F.abs("rho")), "a", "b")
