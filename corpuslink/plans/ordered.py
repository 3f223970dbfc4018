"""Ordered work that survives a hot group.

A window over one key sorts that key's rows in one task. Where a key may hold a large share of the table, the rows
are cut into range pieces instead: each piece is worked on by itself, one summary row per (key, piece) is carried
over, and the two are put together. The result is the same; no task sees more than one piece of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslink.session import frozen

HOT_ROWS = 2_000_000
PIECE = "_piece"


def hot_limit(df: DataFrame) -> int:
    """Rows of one group a single task may sort (session setting ``corpuslink.hotGroupRows``)."""
    return int(df.sparkSession.conf.get("corpuslink.hotGroupRows", str(HOT_ROWS)))


def has_hot_group(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Whether any group of ``keys`` is larger than one task should sort. Counted with map-side combine: one row per
    key and task is shuffled."""
    limit = limit or hot_limit(df)
    if not keys:
        return not df.select(F.lit(1)).offset(limit).limit(1).isEmpty()
    return not df.groupBy(*keys).count().where(F.col("count") > limit).limit(1).isEmpty()


def in_pieces(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` range-partitioned by key and order, the piece number frozen as ``_piece`` (pieces ascend with the
    order)."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return frozen(ranged.withColumn(PIECE, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in [*keys, PIECE]])


def _with_piece_summary(rows: DataFrame, summary: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Each row with its piece's carried-over values. The summary has one row per (key, piece)."""
    renamed = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PIECE).alias("_kp"), *names)
    same = [rows[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)] + [rows[PIECE] == renamed["_kp"]]
    joined = rows.join(renamed, reduce(lambda a, b: a & b, same), "left")
    return joined.drop("_kp", *[f"_k{i}" for i in range(len(keys))])


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                  hot: bool | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group up to and including this one. ``order``
    must be a total order."""
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(name, F.sum(value).over(window))
    rows = in_pieces(df.withColumn("_value", value), keys, order)
    before = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    summary = (rows.groupBy(*keys, PIECE).agg(F.sum("_value").alias("_sum"))
               .withColumn("_before", F.sum("_sum").over(before)))
    within = W.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _with_piece_summary(rows.withColumn("_within", F.sum("_value").over(within)), summary, keys, ["_before"])
    total = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_within")
    return out.withColumn(name, F.when(F.col("_within").isNull(), F.col("_before")).otherwise(total)).drop(
        PIECE, "_value", "_within", "_before")


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "n",
                  hot: bool | None = None) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row in its group. ``order`` must be a total order."""
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return running_total(df, keys, order, F.lit(1), name, hot=True)


def last_before(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                inclusive: bool = False, hot: bool | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of the group before this row (an as-of lookup), or up to it
    when ``inclusive``."""
    if hot is None:
        hot = has_hot_group(df, keys)
    end = W.currentRow if inclusive else -1
    if not hot:
        window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(window))
    rows = in_pieces(df.withColumn("_value", value).withColumn("_order", F.struct(*_plain(order))), keys, order)
    known = F.when(F.col("_value").isNotNull(), F.col("_order"))
    before = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    summary = (rows.groupBy(*keys, PIECE).agg(F.max_by("_value", known).alias("_last"))
               .withColumn("_before", F.last("_last", ignorenulls=True).over(before)))
    within = W.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    out = _with_piece_summary(rows.withColumn("_within", F.last("_value", ignorenulls=True).over(within)),
                              summary, keys, ["_before"])
    return out.withColumn(name, F.coalesce("_within", "_before")).drop(PIECE, "_value", "_order", "_within", "_before")


def _plain(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_within(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group in ``order``. For k up to 1000 Spark cuts every map task's groups to k rows
    before the shuffle, so a hot group sends k rows per task."""
    numbered = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(name) <= k)


def beside(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], hot: bool | None = None) -> DataFrame:
    """``df`` with ``<column>_before`` and ``<column>_after``: the columns of the row before and after in the group. In a
    hot group the rows are numbered and joined to their neighbours' numbers."""
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        window = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(window).alias(f"{c}_before") for c in columns],
                         *[F.lead(c).over(window).alias(f"{c}_after") for c in columns])
    placed = frozen(number_within(df, keys, order, "_n", hot=True))
    side = lambda step, end: placed.select(*keys, (F.col("_n") + step).alias("_n"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return placed.join(side(1, "before"), [*keys, "_n"], "left").join(side(-1, "after"), [*keys, "_n"], "left").drop("_n")


BLOCK = 4096


def next_in_chain(df: DataFrame, chain: str, position: str, columns: list[str], suffix: str = "_next") -> DataFrame:
    """Each row of a chain with ``columns`` of the row at ``position + 1``. Positions are 1, 2, 3 …, so a chain of any
    length is cut into blocks of positions, the first row of a block being repeated at the end of the one before: one
    shuffle, and no task sorts more than a block."""
    block = F.floor((F.col(position) - 1) / BLOCK).cast("long")
    opens = ((F.col(position) - 1) % BLOCK == 0) & (F.col(position) > 1)
    spread = df.withColumn("_block", F.explode(F.when(opens, F.array(block, block - 1)).otherwise(F.array(block))))
    window = W.partitionBy(chain, "_block").orderBy(position)
    out = spread
    follows = F.lead(position).over(window) == F.col(position) + 1
    for column in columns:
        out = out.withColumn(column + suffix, F.when(follows, F.lead(column).over(window)))
    return out.where(F.col("_block") == block).drop("_block")
