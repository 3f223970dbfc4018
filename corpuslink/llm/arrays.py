"""Running sums over arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def running(steps: Column) -> Column:
    """For an array of numbers the sums of all elements before each one (array of longs, same length).

    An array is grown element by element only within blocks, so that arrays of a hundred thousand elements stay cheap."""
    size = F.size(steps)
    starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / F.lit(BLOCK)).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x.cast("long")).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, start, step, lambda a: a["out"])

    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    bases = before(F.transform(blocks, total))
    inner = F.zip_with(blocks, bases, lambda block, base: F.transform(before(block), lambda x: x + base))
    return F.flatten(inner)
