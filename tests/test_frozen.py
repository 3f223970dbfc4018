"""Tables that are written end what was needed for them."""

import time

from pyspark.sql import functions as F

from corpuslink.session import SHUFFLES_GO, frozen


def test_what_was_shuffled_for_a_table_is_deleted(spark):
    files = lambda: sum(f"{f}".count("shuffle_") for f in [spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")])
    said, before = spark.conf.get(SHUFFLES_GO, "false"), files()
    table = frozen(spark.range(10_000).groupBy(F.col("id") % 7).agg(F.count(F.lit(1)).alias("n")))
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(SHUFFLES_GO, "false") == said
    assert table.agg(F.sum("n")).first()[0] == 10_000
