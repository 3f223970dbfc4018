"""Headline queries timed on ``$BENCH_SF_DIR``. Every query is run to the end (all columns computed) once to warm up and then
timed: three times, the median counts, or once where the warm-up took longer than ``DEAR`` seconds. ``search_index_build`` is the
first use of the stored search tables, which the search queries then read. The JSON line is printed once, at the end; when the time
allowed (``BENCH_SECONDS``) runs out, the queries left are named in it and not run."""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = """text_normalized search_vocabulary search_all search_phrase search_passages search_rated_any search_neighbours
corpus_overview corpus_collections corpus_pillars corpus_concentration corpus_death_gaps corpus_rating_by_weakest
graph_edges graph_learning_trees raters_agreement raters_alpha raters_dawid_skene_rounds models_unit_features tests_spearman
relations_counts relations_best_parallels chains_extracted chains_join_stopped resolve_neighbours resolve_monotone
meaning_weights meaning_lexical meaning_search search_ladder graph_pagerank resolve_impossible models_coefficients raters_strictness
tests_partial""".split()
#: The rows of the table that a query mainly reads, for rows per second.
ROWS = {"text": "documents", "search": "documents", "relations": "documents", "chains": "documents", "meaning": "documents"}
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
SECONDS = float(os.environ.get("BENCH_SECONDS", "900"))
DEAR = 8.0


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from corpuslink.queries import QUERIES
    from corpuslink.queries.search import vocab

    names = sys.argv[1:] or NAMES
    times, rates = {}, {}
    started = time.time()
    vocab(spark, FOLDER).count()
    build = round(time.time() - started, 3)
    counts = {name: spark.read.parquet(f"{FOLDER}/{name}.parquet").count() for name in ("documents", "lineitem")}
    begun, left = time.time(), []
    for name in names:
        if time.time() - begun > SECONDS:
            left.append(name)
            continue
        took, runs = [], RUNS
        for run in range(RUNS + 1):
            if run > runs:
                break
            started = time.time()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            seconds = time.time() - started
            if run:
                took.append(seconds)
            elif seconds > DEAR:
                runs = 1
        times[name] = round(median(took), 3)
        rates[name] = round(counts[ROWS.get(name.split("_")[0], "lineitem")] / max(times[name], 1e-3))
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows_per_second": rates, "search_index_build": build, "not_run": left, "cpus": int(CPUS), "sf": FOLDER.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
