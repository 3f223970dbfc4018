"""Registered queries beside their DuckDB checks on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = """corpus_overview corpus_collections corpus_concentration corpus_lorenz_curve corpus_death_gaps corpus_compilers corpus_alias_owners
graph_edges graph_tree_closure graph_chapter_of_report graph_father_edges text_normalized text_tokens search_near search_passages search_rated_every
search_neighbours relations_counts relations_best_parallels relations_citations raters_agreement raters_alpha raters_dawid_skene_rounds
models_unit_features tests_spearman tests_mann_whitney chains_extracted chains_join_stopped resolve_neighbours resolve_impossible_round
ingest_dedupe_numbers export_flat_reports meaning_weights meaning_embeddings""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
