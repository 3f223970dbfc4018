"""The phrase dictionary and the keyed person search held against comparing everything with everything."""

import random

from pyspark.sql import functions as F

from corpuslink.functions.names import loose, name_tokens, one_off, skeleton
from corpuslink.functions.text import blank_split
from corpuslink.operators import people as P
from corpuslink.operators.dictionary import occurring


def test_strings_in_texts(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 40)), word(5) if i % 3 else None) for i in range(60)] + [(60, None, None), (61, "", ""), (0, "ab", "b")]
    strings = [("long", word(rng.randrange(1, 4))) for _ in range(40)] + [("short", w) for w in ("a", "é", "", "zz")] + [("long", None), ("none", "a")]
    rows = spark.createDataFrame(texts, "id int, long string, short string").repartition(3)
    wanted = spark.createDataFrame(strings, "kind string, string string")
    expected = sorted((i, k, s) for i, a, b in texts for k, s in {x for x in strings if x[1] is not None} for hay in [{"long": a, "short": b}.get(k)] if hay is not None and s in hay)
    for most in (2_000_000, 30):
        got = occurring(rows, "id", {"long": F.col("long"), "short": F.col("short")}, wanted, most)
        assert sorted(tuple(r) for r in got.collect()) == expected
    assert occurring(rows, "id", {"long": F.col("long")}, wanted.limit(0)).count() == 0


def test_many_strings_of_one_length_are_one_pass(spark, monkeypatch):
    monkeypatch.setattr("corpuslink.operators.dictionary.AT_ONCE", 200)
    monkeypatch.setattr("corpuslink.operators.dictionary.TRIED_BITS", 4)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aé𝔸") for _ in range(n))
    texts = [(i, word(rng.choice([0, 3, 6, 7, 50, 300]))) for i in range(50)] + [(50, None), (0, "aaaaaaaa")]
    strings = list({word(7) for _ in range(400)} | {t[:7] for _, t in texts if t and len(t) >= 7}) + ["aé", "éé"]
    wanted = spark.createDataFrame([("x", w) for w in strings], "kind string, string string")
    got = occurring(spark.createDataFrame(texts, "id int, t string"), "id", {"x": F.col("t")}, wanted, 500)
    assert sorted((r["id"], r["string"]) for r in got.collect()) == sorted((i, w) for i, t in texts if t for w in strings if w in t)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def every_pair(names, queries):
    """All passes by comparing each query with each name."""
    key = lambda c: F.transform(blank_split(c), skeleton)
    arabic = F.col("text").rlike("[؀-ۿ]")
    asked = queries.select("query_id", F.when(arabic, name_tokens(F.col("text"))).otherwise(key(F.lower("text"))).alias("_q"), arabic.alias("_a"))
    both = names.select("person_id", "own", name_tokens(F.col("name")).alias("_w"), key(F.col("name")).alias("_b")).crossJoin(asked)
    both = both.withColumn("_n", F.when(F.col("_a"), F.col("_w")).otherwise(F.col("_b"))).cache()
    found = {}
    for number, (same, cost) in enumerate(((P._same, 0), (P._loose_same, P.LOOSE_COST), (one_off, P.ONE_OFF_COST))):
        of = (lambda c: F.transform(c, loose)) if number else (lambda c: F.col(c))
        score = P.ordered_score(of("_q"), of("_n"), same)
        rows = both.withColumn("_s", score).where("_s is not null").groupBy("query_id", "person_id").agg((F.max(F.col("_s") * F.when(F.col("own"), 10).otherwise(1)) - cost).alias("s")).collect()
        counts = {}
        for q, _ in found:
            counts[q] = counts.get(q, 0) + 1
        if number and all(counts.get(r["query_id"], 0) >= P.FUZZY_BELOW for r in asked.collect()):
            break
        for r in rows:
            if counts.get(r["query_id"], 0) < P.FUZZY_BELOW or not number:
                found.setdefault((r["query_id"], r["person_id"]), (r["s"], number))
    return found


def test_person_search_loses_nothing(spark):
    rng = random.Random(7)
    first = ["محمد", "أحمد", "عبد الله", "زهير", "سفيان", "الحسن", "Muhammad", "Hurayra", "Zuhri", "Bukhari", "Ali", "Malik", "Sufyan"]
    names = [(i, " بن ".join(rng.sample(first, rng.randrange(1, 4))), i % 3 == 0) for i in range(80)] + [(200, "", True), (201, None, True)]
    queries = ["Buhari", "zuhri", "الزهري", "محمد", "mhmd", "Sufian Malik", "سفيان", "زهر", "Hurayrah", "xyz", "", "ali", "Muhamad", "عبد", "حسن", "Malk", "hury"]
    people = spark.createDataFrame(names, "person_id int, name string, own boolean")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    got = {(r["query_id"], r["person_id"]): (r["score"], r["pass"]) for r in P.search_persons(people, asked).collect()}
    assert got == every_pair(people, asked)
