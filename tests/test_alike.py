"""Fathers and persons that are alike are compared once: the results are those of comparing all."""

import random

from pyspark.sql import functions as F

from corpuslink.operators import graph as G
from corpuslink.operators import resolve as E

COUNTED = "org.apache.spark.sql.execution"


def joined_rows(df):
    """The most rows any join of the plan has made."""
    df.collect()
    plan, most, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            node = node.executedPlan()
            todo.append(node)
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return most


def people(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([None, 1, 2, 3]), [r.choice("ab") for _ in range(r.choice([2, 3, 4]))] if i < n - 40 else [f"x{i}", f"x{i + 1}", f"x{i + 2}", "z"]) for i in range(n)]


def test_father_edges_are_those_of_all_pairs(spark):
    for n, seed in ((12, 1), (14, 2), (60, 3), (60, 4)):
        rows = people(n, seed) if n > 40 else [(i, random.Random(seed * 100 + i).choice([None, 1, 2]), [random.Random(seed * 999 + i * 7 + k).choice("abc") for k in range(4)]) for i in range(n)]
        want = {}
        for s, gs, a in rows:
            found = []
            for f, gf, b in rows:
                for depth in (3, 2):
                    if s != f and len(a) > depth and len(b) >= depth and a[1:1 + depth] == b[:depth] and not (gs and gf and gf > gs):
                        found.append((depth, int(bool(gs and gf and gf < gs)), f))
            if found and len({x[2] for x in found if x[:2] == max(found)[:2]}) == 1:
                want[s] = max(found)[2]
        got = G.father_edges(spark.createDataFrame([(i, a, g) for i, g, a in rows], "person_id long, segments array<string>, generation int"))
        assert {r["son"]: r["father"] for r in got.collect()} == want


def test_father_edges_make_no_row_per_pair(spark):
    n = 600
    rows = spark.range(n).select(F.col("id").alias("person_id"), F.array(*[F.lit("a")] * 4).alias("segments"), (F.col("id") % 5).cast("int").alias("generation"))
    assert joined_rows(G.father_edges(rows)) <= 10 * n


def test_weighed_fathers_of_alike_are_those_of_all_pairs(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(i, r.choice([None, 1, 2, 3, 9]), r.randrange(12)) for i in range(60)], "id long, g int, place int")
    a = rows.select(F.col("id").alias("son"), F.col("g").alias("son_generation"), "place")
    b = rows.select(F.col("id").alias("father"), F.col("g").alias("father_generation"), "place")
    flags = [(F.col("place") % 2 == 0).alias("grandfather"), (F.col("place") % 3 == 0).alias("kunya"), *[F.lit(False).alias(k) for k in ("tribe", "city", "patron", "names_son")]]
    cols = ["son", "father", "son_generation", "father_generation", *flags]
    whole = E.weighed_fathers(a.join(b, "place").where("son <> father").select(*cols), 0.0)
    alike = E.without_himself(a.join(E.alike_fathers(b, ["place", "father_generation"]), "place"), F.col("son_generation").eqNullSafe(F.col("father_generation")))
    assert sorted(E.weighed_fathers(alike.select(*cols, "alike"), 0.0).collect()) == sorted(whole.collect()) != []


def test_list_linkage_compares_alike_once(spark):
    r = random.Random(6)
    names = ["a بن b", "a بن b بن c", "a بن b بن d", "e بن f بن c g", "a بن b بن c بن h", "x y"]
    entries = [(i, r.choice(names), r.choice([None, *range(100, 140)])) for i in range(80)]
    persons = [(i, r.choice(names), r.choice([None, *range(95, 145)])) for i in range(60)]

    def run(x, y):
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return k

    want = {}
    for e, name, year in entries:
        found = []
        for p, other, died in persons:
            x, y = name.split(), other.split()
            if min(len(x), len(y)) < 3 or x[:3] != y[:3] or year is None or died is None:
                continue
            k = run(x, y)
            depth, apart = (k + 1) // 2, abs(died - year)
            clash = depth < 3 and len(x) > k + 1 and len(y) > k + 1 and x[k - 1] == "بن"
            if not clash and (apart <= 3 or (depth >= 3 and apart <= 10)):
                found.append((depth, p))
        if found and sum(d == max(found)[0] for d, _ in found) == 1:
            want[e] = (max(found)[1], max(found)[0])
    got = E.link_list(spark.createDataFrame(entries, "entry_id long, name string, year int"), spark.createDataFrame(persons, "person_id long, name string, death_year int"))
    assert {x["entry_id"]: (x["person_id"], x["depth"]) for x in got.collect()} == want != {}
    n = 300
    many = spark.range(n)
    rows = E.link_list(many.select(F.col("id").alias("entry_id"), F.lit("a بن b").alias("name"), F.lit(100).alias("year")),
                       many.select(F.col("id").alias("person_id"), F.lit("a بن b").alias("name"), F.lit(101).alias("death_year")))
    assert joined_rows(rows) <= 10 * n and rows.count() == 0


def test_order_looks_only_at_chains_that_may_change(spark, monkeypatch):
    r = random.Random(8)
    rows = [(c, p, x, g, 0) for c in range(40) for p in range(1, 7) for x, g in enumerate(r.sample([None, *range(1, 13)], 1 if c < 20 else r.choice([1, 2, 4])))]
    slots = {}
    for c, p, x, g, _ in rows:
        slots.setdefault((c, p), []).append((x, g))

    def round_of(now):
        out = {}
        for (c, p), mine in now.items():
            side = lambda q: [g for _, g in now.get((c, q), [])]
            low = min(side(p + 1)) if side(p + 1) and None not in side(p + 1) else None
            high = max(side(p - 1)) if side(p - 1) and None not in side(p - 1) else None
            fit = [x for x in mine if x[1] is None or ((low is None or low <= x[1]) and (high is None or high >= x[1]))]
            out[c, p] = fit or mine
        return out

    asked, bounds = [], E.order_bounds
    monkeypatch.setattr(E, "order_bounds", lambda cands, hot=None: (asked.append({x["chain_id"] for x in cands.select("chain_id").collect()}), bounds(cands, hot))[1])
    df = spark.createDataFrame(rows, "chain_id long, position int, person_id long, generation int, death_year int")
    for rounds in (1, None):
        want, before = round_of(slots), None
        while rounds is None and want != before:
            before, want = want, round_of(want)
        asked.clear()
        got = sorted((x["chain_id"], x["position"], x["person_id"]) for x in E.monotone(df, rounds).collect())
        assert got == sorted((c, p, x) for (c, p), v in want.items() for x, _ in v) and len(got) < len(rows)
        assert asked[0] == {c for (c, _), v in slots.items() if len(v) > 1}
    assert len(asked) > 2 and all(b < a for a, b in zip(asked[:-1], asked[1:]))
