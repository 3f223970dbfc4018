"""Reading chains and tying names, on literal rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from corpuslink.operators import chains as C
from corpuslink.operators import people as P
from corpuslink.operators import resolve as E


def read(spark, text, profile=C.PROFILE_A):
    chains, links = C.extract_links(spark.createDataFrame([(1, text)], "report_id long, text string"), profile)
    return chains, links, [(r["ordinal"], r["name"]) for r in links.orderBy("ordinal", "position").collect()]


def test_chain_with_its_end(spark):
    chains, _links, names = read(spark, "1 - حَدَّثَنَا الحميدي، قال: حَدَّثَنَا سفيان، عن يحيى بن سعيد، عن عمر رضي الله عنه عن النبي قال إنما الأعمال")
    assert names == [(1, "الحميدي"), (1, "سفيان"), (1, "يحيى بن سعيد"), (1, "عمر")]
    assert chains.head()["reaches"]


def test_no_chain_has_a_reason(spark):
    chains, _links, names = read(spark, "باب ما جاء")
    assert names == [] and chains.head()["problem"] == C.NO_CHAIN


def test_bare_first_name_on_the_second_scale(spark):
    assert read(spark, "محمد بن يحيى، عن أحمد، عن النبي قال", C.PROFILE_B)[2] == [(1, "محمد بن يحيى"), (1, "أحمد")]


def test_long_names(spark):
    long = "محمد" + " بن عبد الله" * 20
    marked = "مُحَمَّدٌ" + " بْنُ عَبْدِ اللَّهِ" * 12
    assert len(long) > 160 and len(marked) > 160
    names = [(1, "سفيان"), (1, long), (1, marked), (1, "أحمد")]
    assert read(spark, f"حدثنا سفيان، عن {long}، عن {marked}، عن أحمد، عن النبي قال")[2] == names
    # the second scale keeps the first 160 letters; marks are no letters, and what follows is no filler
    cut = long[:160].strip()
    assert read(spark, f"سفيان، عن {marked}، عن {long}، عن أحمد، عن النبي قال", C.PROFILE_B)[2] == [(1, "سفيان"), (1, marked), (1, cut)]
    assert read(spark, f"{long}، عن أحمد، عن النبي قال", C.PROFILE_B)[2] == [(1, cut), (1, "أحمد")]


def test_roads_meet(spark):
    chains, links, names = read(spark, "حدثنا مسدد، عن سفيان ح وحدثنا قتيبة، عن سفيان، عن الزهري، عن النبي قال")
    assert names == [(1, "مسدد"), (1, "سفيان"), (2, "قتيبة"), (2, "سفيان"), (2, "الزهري")]
    done, joined = C.join_roads(chains, links)
    assert [r["name"] for r in joined.where("ordinal = 1").orderBy("position").collect()] == ["مسدد", "سفيان", "الزهري"]
    assert done.where("ordinal = 1").head()["reaches"]


def test_alternates(spark):
    links = spark.createDataFrame([(1, 1, "a", "سفيان وشعبة"), (1, 2, "b", "الزهري")], "chain_id long, position int, term string, name string")
    out = C.expand_alternates(links)
    assert sorted((r["alternate"], r["position"], r["name"]) for r in out.collect()) == [
        (0, 1, "سفيان"), (0, 2, "الزهري"), (1, 1, "شعبة"), (1, 2, "الزهري")]


def test_group_members_and_full_names(spark):
    links = spark.createDataFrame([(1, 1, "k", "عدة من أصحابنا"), (1, 2, "k", "سهل بن زياد"), (2, 1, "k", "ابي")], "chain_id long, position int, collection string, name string")
    members = spark.createDataFrame([("عده من اصحابنا", "سهل", "م1"), ("عده من اصحابنا", "احمد", "م2")], "`group` string, head string, member string")
    assert [r["member"] for r in C.group_members(links, members).collect()] == ["م1"]
    teachers = spark.createDataFrame([("k", "ابي", "علي بن الحسين")], "collection string, short string, long string")
    assert C.full_first_names(links, teachers).where("chain_id = 2").head()["name"] == "علي بن الحسين"


def test_origin_only(spark):
    texts = spark.createDataFrame([(1, "c", "عن أبي هريرة قال كذا"), (2, "d", "شيء ما طويل جدا في هذا المكان"), (3, "c", "عن رجل لا نعرفه أبدا قال")], "report_id long, collection string, text string")
    chains, links = C.origin_only(texts, spark.createDataFrame([("ابي هريره",)], "name string"), ["d"], "عن")
    assert {r["report_id"]: r["reaches"] for r in chains.collect()} == {1: True, 2: True, 3: False}
    assert [(r["report_id"], r["name"]) for r in links.collect()] == [(1, "ابي هريره")]


def test_stopped_road_continues(spark):
    stopped = spark.createDataFrame([(1, 1, "a", 9), (1, 2, "b", 9)], "report_id long, position int, key string, source long")
    whole = spark.createDataFrame([(9, 1, "x", "X"), (9, 2, "b", "B"), (9, 3, "c", "C")], "source long, position int, key string, name string")
    assert [tuple(r) for r in C.continue_by_last_whole(stopped, whole).collect()] == [(1, 3, "C")]


PERSONS = "person_id long, name string, generation int, death_year int"


def test_resolution_in_order(spark):
    persons = spark.createDataFrame([(1, "مالك بن انس", 7, 179), (2, "نافع مولي ابن عمر", 3, 117), (3, "عبد الله بن عمر بن الخطاب", 1, 73), (4, "عبد الله بن عمر العمري", 7, 171)], PERSONS)
    aliases = spark.createDataFrame([(1, "مالك", 0), (2, "نافع", 0), (3, "عبد الله بن عمر", 0), (4, "عبد الله بن عمر", 0)], "person_id long, alias string, tier int")
    links = spark.createDataFrame([(1, 1, "مالك"), (1, 2, "نافع"), (1, 3, "عبد الله بن عمر")], "chain_id long, position int, name string")
    chains = spark.createDataFrame([(1, True)], "chain_id long, reaches boolean")
    out = {r["position"]: (r["person_id"], r["confidence"]) for r in E.resolve(links, chains, persons, aliases).collect()}
    assert out == {1: (1, 1.0), 2: (2, 1.0), 3: (3, 0.8)}


def test_longer_entry_and_accusative(spark):
    aliases = spark.createDataFrame([(1, "سليمان بن مهران الاسدي الكوفي", 0), (2, "سالم", 0)], "person_id long, alias string, tier int")
    names = spark.createDataFrame([("سليمان بن مهران الكوفي",), ("سالما",)], "name string")
    assert {r["name"]: r["person_id"] for r in E.name_candidates(names, aliases).collect()} == {"سليمان بن مهران الكوفي": 1, "سالما": 2}


def test_client_bare_name_famous_elsewhere(spark):
    links = spark.createDataFrame([(1, 1, "نافع"), (1, 2, "ابن عمر")], "chain_id long, position int, name string")
    cands = spark.createDataFrame([(1, 1, 5, 3, 0), (1, 1, 6, 3, 0)], "chain_id long, position int, person_id long, generation int, death_year int")
    entries = spark.createDataFrame([(5, "نافع ابو عبد الله مولي ابن عمر ثقه"), (6, "نافع بن جبير")], "person_id long, entry string")
    assert [r["person_id"] for r in E.clients(cands, links, entries).collect()] == [5]
    table = spark.createDataFrame([("نافع", 6, "بن عمر", "teacher")], "name string, person_id long, beside string, side string")
    assert [r["person_id"] for r in E.bare_names(cands, links, table).collect()] == [6]
    assert E.famous(links.where("position = 1"), spark.createDataFrame([("نافع", 5)], "name string, person_id long")).head()["confidence"] == E.FAMOUS
    assert [r["person_id"] for r in E.elsewhere(spark.createDataFrame([("نافع بن جبير",)], "name string"), entries).collect()] == [6]


def test_relatives_and_father_pair(spark):
    persons = spark.createDataFrame([(1, "s", 5, None), (2, "son", 4, None), (3, "father", 3, None), (4, "other", 4, None), (9, "t", 2, None)], PERSONS)
    links = spark.createDataFrame([(1, 1, "x"), (1, 2, "سالم"), (1, 3, "أبيه"), (1, 4, "t")], "chain_id long, position int, name string")
    fathers = spark.createDataFrame([(2, 3)], "son long, father long")
    schema = "chain_id long, position int, person_id long, confidence double, rule string, candidates int"
    known = spark.createDataFrame([(1, 1, 1, 1.0, "name", 1), (1, 2, 2, 1.0, "name", 1), (1, 3, None, None, None, 0), (1, 4, 9, 1.0, "name", 1)], schema)
    assert [tuple(r) for r in E.relatives(links, known, fathers, persons).collect()] == [(1, 3, 3)]
    unsure = spark.createDataFrame([(1, 1, 1, 1.0, "name", 1), (1, 2, None, None, None, 2), (1, 3, None, None, None, 0), (1, 4, 9, 1.0, "name", 1)], schema)
    cands = spark.createDataFrame([(1, 2, 2, 4, 0), (1, 2, 4, 4, 0)], "chain_id long, position int, person_id long, generation int, death_year int")
    row = E.father_pairs(unsure, cands, links, fathers, persons).head()
    assert (row["son"], row["father"]) == (2, 3)


def test_person_search_passes(spark):
    names = spark.createDataFrame([(1, "محمد بن اسماعيل البخاري", True), (2, "زهير بن حرب", True), (3, "محمد بن مسلم الزهري", True)], "person_id long, name string, own boolean")
    queries = spark.createDataFrame([(1, "Buhari"), (2, "zuhri"), (3, "الزهري")], "query_id int, text string")
    found = {(r["query_id"], r["person_id"]) for r in P.search_persons(names, queries).where("score > -1900").collect()}
    assert {(1, 1), (2, 3), (3, 3)} <= found and (2, 2) not in {(r["query_id"], r["person_id"]) for r in P.search_persons(names, queries).where("pass = 0").collect()}


def test_featured_aliases(spark):
    rows = spark.createDataFrame([(1, "Abu Bakr"), (2, "Umar")], "person_id long, alias string")
    assert P.featured_by_alias(rows, "ibn Umar").select("person_id", "place").collect()[0].asDict() == {"person_id": 2, "place": 2}
    assert P.featured_by_alias(rows, "abu bakr").head()["place"] == 0


def test_mentions_and_runs(spark):
    from corpuslink.operators import relations as R

    texts = spark.createDataFrame([(1, "عن ابي الحسن قال"), (2, "قال الحسن قال"), (3, "لا شيء")], "report_id long, norm string")
    assert [r["report_id"] for r in R.mentions(texts, ["الحسن"], "الحسن", ["ابي", "بن"], reach=0).collect()] == [2]
    rows = spark.createDataFrame([("c", i, i, h, g) for i, h, g in [(1, True, False), (2, False, True), (3, False, True), (4, False, False), (5, False, True)]],
                                 "collection string, report_id long, number_sort long, h boolean, g boolean")
    assert sorted(r["report_id"] for r in R.runs(rows, F.col("h"), F.col("g")).collect()) == [1, 2, 3]


def cut_by_hand(names):
    parts = []
    for name in names:
        if not parts or name is not None and name == names[0]:
            parts.append([])
        parts[-1].append(name)
    for part in parts:
        at = 0
        while at < len(part):
            again = max(i for i, name in enumerate(part) if i == at or name is not None and name == part[at])
            del part[at + 1:again + 1]
            at += 1
    return parts


def test_every_repeat_is_cut(spark):
    from random import Random
    draw = Random(5)
    chains = ["xabacdce", "abacbdb", "abacad", "abc", "xabacb", *("".join(draw.choices("abcdef", k=draw.randint(1, 12))) for _ in range(60))]
    chains = [list(c) for c in chains] + [[None, "a", None, "b", "a"], ["a", None, None, "a"]]
    rows = [(i, p, name) for i, c in enumerate(chains) for p, name in enumerate(c, 1)]
    out = C.cut_repeats(spark.createDataFrame(rows, "chain_id long, position long, name string"))
    got = {(r["chain_id"], r["part"], r["position"]): r["name"] for r in out.collect()}
    assert out.count() == len(got)
    assert got == {(i, k, p): name for i, c in enumerate(chains) for k, part in enumerate(cut_by_hand(c), 1) for p, name in enumerate(part, 1)}
    assert [got[0, 1, p] for p in range(1, 5)] == list("xace") and (0, 1, 5) not in got


def restarts_by_hand(links, rounds=4):
    """[(key, said, fresh, joined)] of one road -> its roads, as lists of places in the road."""
    roads, done = [(list(range(len(links))), 0)], []
    while roads:
        road, turn = roads.pop(0)
        hit = None
        for b in range(len(road)) if turn < rounds else ():
            key = links[road[b]][0]
            for a in range(b - 1):
                if key is not None and links[road[a]][0] == key and hit is None:
                    follows = b + 1 < len(road) and links[road[a + 1]][1] == links[road[b + 1]][1]
                    if follows or links[road[a + 1]][2] or any(links[road[x]][3] for x in range(a, b)):
                        hit = a, b
        if hit is None:
            done.append(road)
        elif hit[0] == 0:
            roads += [(road[:hit[1]], turn + 1), (road[hit[1]:], turn + 1)]
        else:
            roads.append((road[:hit[0] + 1] + road[hit[1] + 1:], turn + 1))
    return sorted(done)


def test_restarts_are_cut_behind_the_guard(spark):
    from random import Random
    draw = Random(8)
    pool = ["شعبة", "سفيان", "الزهري", "نافع", "عبد الله", "أبيه", "حفص وعمر"]
    chains = [[(draw.choice(pool), draw.random() < 0.15) for _ in range(draw.randint(1, 9))] for _ in range(80)]
    chains.append([("شعبة", False), ("محمد بن سالم", False), ("حفص بن عمر", False), ("شعبة", False), ("محمد بن سالم", False)])
    chains.append([("عبد الرحمن", False), ("سفيان", False), ("عبد الرحمن", False)])
    rows = [(c, i, name, fresh) for c, chain in enumerate(chains) for i, (name, fresh) in enumerate(chain, 1)]
    links = spark.createDataFrame(rows, "chain_id long, position int, name string, fresh boolean").withColumn("_at", F.col("position"))
    got = defaultdict(lambda: defaultdict(list))
    for r in C.cut_restarts(links).orderBy("chain_id", "part", "position").collect():
        got[r["chain_id"]][r["part"]].append((r["position"], r["_at"] - 1))
    key = {r["name"]: r["k"] for r in spark.createDataFrame([(n,) for n in pool + ["محمد بن سالم", "حفص بن عمر", "عبد الرحمن"]], "name string").select("name", C.name_key(F.col("name")).alias("k")).collect()}
    for c, chain in enumerate(chains):
        marked = [(None if n in ("عبد الله", "أبيه") else key[n], key[n], fresh, n == "حفص وعمر") for n, fresh in chain]
        assert all([p for p, _ in part] == list(range(1, len(part) + 1)) for part in got[c].values())
        assert sorted([at for _, at in part] for part in got[c].values()) == restarts_by_hand(marked), chain
    assert len(got[len(chains) - 1][1]) == 3 and len(got[len(chains) - 2]) == 2


def test_chains_and_links_read_alone(spark):
    text = "حدثنا سفيان، عن نافع، عن النبي ح حدثنا مالك، عن نافع"
    texts = spark.createDataFrame([(1, text), (2, "كلام"), (3, "")], "report_id long, text string")
    chains, links = C.extract_links(texts)
    assert sorted(map(tuple, C.extract_links_only(texts).collect())) == sorted(map(tuple, links.collect()))
    key = lambda rows: sorted(map(str, rows))
    assert key(C.extract_chains_only(texts).collect()) == key(chains.collect())


def test_phrases_are_tried_by_letters():
    import re
    pattern = C.any_of(("سمع", "سمعه من", "سمعت", "عن"))
    assert pattern.count("س") == 1
    assert [re.match(pattern + r"(?!\w)", t) is not None for t in ("سمع", "سمعه من", "سمعت", "عن", "سمعه", "عنه")] == [True] * 4 + [False] * 2
    assert re.match(pattern, "سمعه من فلان").group() == "سمعه من"
