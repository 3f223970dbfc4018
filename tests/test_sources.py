"""Files in, files out, and the stream."""

import json

from pyspark.sql import functions as F

from corpuslink.sources import readers as S
from corpuslink.sources import writers as K
from corpuslink.streaming import index as X

ROWS = "number,chapter,en,grade\n1,1,First text,Sahih - A\n1,1,Second of one,skip me\n12.0,2,Twelve,Hasan - B\n"


def mapping(**kw):
    base = dict(collection="c", number="number", section="chapter", texts=(("en", "en"),), ratings=(("r", "grade", r"^(\w+) -", "skip"),))
    return S.Mapping(**{**base, **kw})


def test_mapped_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(ROWS)
    out = S.read_mapped(spark, str(tmp_path / "a.csv"), mapping())
    assert sorted(r["number"] for r in out["reports"].collect()) == ["1", "1.2", "12"]
    assert sorted((r["number"], r["grade"]) for r in out["ratings"].collect()) == [("1", "Sahih"), ("12", "Hasan")]


def test_positional_csv_and_volumes(spark, tmp_path):
    (tmp_path / "b.csv").write_text("5;x\n6;y\n")
    m = S.Mapping(collection="c", number="#0", texts=(("en", "#1"),), header=False, separator=";")
    out = S.read_volumes(spark, [(str(tmp_path / "b.csv"), 2)], m)
    assert sorted((r["number"], r["number_sort"]) for r in out["reports"].collect()) == [("2:5", 200005.0), ("2:6", 200006.0)]


def test_mapped_json_of_both_shapes(spark, tmp_path):
    m = lambda records: S.Mapping(collection="c", number="n", texts=(("en", "t.en"),), format="json", records=records)
    (tmp_path / "l.json").write_text(json.dumps({"data": {"list": [{"n": 3, "t": {"en": "x"}}]}}))
    (tmp_path / "d.json").write_text(json.dumps({"k1": {"n": 4, "t": {"en": "y"}}}))
    assert [tuple(r) for r in S.read_mapped(spark, str(tmp_path / "l.json"), m("data.list"))["texts"].collect()] == [("c", "3", "en", "x")]
    assert [tuple(r) for r in S.read_mapped(spark, str(tmp_path / "d.json"), m(""))["texts"].collect()] == [("c", "4", "en", "y")]


def test_nested_book(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"reports": [{"collection": "c", "number": "1", "section": 2, "ratings": {"r": "Sahih"}}]}))
    (tmp_path / "en.json").write_text(json.dumps({"texts": {"1": "hello", "9": "none"}, "sections": {"2": "Two"}}))
    out = S.read_book(spark, str(tmp_path), ["tr"], ["en", "ar"])
    assert [r["text"] for r in out["texts"].collect()] == ["hello"] and out["sections"].head()["title"] == "Two"
    assert tuple(out["ratings"].head()) == ("c", "1", "r", "Sahih")


def test_editions(spark, tmp_path):
    (tmp_path / "eng-x.json").write_text(json.dumps({"metadata": {"name": "X"}, "hadiths": [{"hadithnumber": 1, "text": "t", "grades": [{"name": "r", "grade": "g"}]}]}))
    texts, ratings = S.read_editions(spark, str(tmp_path / "eng-x.json"))
    assert tuple(texts.head()) == ("eng-x", "1", "t") and tuple(ratings.head()) == ("eng-x", "1", "r", "g")
    (tmp_path / "index.json").write_text(json.dumps({"x": {"collection": [{"name": "ara-x", "language": "Arabic", "comments": ""}, {"name": "ara-x1", "language": "Arabic", "comments": ""}]}}))
    assert [r["name"] for r in S.edition_index(spark, str(tmp_path / "index.json")).collect()] == ["ara-x"]


def test_marked_up_entries(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#META\n### $ 1 - Early\nbody one\n~~goes on PageV03P001\n### | Chapter A\n### $ 2 - Second\nbody two\n### $ 3 - Third\nend\n")
    rows = {r["number"]: r for r in S.read_entries(spark, str(tmp_path / "m.txt")).collect()}
    assert rows[1]["head"] == "Introduction" and rows[1]["text"] == "Early body one goes on" and rows[1]["volume"] == 3
    assert (rows[2]["head"], rows[2]["name"], rows[3]["volume"]) == ("Chapter A", "Second", 3)


def test_verses_and_fingerprints(spark, tmp_path):
    (tmp_path / "ed.json").write_text(json.dumps([["a", "b"], ["c"]]))
    rows = S.read_verse_editions(spark, str(tmp_path)).select("chapter", "verse", "text").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert S.fingerprints(spark, str(tmp_path / "*.json")).head()["bytes"] == (tmp_path / "ed.json").stat().st_size


def test_a_failing_source_does_not_stop_the_others(spark):
    S.register_reader("good", lambda s, o: s.range(1))
    S.register_reader("bad", lambda s, o: 1 / 0)
    seen, done = [], []
    out = S.run_batch(spark, [("bad", {}), ("good", {})], lambda n, df: seen.append(df.count()), lambda: done.append(1))
    assert out["good"] == "ok" and out["bad"].startswith("ZeroDivisionError") and seen == [1] and done == [1]


def test_manifest(spark):
    t = "entry string, fingerprint string, languages array<string>"
    have = spark.createDataFrame([("a", "1", ["en"]), ("b", "1", ["en", "tr"]), ("c", "1", ["en"])], t)
    offered = spark.createDataFrame([("a", "2", ["en"]), ("c", "1", ["en", "tr", "fr"]), ("d", "1", ["en"]), ("e", "1", ["en"])], t)
    gone = spark.createDataFrame([("e",)], "entry string")
    rows = {r["entry"]: (r["change"], r["added"]) for r in S.manifest_diff(have, offered, gone).collect()}
    assert rows == {"a": ("changed", None), "c": ("languages", ["tr"]), "d": ("new", None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("c1", "1", "x"), ("c2", "2", "y")], "collection string, number string, text string")
    K.write_per_collection(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("collection = 'c2'").head()["text"] == "y"
    K.write_tables({"t": df}, str(tmp_path / "stats"), "all", "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "stats/t")).head()["scope"] == "all"
    reports = df.withColumn("report_id", F.col("number").cast("long")).select("report_id", "collection", "number")
    texts = spark.createDataFrame([(1, "en", "hello")], "report_id long, language string, text string")
    ratings = spark.createDataFrame([(1, "r", "g")], "report_id long, rater string, grade string")
    K.exchange(reports, texts, ratings, str(tmp_path / "ex"))
    assert spark.read.json(str(tmp_path / "ex/texts")).head()["text"] == "hello"


def test_stream_equals_batch(spark, tmp_path):
    texts = spark.createDataFrame([(1, "en", "Alpha beta"), (2, "en", "beta gamma"), (3, "de", "Größe")], "report_id long, language string, text string")
    arriving = str(tmp_path / "in")
    texts.where("report_id < 3").write.parquet(arriving)
    run = lambda: X.index_stream(spark, arriving, texts.schema, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    run()
    texts.where("report_id >= 2").write.mode("append").parquet(arriving)  # 2 arrives twice
    run()
    out = X.indexed(spark, str(tmp_path / "ix"))
    assert out["text_norm"].count() == 3
    assert {r["word"]: r["n"] for r in out["words"].collect()} == {"alpha": 1, "beta": 2, "gamma": 1, "grosse": 1}
