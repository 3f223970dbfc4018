"""Person entries cut into their fields."""

from corpuslink.operators.entries import FIELDS, parsed_entries

ENTRIES = {
    "سفيان بن عيينة الهلالي أبو محمد الكوفي ثم المكي ثقة حافظ إلا أنه تغير حفظه بأخرة من رؤوس الطبقة الثامنة مات في رجب سنة ثمان وتسعين وله إحدى وتسعون سنة ع":
        ("سفيان بن عيينة الهلالي أبو محمد الكوفي ثم المكي", "ثقة حافظ إلا أنه تغير حفظه بأخرة من رؤوس", 2, 8, 198, ["أبو محمد"], ["ع"]),
    "عبد الله بن عمر بن الخطاب العدوي أبو عبد الرحمن ولد بعد المبعث بيسير وهو أحد المكثرين من الصحابة مات سنة ثلاث وسبعين ع":
        ("عبد الله بن عمر بن الخطاب العدوي أبو عبد الرحمن", "ولد بعد المبعث بيسير وهو أحد المكثرين من الصحابة", 1, 1, 73, ["أبو عبد الرحمن"], ["ع"]),
    "أحمد بن إبراهيم الموصلي أبو علي نزيل بغداد صدوق من العاشرة مات سنة ست وثلاثين د فق": ("أحمد بن إبراهيم الموصلي أبو علي نزيل بغداد", "صدوق", 4, 10, 236, ["أبو علي"], ["د", "فق"]),
    "زيد بن وهب مخضرم ثقة جليل مات بعد الثمانين خ م": ("زيد بن وهب مخضرم", "ثقة جليل", 3, 2, None, [], ["خ", "م"]),
    "قيس  PageV01P007 من   الثالثه س": ("قيس", None, None, 3, None, [], ["س"]),
    "بكر يكنى أبا عمرو مقبول من صغار التاسعة": ("بكر يكنى أبا عمرو", "مقبول", 6, 9, None, ["أبو عمرو"], []),
    "ثقة من الثانية مات سنة مائة من الرابعة": ("ثقة", None, None, 2, 100, [], []),
    "عمر ضعيف مات سنة تسعين من الخامسة": ("عمر", "ضعيف", 8, 5, 90, [], []),
    "خ م": (None, None, None, None, None, [], ["خ", "م"]),
    "": (None, None, None, None, None, [], []),
}


def test_entries(spark):
    rows = [(i, t, "mine") for i, t in enumerate(ENTRIES)]
    out = parsed_entries(spark.createDataFrame([*rows, (99, None, "mine")], "entry_id int, text string, name string"))
    assert out.columns == ["entry_id", "text", *FIELDS]
    got = {r["entry_id"]: r for r in out.collect()}
    for i, expected in enumerate(ENTRIES.values()):
        r = got[i]
        assert (r["name"], r["verdict"], r["rank"], r["generation"], r["death_year"], r["kunyas"], r["marks"]) == expected
    assert all(got[99][c] is None for c in FIELDS)


def test_no_entries_and_a_long_one(spark):
    assert parsed_entries(spark.createDataFrame([], "text string")).count() == 0
    long = "زيد " + "كلام " * 20_000 + "ثقة من الثالثة ع"
    row = parsed_entries(spark.createDataFrame([(long,)], "text string")).head()
    assert (row["verdict"], row["generation"], row["marks"]) == ("ثقة", 3, ["ع"])
