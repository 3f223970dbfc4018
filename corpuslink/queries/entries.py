"""Person entries written from the suppliers, and cut into their fields again."""

from pyspark.sql import functions as F

from corpuslink.operators.entries import parsed_entries
from corpuslink.plans import fixtures as X
from corpuslink.queries.registry import query

ORDINALS = ["الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة", "السادسة", "السابعة", "الثامنة", "التاسعة", "العاشرة", "الحادية عشرة", "الثانية عشرة"]
JUDGED = [("ثقة", 3), ("صدوق يهم", 5), ("مقبول", 6), ("", None), ("ثقة حافظ", 2), ("لا يعرف", 9), ("ولد بالكوفة", None)]
DATED = [("سنة سبع وخمسين", 57, False), ("سنة عشرين ومائتين", 220, True), ("في سنة ست وتسعين", 96, False), ("سنة إحدى ومائة", 101, True), ("بعد المائة", None, True)]
MARKED = ["خ م", "ع", "", "د ت س ق", "تمييز"]


def _list(values, kind="VARCHAR"):
    return "[" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in values) + f"]::{kind}[]"


ENTRIES = f"""p AS (SELECT s_suppkey AS k, CAST(1 + s_suppkey % 12 AS INTEGER) AS g, s_nationkey AS n, replace(n_name, ' ', '') || ' بن ' || s_name AS who FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    e AS (SELECT *, k % 4 AS form, CASE WHEN k % 3 = 0 THEN ' أبو محمد' WHEN k % 3 = 1 THEN ' بن أبي عبد الله' ELSE '' END AS after, list_extract({_list([v for v, _ in JUDGED])}, CAST(k % 7 + 1 AS INTEGER)) AS judged,
    list_extract({_list([r for _, r in JUDGED], 'INTEGER')}, CAST(k % 7 + 1 AS INTEGER)) AS rank, list_extract({_list(ORDINALS)}, g) AS ordinal, list_extract({_list([w for w, _, _ in DATED])}, CAST(n % 5 + 1 AS INTEGER)) AS dated,
    list_extract({_list([y for _, y, _ in DATED], 'INTEGER')}, CAST(n % 5 + 1 AS INTEGER)) AS y, list_extract({_list(MARKED)}, CAST(k % 5 + 1 AS INTEGER)) AS marks FROM p)"""


def entry_texts(spark, d):
    """One entry a supplier: the generation before the death, after it, without a death, or named by "of the generation"."""
    nation = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = X.table(spark, d, "supplier").join(nation, "s_nationkey")
    chosen = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    k, g = F.col("s_suppkey"), F.col("s_suppkey") % 12
    who = F.concat(F.replace("n_name", F.lit(" "), F.lit("")), F.lit(" بن "), "s_name", F.when(k % 3 == 0, " أبو محمد").when(k % 3 == 1, " بن أبي عبد الله").otherwise(""))
    era = chosen([w.replace("ة", "ه") if i % 2 else w for i, w in enumerate(ORDINALS)], g)
    died = F.concat(F.lit("مات "), chosen([w for w, _, _ in DATED], F.col("s_nationkey") % 5))
    judged, marks = chosen([v for v, _ in JUDGED], k % 7), chosen(MARKED, k % 5)
    of = F.concat(F.lit("من "), era)
    form = F.when(k % 4 == 0, F.concat_ws(" ", of, died)).when(k % 4 == 1, F.concat_ws(" ", died, of)).when(k % 4 == 2, of).otherwise(F.concat_ws(" ", F.concat(F.lit("الطبقة "), era), died))
    return rows.select(k.alias("entry_id"), F.concat_ws("  ", F.lit("PageV01P002"), who, judged, form, marks).alias("text"))


@query("entries_parsed", "", ENTRIES + """ SELECT k AS entry_id, who || after AS name, nullif(judged, '') AS verdict, rank, g AS generation, CASE form WHEN 3 THEN 'الطبقة ' ELSE 'من ' END || ordinal AS generation_phrase,
    CASE WHEN form <> 2 THEN 'مات ' || dated || CASE WHEN form = 1 THEN ' من ' || ordinal ELSE '' END END AS death_phrase,
    CAST(CASE WHEN form = 2 OR y IS NULL THEN NULL WHEN y >= 100 THEN y WHEN g <= 2 THEN y WHEN g <= 8 THEN CASE WHEN g <= 6 AND y >= 80 THEN y ELSE y + 100 END WHEN g = 9 AND y >= 80 THEN y + 100 ELSE y + 200 END AS INTEGER) AS death_year,
    CASE WHEN after = ' أبو محمد' THEN 'أبو محمد' END AS kunya, marks FROM e""")
def entries_parsed(spark, d):
    return parsed_entries(entry_texts(spark, d)).select("entry_id", "name", "verdict", "rank", "generation", "generation_phrase", "death_phrase", "death_year", "kunya",
                                                        F.array_join("marks", " ").alias("marks"))


@query("entries_by_verdict", "", ENTRIES + """ SELECT rank, marks AS mark, count(*) AS persons FROM (SELECT rank, unnest(string_split(marks, ' ')) AS marks FROM e WHERE marks <> '') GROUP BY ALL""")
def entries_by_verdict(spark, d):
    rows = parsed_entries(entry_texts(spark, d)).select("rank", F.explode("marks").alias("mark"))
    return rows.groupBy("rank", "mark").agg(F.count(F.lit(1)).alias("persons"))
