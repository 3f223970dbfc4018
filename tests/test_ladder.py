"""Many queries on the ladder of spellings at once."""

from corpuslink.operators import search as S


def test_each_query_takes_its_first_level_and_no_plan_holds_the_spellings_again_and_again(spark):
    texts = [(1, "one house, two houses"), (2, "a mouse in the house"), (3, "the moose"), (4, "hous of cards"), (5, "cards")]
    normed = spark.createDataFrame(texts, "report_id long, norm string")
    asked = [(1, "house"), (2, "mouze"), (3, "card"), (3, "hause"), (4, "zzzz"), (5, "m??se"), (6, "the"), (6, "hoose")]
    found = S.search_many(normed, S.vocabulary(normed), spark.createDataFrame(asked, "query_id int, term string"))
    assert {tuple(r) for r in found.select("query_id", "level", "report_id").collect()} == {
        (1, 0, 1), (1, 0, 2), (2, 1, 2), (5, 0, 2), (5, 0, 3), (6, 1, 2), (6, 1, 3)}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") < 10
