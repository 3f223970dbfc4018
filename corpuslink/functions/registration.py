"""The column functions under SQL names (X2): SQL scalar functions over the same built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpuslink.functions.text import FOLD_FROM, FOLD_SEVERAL, FOLD_TO, LATIN_CLASS, LATIN_SEVERAL, RARE_LETTER, WORD


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normalize(text: str) -> str:
    """``functions.text.normalize`` as a SQL expression."""
    folded = f"translate({text}, {_quoted(FOLD_FROM)}, {_quoted(FOLD_TO)})"
    latin = folded
    for letter, spelt in LATIN_SEVERAL.items():
        latin = f"replace({latin}, {_quoted(letter)}, {_quoted(spelt)})"
    pairs = ", ".join(f"{_quoted(c)}, {_quoted(f)}" for c, f in FOLD_SEVERAL.items())
    rare = f"array_join(transform(split({folded}, ''), c -> coalesce(map({pairs})[c], c)), '')"
    marks = "'\\'`'"
    return (f"CASE WHEN octet_length({text}) = length({text}) THEN lower(translate({text}, {marks}, '')) WHEN {text} RLIKE {_quoted(RARE_LETTER)} "
            f"THEN {rare} WHEN {text} RLIKE {_quoted(LATIN_CLASS)} THEN {latin} ELSE {folded} END")


def _near(a: str, b: str) -> str:
    """``functions.names.near`` as a SQL expression."""
    places = f"filter(sequence(1, greatest(length({a}), 1)), i -> substr({a}, i, 1) <> substr({b}, i, 1))"
    i, j = f"try_element_at({places}, 1)", f"try_element_at({places}, 2)"
    swapped = (f"length({a}) = length({b}) AND size({places}) = 2 AND {j} = {i} + 1 AND substr({a}, {i}, 1) = substr({b}, {j}, 1) "
               f"AND substr({a}, {j}, 1) = substr({b}, {i}, 1)")
    return f"levenshtein({a}, {b}, 1) >= 0 OR coalesce({swapped}, false)"


def register_functions(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions for ``spark.sql``: inlined by the optimiser, no Python in the rows."""
    bodies = {
        "cl_normalize(t STRING) RETURNS STRING": _normalize("t"),
        "cl_words(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(t, {_quoted('(' + WORD + '+)')}, 1)",
        "cl_ce_year(y INT) RETURNS INT": "cast(bround(y * 0.970229 + 621.5643) AS INT)",
        "cl_is_near(a STRING, b STRING) RETURNS BOOLEAN": _near("a", "b"),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in bodies]
