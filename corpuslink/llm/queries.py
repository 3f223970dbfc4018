"""The operators as queries over the given tables, with their DuckDB checks where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslink.llm import (best_fit, chat_format, decontaminate, exact_dedup, html_extract, lexical_search, ngram_join, packing, secrets, substring_dedup,
                            token_counts, toxicity, whitening)
from corpuslink.session import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(tuned(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: Column | str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op1_html_extract")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    return html_extract.extracted(table(spark, folder, "pages", "page_id", "url", "html"))


@query("op2_chat_format", r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') || '</turn>' || chr(10) AS piece FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted and read back. The table's rows come in the layout of turn rows, conversation -7 in that
    of message lists."""
    said = F.lit("\\### Assistant: </turn> ok")
    messages = F.array(*(F.struct(F.lit(role).alias("role"), said.alias("content")) for role in ("user", "assistant")))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(messages.alias("messages"))).alias("record"))
    rows = table(spark, folder, "conversations", "conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    done = chat_format.formatted(chat_format.canonical_turns(rows.unionByName(extra), "conv_id", "record"))
    done = done.select("id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"),
                       F.concat_ws("", chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))).alias("loss"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return done.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op3_secrets", r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, source, 0 AS rank, 'assign' AS kind, 8 AS least, string_split_regex(text, p) AS parts, regexp_extract_all(text, p, 0) AS whole, regexp_extract_all(text, p, 2) AS vals
    FROM (SELECT *, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p FROM t)
    UNION ALL SELECT doc_id, source, 1, 'access', 16, string_split_regex(text, p), regexp_extract_all(text, p, 0), regexp_extract_all(text, p, 0) FROM (SELECT *, 'AKIA[A-Z0-9]+' AS p FROM t)
    UNION ALL SELECT doc_id, source, 2, 'hex', 32, string_split_regex(text, p), regexp_extract_all(text, p, 0), regexp_extract_all(text, p, 0) FROM (SELECT *, '[0-9a-f]+' AS p FROM t)
    UNION ALL SELECT doc_id, source, 3, 'opaque', 20, string_split_regex(text, p), regexp_extract_all(text, p, 0), regexp_extract_all(text, p, 0) FROM (SELECT *, '[A-Za-z0-9+/_-]{20,}' AS p FROM t)),
h AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE list_max(list_transform(vals, lambda v: length(v))) >= least),
s AS (SELECT doc_id, source, rank, kind, vals[i] AS value, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
    length(whole[i]) AS n FROM h WHERE length(vals[i]) >= least),
g AS (SELECT *, kind || ':' || start || ':' || (start + n) AS span FROM s WHERE rank < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))),
o AS (SELECT value, count(DISTINCT source) <= 1 AND count(DISTINCT doc_id) <= 3 AS live FROM g GROUP BY 1),
r AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank, n) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank, n) FILTER (rank < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM g JOIN o USING (value) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN r USING (doc_id)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secret spans; a source is an owner, a document a repository."""
    found = secrets.scan(table(spark, folder, "documents", "doc_id", "text", "source"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
                        secrets.written(F.sort_array(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied")


@query("op4_ngram_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.y) AS component_id FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of linked documents."""
    return ngram_join.classes(table(spark, folder, "documents", "doc_id", "text"), words=4, percent=85).withColumnRenamed("id", "doc_id")


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(packing.pieces(table(spark, folder, "documents", "doc_id", "text"), path))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    grammar = toxicity.fit(toxicity.labelled(docs, table(spark, folder, "labels", "doc_id", "toxic")))
    return toxicity.scored(docs, grammar, keep_text=False).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
    WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays of its group."""
    return exact_dedup.groups_of_copies(table(spark, folder, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op8_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
g AS (SELECT gram FROM o GROUP BY gram HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM o JOIN g USING (gram))),
k AS (SELECT e.doc_id, count(*) FILTER (h.q IS NOT NULL) AS gone, string_agg(e.word, ' ' ORDER BY e.q) FILTER (h.q IS NULL) AS kept
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) e LEFT JOIN h ON h.doc_id = e.doc_id AND h.q = e.q GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words that a repeated window covers."""
    left = substring_dedup.without_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_decontaminate", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, w[p:p + least(10, len(w)) - 1] AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
o AS (SELECT doc_id, k, p, w[p:p + k - 1] AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
h AS (SELECT doc_id, p, o.k, item_id FROM o JOIN g ON g.k = o.k AND g.gram = o.gram),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words that a test item's window covers."""
    found = decontaminate.hits(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's bytes and tokens."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = token_counts.token_counts(table(spark, folder, "documents", "doc_id", "text"), path, keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op11_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, w, 10 + (90 * len(w) * docs) // terms AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS term FROM m) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN t USING (term) JOIN f USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item's ten best documents."""
    return lexical_search.search(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return best_fit.packed(best_fit.pieces(table(spark, folder, "documents", "doc_id", "text"), path))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector's whitened components."""
    return whitening.whitened(table(spark, folder, "embeddings", "vec_id", "embedding"))
