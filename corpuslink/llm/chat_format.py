"""Chat formatting: records of different layouts become canonical turns, and conversations become one training text each.

Layouts are told apart by schema fingerprints. A record is a JSON text; its nested field paths (the variant's schema without
the scalar types) are hashed, and the hash selects a declarative mapping: the record's type and one expression that gives its
turns. A record of an unknown layout gives no turns; ``unknown_layouts`` counts those by fingerprint, so that none is lost in
silence.

The template writes a turn as ``### role: text</turn>`` and a line feed. Control strings inside a role or a text are escaped
with a backslash and a letter, the backslash itself as ``\\b``, so that every backslash in the output begins an escape and the
template's own marks occur nowhere else; reading back is a chain of plain replacements.

Everything is DataFrame functions. Defined cases: a null text or role is empty; turns of one conversation are ordered by turn
(null first), then by their place in their record, role and text, so that ties and repeated rows have one order and all are
kept; a null conversation id is a conversation of its own; an empty table gives an empty table; other columns are not read.
A conversation is one output value, so it has to fit a JVM string, and a JSON field of over 20 million characters raises an
error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.llm.arrays import running

SCALARS = r"(?<=[:<] )(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\([0-9, ]+\)|DATE|TIMESTAMP|BINARY)|(?<=<)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\([0-9, ]+\))"
TURN = "struct<turn:bigint,at:int,role:string,text:string>"
END = "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """``paths``: the fields, nested in OBJECT<…> and ARRAY<…>, with _ for any scalar, names in order. ``kind``: the record's
    type. ``turns``: an expression over the parsed record ``r`` that gives (turn, role, text) structs."""

    name: str
    paths: str
    kind: str
    turns: str


def _said(*pairs: tuple[str, str]) -> str:
    parts = ", ".join(f"named_struct('turn', CAST({i} AS BIGINT), 'role', {role}, 'text', {text})" for i, (role, text) in enumerate(pairs))
    return f"array({parts})"


def _list(field: str, role: str, text: str) -> str:
    return f"transform(r.{field}, (m, i) -> named_struct('turn', CAST(i AS BIGINT), 'role', m.{role}, 'text', m.{text}))"


FROM = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
LAYOUTS = (
    Layout("turn row", "OBJECT<role: _, text: _, turn: _>", "turn bigint, role string, text string",
           "array(named_struct('turn', r.turn, 'role', r.role, 'text', r.text))"),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", "messages array<struct<role:string,content:string>>", _list("messages", "role", "content")),
    Layout("no messages", "OBJECT<messages: ARRAY<_>>", "messages array<struct<role:string,content:string>>", _list("messages", "role", "content")),
    Layout("from and value", "OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", "conversations array<struct<from:string,value:string>>",
           f"transform(r.conversations, (m, i) -> named_struct('turn', CAST(i AS BIGINT), 'role', {FROM}, 'text', m.value))"),
    Layout("prompt and response", "OBJECT<prompt: _, response: _>", "prompt string, response string", _said(("'user'", "r.prompt"), ("'assistant'", "r.response"))),
    Layout("prompt and completion", "OBJECT<completion: _, prompt: _>", "prompt string, completion string", _said(("'user'", "r.prompt"), ("'assistant'", "r.completion"))),
    Layout("instruction", "OBJECT<instruction: _, output: _>", "instruction string, output string", _said(("'user'", "r.instruction"), ("'assistant'", "r.output"))),
    Layout("instruction with input", "OBJECT<input: _, instruction: _, output: _>", "instruction string, input string, output string",
           _said(("'user'", "concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))"), ("'assistant'", "r.output"))),
    Layout("system, prompt and response", "OBJECT<prompt: _, response: _, system: _>", "system string, prompt string, response string",
           _said(("'system'", "r.system"), ("'user'", "r.prompt"), ("'assistant'", "r.response"))),
)


def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON text, names in order, scalar types as _."""
    return F.regexp_replace(F.schema_of_variant(F.parse_json(record)), SCALARS, "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, turn, at, role, text): the turns of every record of a known layout. ``at``: the place within the record."""
    rows = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"), fingerprint(F.col(record_col)).alias("print"))
    cases = " ".join(f"WHEN print = xxhash64('{layout.paths}') THEN {_mapped(layout)}" for layout in layouts)
    rows = rows.select("id", F.expr(f"CASE {cases} END").alias("turns")).select("id", F.posexplode("turns").alias("at", "t"))
    return rows.select("id", F.col("t.turn").alias("turn"), "at", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def _mapped(layout: Layout) -> str:
    """The layout's expression over the parsed record; the record is parsed once."""
    return f"transform(array(from_json(record, '{layout.kind}', map('maxStringLen', '2147483647', 'mode', 'FAILFAST'))), r -> {layout.turns})[0]"


def unknown_layouts(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(paths, records): the layouts without a mapping."""
    known = [layout.paths for layout in layouts]
    return records.select(field_paths(F.col(record_col)).alias("paths")).where(~F.col("paths").isin(known)).groupBy("paths").agg(F.count("*").alias("records"))


def escaped(text: Column, role: bool = False) -> Column:
    for raw, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), *(((":", "\\c"),) if role else ())):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for code, raw in (("\\h", "###"), ("\\e", "</turn>"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def formatted(turns: DataFrame, speaker: str = "assistant") -> DataFrame:
    """(id, formatted, loss_spans): one text per conversation and the spans under the loss mask, which are the texts of
    ``speaker`` (code points, end exclusive)."""
    order = F.sort_array(F.collect_list(F.struct("turn", "at", "role", "text")))
    rows = turns.groupBy("id").agg(order.alias("turns"))
    coded = F.transform("turns", lambda t: F.struct(F.concat(F.lit("### "), escaped(t["role"], True), F.lit(": ")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == speaker).alias("loss")))
    rows = rows.select("id", coded.alias("turns"))
    lengths = F.transform("turns", lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END))
    rows = rows.select("id", F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"), "turns", running(lengths).alias("starts"))
    spans = F.zip_with("turns", "starts", lambda t, at: F.struct((at + F.char_length(t["head"])).alias("start"), (at + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end"), t["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return rows.select("id", "formatted", spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(text, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: F.substring_index(F.substr(p, F.lit(5)), ": ", 1)
    return F.transform(parts, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substr(p, F.char_length(role(p)) + 7)).alias("text")))


def under_mask(text: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: one element per span."""
    return F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
