"""Text as column expressions (T1–T4, T12–T14, T26): everything stays in the JVM, no Python per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters deleted by the normaliser, and letters folded to another.
DELETED_RANGES = ((0x0610, 0x061A), (0x064B, 0x065F), (0x06D6, 0x06DC), (0x06DF, 0x06E8), (0x06EA, 0x06ED))
DELETED_SINGLE = "ـٰ'`‘’ʿʾʼ"
FOLDED = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ئ": "ي", "ی": "ي", "ؤ": "و", "ة": "ه", "ک": "ك", "ı": "i"}
# Blocks whose letters have a compatibility or accented form: the fold table is built over these.
FOLD_BLOCKS = ((0x0041, 0x05FF), (0x0700, 0x0DFF), (0x1C80, 0x24FF), (0x2C00, 0x2DFF), (0xA640, 0xA7FF), (0xFB00, 0xFDFF),
               (0xFE20, 0xFEFF), (0xFF01, 0xFFEF))


def fold_character(ch: str) -> str:
    """What one character becomes: nothing, a letter, or several letters."""
    code = ord(ch)
    if ch in DELETED_SINGLE or any(low <= code <= high for low, high in DELETED_RANGES):
        return ""
    if ch in FOLDED:
        return FOLDED[ch]
    if 0x0660 <= code <= 0x0669 or 0x06F0 <= code <= 0x06F9:
        return str(code & 0xF)
    if 0x0600 <= code <= 0x06FF:
        return ch
    base = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
    return "".join(base).casefold().replace("ı", "i")


def _tables() -> tuple[str, str, dict[str, str]]:
    """The translate table (letters to one letter, then the deleted ones) and the letters that become several."""
    one, gone, several = {}, [], {}
    codes = {c for low, high in (*DELETED_RANGES, *FOLD_BLOCKS) for c in range(low, high + 1)}
    codes |= {ord(c) for c in DELETED_SINGLE} | {ord(c) for c in FOLDED} | {*range(0x0660, 0x066A), *range(0x06F0, 0x06FA)}
    for code in sorted(codes):
        ch = chr(code)
        folded = fold_character(ch)
        if folded == ch:
            continue
        if not folded:
            gone.append(ch)
        elif len(folded) == 1:
            one[ch] = folded
        else:
            several[ch] = folded
    return "".join([*one, *gone]), "".join(one.values()), several


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _tables()


def _char_class(characters: str) -> str:
    """A regular-expression class of many characters, neighbouring ones as ranges."""
    codes = sorted(map(ord, characters))
    out, start = [], codes[0]
    for before, code in zip(codes, [*codes[1:], None]):
        if code != before + 1:
            out.append(f"\\x{{{start:x}}}" + (f"-\\x{{{before:x}}}" if before > start else ""))
            start = code
    return "[" + "".join(out) + "]"


# The letters of running Latin text that become several; the rest are rare.
LATIN_SEVERAL = {ch: folded for ch, folded in FOLD_SEVERAL.items() if ord(ch) < 0x0180 and ch.isalpha()}
LATIN_CLASS = _char_class("".join(LATIN_SEVERAL))
RARE_CLASS = _char_class("".join(ch for ch in FOLD_SEVERAL if ch not in LATIN_SEVERAL))
# The class has a hundred ranges and all its letters lie beyond ASCII: only there is it looked through.
RARE_LETTER = rf"[^\x00-\x7F](?<={RARE_CLASS})"


def normalize(text: Column) -> Column:
    """The folded form two spellings of a word share (T1): marks deleted, letters folded, everything lower case.

    Plain ASCII takes the short way; letters that become several are spelt out only in texts that have them, those of
    Latin script one by one, the others (ligatures, fractions) by table."""
    plain = F.octet_length(text) == F.length(text)
    short = F.lower(F.replace(F.replace(text, F.lit("'"), F.lit("")), F.lit("`"), F.lit("")))
    folded = F.translate(text, FOLD_FROM, FOLD_TO)
    latin = folded
    for ch, spelt in LATIN_SEVERAL.items():
        latin = F.replace(latin, F.lit(ch), F.lit(spelt))
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{f}" for c, f in FOLD_SEVERAL.items())), F.lit("\x01"), F.lit("\x02"))
    rare = F.array_join(F.transform(F.split(folded, ""), lambda c: F.when(F.octet_length(c) > 1, F.coalesce(table[c], c)).otherwise(c)), "")
    return F.when(plain, short).when(text.rlike(RARE_LETTER), rare).when(text.rlike(LATIN_CLASS), latin).otherwise(folded)


def normalize_sql(text: str) -> str:
    """The same fold in DuckDB SQL, for the checks (of the several-letter forms, those of Latin script)."""
    for ch, folded in FOLD_SEVERAL.items():
        if ord(ch) < 0x0180:
            text = f"replace({text}, '{ch}', '{folded}')"
    quote = lambda s: s.replace("'", "''")
    return f"translate({text}, '{quote(FOLD_FROM)}', '{quote(FOLD_TO)}')"


WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def words(norm: Column) -> Column:
    """The words of a normalised text."""
    return F.regexp_extract_all(norm, F.lit(f"({WORD}+)"))


def blank_split(norm: Column) -> Column:
    return F.filter(F.split(norm, r"\s+"), lambda w: w != "")


# Joined particles an Arabic word loses, longest first, and the letters kept of other words.
PREFIXES = ("وبال", "فبال", "وال", "فال", "بال", "كال", "لل", "ال")
KEPT_LETTERS = 5
ARABIC = "[؀-ۿ]"
# Every word's first letters, two at least, unless they are digits only.
CUT_WORDS = rf"(?<!\S)(?!\p{{Nd}}{{{KEPT_LETTERS}}}|\p{{Nd}}{{1,{KEPT_LETTERS - 1}}}(?!\S))(\S{{2,{KEPT_LETTERS}}})\S*"


def token(word: Column) -> Column:
    """The index form of one normalised word: an Arabic word without its article and joined particles, any other cut
    to five letters."""
    joined = "^(?:" + "|".join(PREFIXES) + r")(?=[\s\S]{3})"
    bare = F.regexp_replace(word, joined, "")
    lone = F.when(F.substring(word, 1, 1).isin("و", "ف") & (F.length(word) > 4), F.substring(word, 2, 100000)).otherwise(word)
    arabic = F.when(word.rlike(joined), bare).otherwise(lone)
    return F.when(word.rlike(ARABIC), arabic).otherwise(F.substring(word, 1, KEPT_LETTERS))


def tokens(norm: Column) -> Column:
    """The index words of a normalised text, in order (T3): one letter or digits only are left out. A text without Arabic
    letters is read by one pattern, any other word by word."""
    each = F.filter(F.transform(blank_split(norm), token), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{Nd}+\z"))
    return F.when(norm.rlike(ARABIC), each).otherwise(F.regexp_extract_all(norm, F.lit(CUT_WORDS), 1))


# Punctuation that clings to a query word.
CLINGING = "«»“”„\"‘’:;؛،,.!()[]{}<>…–—-/\\|~﴿﴾"


def query_terms(text: Column, mode: Column | str = "all") -> Column:
    """The terms of a query (T4): sentence-final question marks and clinging punctuation are blanks, lone wildcards are
    nothing; distinct words in order, or one phrase."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    asked = F.regexp_replace(normalize(text), rf"(?<={WORD})[?؟]+(?=\s|$)", " ")
    clean = blank_split(F.regexp_replace(asked, "[" + "".join("\\" + c for c in CLINGING) + "]+", " "))
    kept = F.filter(clean, lambda w: ~w.rlike(r"^[?؟*]+$"))
    phrase = F.when(F.size(kept) > 0, F.array(F.array_join(kept, " "))).otherwise(kept)
    return F.when(mode == "phrase", phrase).otherwise(F.array_distinct(kept))


def mostly_arabic(text: Column) -> Column:
    """Whether most letters of the first 400 characters are Arabic."""
    head = F.substring(text, 1, 400)
    arabic = F.length(F.regexp_replace(head, "[^؀-ۿ]", ""))
    letters = F.length(F.regexp_replace(head, r"[^\p{L}]", ""))
    return arabic * 2 > letters


def body_after(text: Column, chain: Column) -> Column:
    """The text after its chain; the whole text where the chain is not found in it."""
    at = F.position(chain, text)
    found = chain.isNotNull() & (F.length(chain) > 0) & (at > 0)
    rest = F.ltrim(F.substring(text, at + F.length(chain), F.length(text)))
    return F.when(found, rest).otherwise(text)


def snippet(text: Column, width: int) -> Column:
    """The beginning of a text up to ``width`` characters, cut at a blank, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.regexp_replace(F.substring(flat, 1, width), r"\s+\S*$", "")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(head, F.lit("…")))


def ce_year(year: Column) -> Column:
    """A lunar year as a solar one."""
    return F.bround(year * 0.970229 + 621.5643).cast("int")


def age_at(event: Column, birth: Column) -> Column:
    """Age in years at an event."""
    return event - birth


def clean(text: Column) -> Column:
    """A field without direction marks, blanks collapsed."""
    flat = F.regexp_replace(text, "[‎‏‪-‮⁦-⁩﻿]", "")
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def number_text(number: Column) -> Column:
    """A number as written, without the ".0" a spreadsheet adds."""
    return F.regexp_replace(clean(number), r"^(\d+)\.0+$", "$1")


def number_key(number: Column) -> Column:
    """The sort key of a number (S4): ``volume:n`` is volume·100000 + n, otherwise the leading number."""
    volume = F.regexp_extract(number, r"^(\d+):(\d+)", 1)
    inside = F.regexp_extract(number, r"^\d+:(\d+)", 1)
    lead = F.regexp_extract(number, r"^(\d+(?:\.\d+)?)", 1)
    return F.when(volume != "", volume.cast("double") * 100000 + inside.cast("double")).otherwise(lead.try_cast("double"))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the normalised text in ``norm``."""
    return df.withColumn("norm", normalize(F.col(text)))
