"""Person entries of a biographical work, cut into their fields.

An entry is a run of fields without separators: name, verdict, generation, date of death, marks of collections. Each field but
the first begins with words of its own, its anchor. The anchors are looked for from the end of the entry to its beginning,
each only in what lies before the anchors found so far, and a field is the gap from its anchor to the next one; so no word
belongs to two fields. Everything is a column expression: an entry is read once, in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslink.functions.rules import DIED, GENERATION_WORDS, IN_YEAR, verdict_rank, whole, with_death_year

# Marks of collections, sizes of a generation, words that begin a verdict, a life or another name, and what
# stands before a kunya that is another's.
MARKS = ("خ", "خت", "بخ", "عخ", "ر", "ي", "م", "د", "مد", "صد", "خد", "قد", "ف", "ل", "كد", "ت", "تم", "س", "عس", "كن", "ق", "فق", "ع", "4", "تمييز")
PARTS_OF_GENERATION = ("كبار", "صغار", "أوساط")
VERDICTS = ("أم المؤمنين", "الصحابي", "الصحابية", "صحابي", "صحابية", "له صحبة", "لها صحبة", "له رؤية", "لها رؤية", "ثقة", "صدوقة", "صدوقا", "صدوق",
            "مقبولة", "مقبول", "مستورة", "مستور", "مجهولة", "مجهول", "ضعيفة", "ضعيفا", "ضعيف", "متروكة", "متروكا", "متروك", "لا يعرف", "كذاب", "متهم",
            "لين الحديث", "لا بأس به", "ليس به بأس", "واه", "ساقط", "أمير المؤمنين")
LIVES = ("ولد", "وهو", "كان", "أسلم", "اسلم", "شهد", "استصغر", "قدم", "نزل", "سكن", "روى", "هاجر", "أحد", "من السابقين")
OF_BOTH_TIMES = "مخضرم"
PAGE_MARKS = r"PageV\d+P\d+|\bms\d+\b|\|"

_ORDINALS = "|".join(sorted(GENERATION_WORDS, key=lambda w: (-len(w), w)))
_ORDINAL_WORDS = sorted({w for words in GENERATION_WORDS for w in words.split(" ") if w.endswith("ة")})
GENERATION = whole(rf"من (?:(?:{'|'.join(PARTS_OF_GENERATION)}) )?(?:{_ORDINALS})")
GENERATION_NAMED = whole(rf"الطبقة (?:{_ORDINALS})")
DEATH = whole("|".join(DIED)) + rf"(?: {IN_YEAR[0]}| {IN_YEAR[1]})? .+$"
VERDICT = whole("|".join(VERDICTS))
LIFE = rf"\s{whole('|'.join(LIVES))}"
NOT_HIS = r"(?<!بن )(?<!بنت )"
AFTER = r"(?:عبد \S+|\S+)"
KUNYA = rf"{NOT_HIS}(?<![\p{{L}}\p{{N}}_])(?:أبو|أم) {AFTER}|(?:يكنى|تكنى|كنيته) (?:أبا|أم) {AFTER}"


def written_out(text: Column) -> Column:
    """An entry's text without page marks, with single blanks and ordinals spelt with their own last letter."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, PAGE_MARKS, " "), r"\s+", " "))
    for word in _ORDINAL_WORDS:
        plain = F.regexp_replace(plain, whole(word[:-1] + "ه"), word)
    return plain


def _before_last(text: Column, pattern: str) -> Column:
    """What stands before the last place where the pattern holds; null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, rf"^([\s\S]*){pattern}", 1))


def _before_first(text: Column, pattern: str) -> Column:
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1))


def _after(text: Column, before: Column) -> Column:
    """The rest of ``text`` behind its beginning ``before``."""
    return F.substr(text, F.length(before) + 1, F.length(text))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ ،,]+|[ ،,]+$", "")


def parsed_entries(entries: DataFrame, text: str = "text") -> DataFrame:
    """``entries`` with name, verdict, rank, generation, generation_phrase, death_phrase, death_year, kunya, kunyas, marks and body.

    The marks are the last words of the entry as far as they are marks. Death runs from its word to the end. The generation is
    the last one named before it, or else the first within it, or else a generation named by "of the generation"; only one
    before the death bounds the name and verdict. The verdict begins at its first word, but not at the start of the entry; where
    there is none, the name ends where the life begins. Companions without a generation are of the first, those who knew
    both times of the second. A field that is not there is null, a null entry gives nulls."""
    words = F.split("_plain", " ")
    other = F.array_position(F.reverse(F.transform(words, lambda w: w.isin(*MARKS))), False).cast("int")
    n_marks = F.when(other == 0, F.size(words)).otherwise(other - 1)
    rows = entries.withColumn("_plain", written_out(F.col(text))).withColumn("_n", n_marks)
    rows = rows.withColumn("marks", F.slice(words, F.size(words) - F.col("_n") + 1, F.col("_n")))
    rows = rows.withColumn("body", F.array_join(F.slice(words, 1, F.size(words) - F.col("_n")), " "))
    rows = rows.withColumn("_alive", F.coalesce(_before_first(F.col("body"), DEATH), F.col("body"))).withColumn("_death", _after(F.col("body"), F.col("_alive")))
    rows = rows.withColumn("death_phrase", F.when(F.col("_death") != "", F.col("_death")))
    rows = rows.withColumn("_lived", _before_last(F.col("_alive"), GENERATION))
    said = F.regexp_extract(_after(F.col("_alive"), F.col("_lived")), GENERATION, 0)
    later, named = F.regexp_extract("_death", GENERATION, 0), F.regexp_extract("body", GENERATION_NAMED, 0)
    phrase = F.when(F.col("_lived").isNotNull(), said).when(later != "", later).when(named != "", named)
    bound = F.when(F.col("_lived").isNotNull(), F.col("_lived")).when(later != "", F.col("_alive")).otherwise(F.coalesce(_before_first(F.col("_alive"), GENERATION_NAMED), F.col("_alive")))
    rows = rows.withColumn("generation_phrase", phrase).withColumn("_head", F.trim(bound))
    judged = _before_first(F.col("_head"), VERDICT)
    told = _before_first(_bare(F.col("_head")), LIFE)
    rows = rows.withColumn("_name", F.when(judged != "", judged)).withColumn("_told", F.when(F.col("_name").isNull() & (told != ""), told))
    name = F.coalesce(_bare(F.col("_name")), F.col("_told"), F.col("_head"))
    verdict = F.when(F.col("_name").isNotNull(), _after(F.col("_head"), F.col("_name"))).when(F.col("_told").isNotNull(), _after(_bare(F.col("_head")), F.col("_told")))
    rows = rows.withColumn("name", F.nullif(_bare(name), F.lit(""))).withColumn("verdict", _bare(verdict)).withColumn("rank", verdict_rank(F.col("verdict")))
    number = F.create_map(*[F.lit(x) for pair in GENERATION_WORDS.items() for x in pair])[F.regexp_extract("generation_phrase", whole(_ORDINALS), 0)]
    guessed = F.when(F.col("rank") == 1, 1).when(F.col("body").rlike(whole(OF_BOTH_TIMES)), 2)
    rows = rows.withColumn("generation", F.coalesce(number, guessed).cast("int"))
    rows = with_death_year(rows, "death_phrase", "generation")
    kunya = F.transform(F.regexp_extract_all("body", F.lit(KUNYA), F.lit(0)), lambda k: _bare(F.regexp_replace(F.regexp_replace(k, "^(?:يكنى|تكنى|كنيته) ", ""), "^أبا ", "أبو ")))
    rows = rows.withColumn("kunyas", F.array_distinct(F.filter(kunya, lambda k: F.contains(k, F.lit(" "))))).withColumn("kunya", F.try_element_at("kunyas", F.lit(1)))
    return rows.select(*[c for c in entries.columns if c not in FIELDS], *FIELDS)


FIELDS = ["name", "verdict", "rank", "generation", "generation_phrase", "death_phrase", "death_year", "kunya", "kunyas", "marks", "body"]
