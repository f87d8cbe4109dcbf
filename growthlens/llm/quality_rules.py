"""Quality rules: a threshold table compiled into one projection of length,
symbol, stop-word and line ratios. No user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

#: Frequent function words of English, French, German and Spanish,
#: then of Italian, Portuguese, Romanian, Dutch, the Scandinavian languages,
#: Polish, Czech, Russian, Ukrainian, Turkish, Finnish, Hungarian, Indonesian and
#: Vietnamese.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "be", "this",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "dans", "du", "est", "par", "pour",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "dem", "nicht", "auf", "sich",
    "el", "los", "las", "del", "y", "se", "no", "con", "su", "al", "lo", "es", "una", "para",
    "il", "di", "che", "per", "non", "sono", "della", "si", "da",
    "os", "do", "em", "um", "uma", "com", "não", "mais", "ao",
    "și", "în", "cu", "care", "pe", "este", "nu",
    "het", "een", "van", "dat", "niet", "te", "zijn", "voor", "met", "op",
    "och", "att", "som", "på", "är", "för", "av", "med", "til", "og", "ikke", "det", "den", "jeg",
    "na", "że", "nie", "jest", "do", "to", "się", "jak", "po",
    "je", "že", "ve", "byl", "ale",
    "и", "в", "не", "на", "что", "с", "по", "это", "как", "он", "а", "к", "но", "из", "у",
    "і", "та", "що", "з", "за", "до", "як", "є", "від",
    "bir", "bu", "da", "için", "ile", "olarak", "çok",
    "ja", "on", "ei", "se", "että", "oli", "mutta",
    "az", "és", "hogy", "egy", "nem", "is", "meg",
    "yang", "dan", "itu", "dengan", "untuk", "ini", "pada",
    "và", "của", "là", "có", "không", "một", "cho", "được",
)
#: Letters of the scripts that these are written in. In texts of other scripts,
#: where most letters are none of these, stop words say nothing.
STOP_LETTERS = "a-zA-Z\u00c0-\u024f\u1e00-\u1eff\u0400-\u04ff"


class Rule(NamedTuple):
    """A document fails where scale * measure lies beyond limit * per."""

    name: str
    measure: str
    per: str | None
    op: str  # "<" fails below, ">" fails above
    limit: int
    scale: int = 100
    from_words: int = 0  # applies to documents of so many words
    known_script: bool = False  # applies where most letters are of STOP_LETTERS


#: Whole-number thresholds: ``scale * measure OP limit * per`` means failed.
THRESHOLDS = (
    Rule("too_few_words", "n_words", None, "<", 10, 1),
    Rule("repeated_windows", "n_repeat_words", "n_words", ">", 20),
    Rule("short_words", "word_chars", "n_words", "<", 200),
    Rule("long_words", "word_chars", "n_words", ">", 2000),
    Rule("symbols", "n_symbols", "n_words", ">", 10),
    Rule("few_stop_words", "n_stop_words", None, "<", 2, 1, 50, True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", ">", 50),
)
#: The rules that every document is held to whatever the rest of the table says.
BASE = ("too_few_words", "repeated_windows")


def _fails(rule: Rule) -> Column:
    bound = F.lit(rule.limit) * (F.col(rule.per) if rule.per else F.lit(1))
    value = F.lit(rule.scale) * F.col(rule.measure)
    failed = value < bound if rule.op == "<" else value > bound
    failed = failed & (F.col("n_words") >= rule.from_words) if rule.from_words else failed
    return failed & (2 * F.col("n_stop_letters") >= F.col("word_chars")) if rule.known_script else failed


#: Words covered by 5-word windows that occur at least twice. ``q_win`` holds a
#: 64-bit hash per window; only texts where one repeats are sorted. From the
#: sorted start positions of such windows, each adds what it reaches beyond the
#: one before.
_REPEATED = """
CASE WHEN size(q_win) = size(array_distinct(q_win)) THEN 0L ELSE
  element_at(transform(array(array_sort(transform(q_win, (h, i) -> struct(h, i)))), s ->
    element_at(transform(array(array_sort(transform(
      filter(sequence(0, size(s) - 1), k -> get(s, k).h <=> get(s, k - 1).h OR get(s, k).h <=> get(s, k + 1).h),
      k -> get(s, k).i))), p ->
      aggregate(sequence(0, size(p) - 1), 0L,
        (a, k) -> a + least(5, coalesce(get(p, k) - get(p, k - 1), 5)))), 1)), 1)
END"""


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the measures the threshold table names."""
    text = text_of(text_col)
    base = [c for c in docs.columns if c not in MEASURES]
    trimmed = docs.select(*base, F.btrim(text, F.lit(SPACE)).alias("q_text"),
                          F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("q_lines"))
    words = (F.when(F.col("q_text") == "", F.array().cast("array<string>"))
             .otherwise(F.split("q_text", "[ \\t-\\r]+")))
    split = trimmed.select(
        *base, words.alias("q_words"), "q_lines", "q_text",
        F.char_length(F.regexp_replace("q_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    # Hashes of 2, then 4, then 5 words at every position; the last four are of
    # shorter windows, equal to no other.
    pairs = F.transform("q_words", lambda w, i: F.xxhash64(w, F.get("q_words", i + 1)))
    split = split.withColumn("q_pairs", pairs)
    quads = F.transform("q_pairs", lambda p, i: F.xxhash64(p, F.get("q_pairs", i + 2)))
    windows = F.transform("q_quads", lambda q, i: F.xxhash64(q, F.get("q_pairs", i + 3)))
    hashed = split.select(
        *base, "n_symbols",
        F.size("q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect(F.split(F.lower("q_text"), r"[^\p{L}]+"), F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        F.char_length(F.regexp_replace("q_text", f"[^{STOP_LETTERS}]+", "")).cast("long").alias("n_stop_letters"),
        "q_pairs", quads.alias("q_quads"))
    done = [c for c in MEASURES if c != "n_repeat_words"]
    hashed = hashed.select(*base, *done, windows.alias("q_win"))
    # By way of a generator of one row: a filter on a verdict stays above it,
    # where the optimiser would otherwise repeat the measures' expressions.
    each = F.struct(*done, F.expr(_REPEATED).cast("long").alias("n_repeat_words"))
    return hashed.select(*base, F.inline(F.array(each)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_stop_letters", "n_repeat_words")


def quality_rules(docs: DataFrame, text_col: str = "text",
                  rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """``docs`` plus the measures, base_failed, failed_rules and kept.

    Words are runs of non-space (ASCII white space); a null or empty text has
    none and fails the length rule. n_symbols counts ``#*$%&|<>``; n_dup_lines
    the lines with a word that equal an earlier one; n_stop_words the distinct
    stop words in any case and without punctuation, of eighteen languages;
    n_stop_letters the letters of their scripts; n_repeat_words the words in
    5-word windows found twice or more. Repeated rows are judged alike, texts of
    any length whole.
    Columns of ``docs`` named like a measure or verdict are replaced.
    """
    verdicts = ("base_failed", "failed_rules", "kept")
    m = measures(docs.drop(*verdicts), text_col)
    failed = F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    by_name = {r.name: r for r in (*THRESHOLDS, *rules)}
    base = _fails(by_name[BASE[0]]) | _fails(by_name[BASE[1]])
    return m.select("*", base.alias("base_failed"), failed.alias("failed_rules")).select(
        "*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
