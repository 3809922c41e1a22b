"""Quality rules, lines first: failing lines go, then documents that lose too much text.

A line with a word fails when it
- is navigation: has menu separators (``|``, ``»``, ``›``, ``•``, `` > ``) between short labels, or is a short list
  of labels without a sentence end,
- has no punctuation: is a short label, in words and in characters, without a terminal mark at its end (closing quotes
  and brackets may follow), unless the text runs on: the next line starts in lower case, or this one does and the
  line before has no terminal mark. So wrapped prose is judged as if it stood in one line,
- is boilerplate: says what sites say on every page (cookies, scripts, subscriptions, rights), in a line of few words,
- is mostly symbols: one in ten characters or more is one of ``#*$%&|<>``.

Lines without a word are dropped with no loss. A document is kept when it passes the base rules (at least ten
words, at most 20 % of them in repeated five-word windows) and its remaining lines hold at least half of its word
characters. All is done on one row with array expressions: no shuffle, no Python.

Null texts have no words and are rejected, as are empty ones. Repeated rows are judged alike. A row of a very
long text is sorted once when it has repeated windows, so its cost is n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrays import covered_by_repeats, let

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: Of a document's word characters its kept lines must hold so many hundredths.
LEAST_KEPT_PERCENT = 50
#: A line of at most so many words may be judged boilerplate, and of at most so many characters too an unfinished label.
SHORT_LINE_WORDS, SHORT_LINE_CHARS = 12, 40

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
_TERMINAL = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
_MENU = r"(?:\||»|›|•|·|→)|\x20>\x20"
_STARTS_LOW = r"^[\x20\x09-\x0D]*\p{Ll}"
#: Phrases of page furniture in English, German, French and Spanish, in lower case.
_BOILERPLATE = (
    r"\b(?:cookie policy|cookies|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|javascript is|"
    r"sign up|log ?in|sign in|subscribe|newsletter|share (?:this|on)|follow us|read more|click here|powered by|skip to content|"
    r"impressum|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|jetzt anmelden|folgen sie uns|weiterlesen|"
    r"mentions légales|tous droits réservés|se connecter|inscrivez-vous|abonnez-vous|suivez-nous|lire la suite|"
    r"aviso legal|todos los derechos reservados|iniciar sesión|suscríbete|síguenos|leer más)\b"
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    """\\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def _word_chars(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit(_SPACE))


def line_fails(line: Column, before: Column, following: Column) -> Column:
    """``before`` and ``following`` are the lines around it, null where there is none."""
    few = F.regexp_count(line, F.lit(f"{_WORD}+")) <= SHORT_LINE_WORDS
    ends = line.rlike(_TERMINAL)
    symbols = 10 * F.regexp_count(line, F.lit(_SYMBOLS)) >= _word_chars(line)
    menu = line.rlike(_MENU) & ~ends
    runs_on = F.coalesce(following.rlike(_STARTS_LOW), F.lit(False)) | (line.rlike(_STARTS_LOW) & F.coalesce(~before.rlike(_TERMINAL), F.lit(False)))
    label = (F.length(line) <= SHORT_LINE_CHARS) & ~ends & ~runs_on
    return symbols | menu | (few & (label | F.lower(line).rlike(_BOILERPLATE)))


def rules(text: Column) -> Column:
    """All measures, the cleaned text and the verdict of one text, as a struct.

    Words, lines and kept lines are bound once, so that no measure splits the text again.
    """
    text = F.coalesce(text, F.lit(""))

    def measured(words: Column, lines: Column, good: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            covered_by_repeats(words, WINDOW).alias("n_repeat_words"),
            (F.size(lines) - F.size(good)).cast("long").alias("lines_removed"),
            F.array_join(good, "\n").alias("cleaned"),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
        left = _word_chars(m["cleaned"]).cast("long")
        own = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "cleaned")]
        kept = ~failed & (100 * left >= LEAST_KEPT_PERCENT * m["word_chars"])
        return F.struct(*own, failed.alias("base_failed"), left.alias("chars_left"), kept.alias("kept"))

    def with_lines(words: Column, lines: Column) -> Column:
        good = F.filter(lines, lambda line, i: ~line_fails(line, F.get(lines, i - 1), F.get(lines, i + 1)))
        return let(good, lambda g: let(measured(words, lines, g), verdict))

    return let(words_of(text), lambda w: let(_lines(text), lambda ls: with_lines(w, ls)))


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "chars_left"]


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, kept, lines_removed and chars_left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rules(F.col("text")).alias("r"))
    return rows.select("doc_id", *[f"r.{c}" for c in _MEASURES])


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with their failing lines removed and ``n_chars`` counted anew; other columns as they are."""
    # A filter on r.kept would be pushed below the projection with a second copy of all rules.
    kept = docs.select(F.struct("*").alias("d"), F.explode(F.filter(F.array(rules(F.col("text"))), lambda r: r["kept"])).alias("r"))
    changed = {"text": F.col("r.cleaned"), "n_chars": F.length("r.cleaned").cast("long")}
    return kept.select(*[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
