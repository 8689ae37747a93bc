"""Quality rules, line first. DataFrame functions only.

Each line with a word is tested by four rules: punctuation (symbol or shout runs
at the ends of many words, or a long line that does not end as a sentence does),
stutter (many words that repeat the one before), navigation (cells between bars
or arrows), boilerplate (licence, rights, cookie and sign-in phrases in English,
German, French and Spanish). Failing lines go; a document that loses more than
``max_lost`` of its word characters to them is rejected. Base measures over the
whole text (repeated five-word windows, fewer than ``min_words`` words) can
reject it before.

Nulls and odd rows: a null text has no words and fails the base rules. Lines
without a word are neither tested nor dropped. Repeated rows are judged alike.
An empty table gives an empty result. Extra columns pass through; the result's
columns replace those of the same name. Texts are used whole: all work happens
inside the row, in time n log n of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACED_WORD, ascii_lower, body

# Rule constants, in regular expressions that Java and RE2 read alike (but for STUTTER).
MARK_RUN = r"[!?#*$%&|<>~=_+]{2,}[.,]*(?:[\x20\x09-\x0D]|$)"
SENTENCE_END = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
NAV_CELL = r"(?:^|[\x20\x09-\x0D])(?:\||»|›|·|•|>|::)(?:[\x20\x09-\x0D]|$)"
NAV_SIGN = r"[|»›·•>]|::"
#: A word that the next one repeats.
STUTTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++(?=\1(?:[\x20\x09-\x0D]|$))"
BOILERPLATE = (
    # English
    r"all rights reserved|licensed under|released under the|this work is licensed|terms of (?:use|service)|privacy policy|cookie policy|"
    r"(?:uses|accept|enable) cookies|enable javascript|sign in to|log in to|subscribe to our|click here|copyright (?:©|\(c\))|"
    # German
    r"alle rechte vorbehalten|lizenziert unter|veröffentlicht unter der|nutzungsbedingungen|datenschutzerklärung|cookies (?:zu|akzeptieren)|javascript aktivieren|melden sie sich an|hier klicken|newsletter abonnieren|"
    # French
    r"tous droits réservés|sous licence|publié sous la licence|conditions d'utilisation|politique de confidentialité|accepte[rz] les cookies|activer javascript|connectez-vous|cliquez ici|abonnez-vous|"
    # Spanish
    r"todos los derechos reservados|bajo (?:la )?licencia|publicado bajo la|condiciones de uso|política de privacidad|aceptar (?:las )?cookies|activar javascript|inicia(?:r)? sesión|haga clic aquí|suscríbete a"
)
SYMBOLS = "#*$%&|<>"
RUN_SHARE, NAV_SHARE, LONG_LINE, MAX_LOST, WINDOW = 0.3, 0.2, 40, 0.6, 5
MIN_STUTTER, STUTTER_SHARE, MIN_WORDS = 3, 0.3, 10


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.translate(text, SPACE, ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line of so many words, at least one, breaks a rule. A cheap test goes before each count."""
    runs = line.rlike("[!?#*$%&|<>~=_+]{2}") & (F.regexp_count(line, F.lit(MARK_RUN)) >= RUN_SHARE * words)
    navigation = line.rlike(NAV_SIGN) & (F.regexp_count(line, F.lit(NAV_CELL)) >= F.greatest(F.lit(1.0), NAV_SHARE * words))
    unended = (words >= LONG_LINE) & ~line.rlike(SENTENCE_END)
    stutter = (words > MIN_STUTTER) & (F.regexp_count(line, F.lit(STUTTER)) >= F.greatest(F.lit(float(MIN_STUTTER)), STUTTER_SHARE * words))
    return F.when(runs, True).when(navigation, True).when(unended, True).when(stutter, True).otherwise(ascii_lower(line).rlike(BOILERPLATE))


def _windows(words: Column) -> Column:
    """A 64-bit hash for each window of words; none for a text shorter than a window."""
    n = F.size(words)
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(n >= WINDOW, F.slice(hashes, 1, n - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; and __lines, those with a word."""
    text = body(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACED_WORD))
    d = docs.withColumns({"__words": _words(text), "__lines": lines})
    d = d.withColumn("__grams", _windows(F.col("__words")))
    # words inside windows that the text has twice or more; most texts have no repeat and stop at the first test
    grams = F.col("__grams")
    d = d.withColumn("__order", F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    order = F.col("__order")
    again = F.filter(order, lambda x, k: x["g"].eqNullSafe(F.get(order, k - 1)["g"]) | x["g"].eqNullSafe(F.get(order, k + 1)["g"]))
    d = d.withColumn("__at", F.when(F.size(order) > 0, F.sort_array(F.transform(again, lambda x: x["i"]))))
    at = F.col("__at")
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")))["n"]
    d = d.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": _chars(text).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return d.drop("__words", "__grams", "__order", "__at")


def clean_lines(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the measures, n_failed_lines, lost_chars, kept, and the text without its failing lines."""
    d = measures(docs, text_col, min_words)
    counted = F.transform(F.split(body(text_col), "\n", -1), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(SPACED_WORD)).alias("n")))
    d = d.withColumn("__judged", F.transform(counted, lambda x: F.struct(x["line"].alias("line"), ((x["n"] > 0) & line_fails(x["line"], x["n"])).alias("bad"))))
    d = d.withColumn("__bad", F.filter("__judged", lambda x: x["bad"]))
    lost = F.aggregate("__bad", F.lit(0).cast("long"), lambda s, x: s + _chars(x["line"]))
    d = d.withColumns({"n_failed_lines": F.size("__bad").cast("long"), "lost_chars": lost})
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(max_lost) * F.col("word_chars")))
    left = F.array_join(F.transform(F.filter("__judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    d = d.withColumn(text_col, F.when(F.col("n_failed_lines") > 0, left).otherwise(F.col(text_col)))
    return d.drop("__lines", "__judged", "__bad")


def accepted(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows that clean_lines keeps. They pass a generator, through which the optimiser moves no filter: it would write the rules out again in the filter, many times over."""
    judged = clean_lines(docs, text_col, max_lost, min_words)
    return judged.select(F.inline(F.array(F.struct(*judged.columns)))).where("kept")
