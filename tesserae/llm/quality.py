"""Quality rules, line first, with DataFrame functions alone.

``base_signals`` counts what the whole text shows. ``clean_lines`` then judges every line by three rules and removes the
lines that fail; a document that loses too much of its text that way is rejected, others go on with what is left.

Rules for a line (a line without a word is kept as it is):
- punctuation: more than SYMBOLS_PER_WORD marks of `SYMBOLS` a word, or more than DOUBLED_SHARE of its words end in a
  doubled mark, or it has MIN_RUN words or more and none of them ends in a sentence mark or comma;
- navigation: SEPARATOR_SHARE of its words or more are bare separators, or it is short and all its words are menu words;
- boilerplate: it holds a fixed phrase of web pages, repeats an earlier line of the document, or more than
  STUTTER_SHARE of its words repeat the word before them.

Defined results for odd input: a null or empty text has no words, fails the base rules and is rejected; copies and
repeated rows are judged alike; lines and texts may be of any length; an empty table gives an empty result; other columns
play no part and ``clean`` returns them.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
BASE_SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

# Fixed values of the method.
SYMBOLS = "#*$%&|<>{}[]\\^~=_@+"
STOPS = ".!?…;:,।॥؟۔،。．！？；：、，"
SYMBOLS_PER_WORD = 0.3
DOUBLED_SHARE = 0.3
MIN_RUN = 25
SEPARATOR_SHARE = 0.15
STUTTER_SHARE = 0.3
LOST_SHARE = 0.3
SEPARATORS = ("|", "»", "›", ">", "»»", "·", "•", "/", "::")
MENU = ("home", "about", "contact", "login", "logout", "register", "menu", "search", "next", "previous", "back", "top", "help", "faq", "sitemap", "share", "print", "more", "us", "sign", "in", "up")
PHRASES = ("cookie policy", "accept all cookies", "uses cookies", "all rights reserved", "terms of use", "terms of service", "privacy policy", "enable javascript", "lorem ipsum", "click here to", "subscribe to our newsletter", "back to top", "skip to content")


def words_of(text: Column) -> Column:
    """The words of a text, or of a line: one-byte replacements and a one-character split, which need no regex engine."""
    for mark in SPACES[1:]:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _count_of(text: Column, marks: str) -> Column:
    return F.regexp_count(text, F.lit("[" + re.sub(r"([\[\]\\^&-])", r"\\\1", marks) + "]"))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur again: sorted by hash, equal windows lie together; their places, sorted, are then
    summed as intervals of WINDOW words."""

    def starts(pairs: Column) -> Column:
        again = F.transform(
            pairs,
            lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]),
        )
        return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

    def total(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
            lambda t, i: F.struct((t["sum"] + F.least(F.lit(WINDOW), i - t["last"])).alias("sum"), i.alias("last")),
            lambda t: t["sum"],
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(pairs, starts), total)


def _joined(hashes: Column, by: int) -> Column:
    """Hashes of runs twice as long: each run with the one ``by`` places on."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, by + 1, n), lambda x, y: F.xxhash64(x, y))


def base_signals(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and the base counts of the whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, words, runs = F.coalesce(F.col(text_col), F.lit("")), f"{prefix}_words", f"{prefix}_runs"
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = docs.withColumn(words, words_of(text))
    # windows of 1, 2, 4 and then WINDOW words
    out = out.withColumn(runs, F.transform(words, lambda w: F.xxhash64(w)))
    for by in (1, 2, 4):
        out = out.withColumn(runs, _joined(F.col(runs), by))
    # most texts repeat no window: those end at the count of distinct hashes
    repeated = F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(_covered(F.col(runs)))
    out = out.withColumns(
        {
            f"{prefix}n_words": F.size(words).cast("long"),
            f"{prefix}word_chars": F.length(F.array_join(words, "")).cast("long"),
            f"{prefix}n_symbols": _count_of(text, BASE_SYMBOLS).cast("long"),
            f"{prefix}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{prefix}n_repeat_words": repeated.cast("long"),
        }
    )
    failed = (F.col(f"{prefix}n_words") < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > REPEAT_PERCENT * F.col(f"{prefix}n_words"))
    return out.withColumn(f"{prefix}base_failed", failed).drop(words, runs)


def _line_verdict(line: Column) -> Column:
    """Why a line fails, or null: 'punctuation', 'navigation' or 'boilerplate'."""
    low = F.lower(line)
    phrase = reduce(or_, (low.contains(x) for x in PHRASES))
    # marks that words end in, and words that the next one repeats, counted on the line as a whole
    doubled = F.regexp_count(line, F.lit(r"[!?.]{2,}+(?=[\x20\x09-\x0D]|$)"))
    stops = F.regexp_count(line, F.lit(f"[{STOPS}][\"'”’)\\]]*+(?=[\\x20\\x09-\\x0D]|$)"))
    stutters = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]\1(?:[\x20\x09-\x0D]|$))"))

    def judged(words: Column) -> Column:
        n = F.size(words)
        bars = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
        menu = (n <= 8) & (F.size(F.filter(words, lambda w: ~F.lower(w).isin(*MENU, *SEPARATORS))) == 0)
        return (
            F.when(n == 0, F.lit(None).cast("string"))
            .when((_count_of(line, SYMBOLS) > SYMBOLS_PER_WORD * n) | (doubled > DOUBLED_SHARE * n) | ((n >= MIN_RUN) & (stops == 0)), "punctuation")
            .when(((bars > 0) & (bars >= SEPARATOR_SHARE * n)) | menu, "navigation")
            .when(phrase | ((n >= 4) & (stutters > STUTTER_SHARE * n)), "boilerplate")
        )

    return _let(words_of(line), judged)


def judged_lines(text: Column) -> Column:
    """The lines of a text as structs of ``line``, ``why`` (null: it stays) and ``blank``, a wordless line's number (else null)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    blank = lambda x, i: F.when(F.trim(x, F.lit(SPACES)) == "", i)
    return F.transform(lines, lambda x, i: F.struct(x.alias("line"), _line_verdict(x).alias("why"), blank(x, i).alias("blank")))


def verdict(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with base signals, the cleaned text, the share of characters lost and kept."""
    out = base_signals(docs, text_col, prefix)
    judged, first = f"{prefix}_judged", f"{prefix}_first"
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = out.withColumn(judged, judged_lines(text))
    # a line that repeats an earlier one goes too: array_distinct keeps the first of equal lines and their order, and the
    # numbers of wordless lines keep those apart
    left = F.when(F.col(f"{prefix}n_dup_lines") > 0, F.array_distinct(F.col(judged))).otherwise(F.col(judged))
    out = out.withColumn(first, F.transform(F.filter(left, lambda x: x["why"].isNull()), lambda x: x["line"]))
    cleaned = F.array_join(F.col(first), "\n")
    out = out.withColumn(f"{prefix}cleaned_text", cleaned)
    total = F.col(f"{prefix}word_chars")
    lost = total - F.length(F.regexp_replace(F.col(f"{prefix}cleaned_text"), SPACE, ""))
    out = out.withColumn(f"{prefix}lost_share", F.when(total == 0, F.lit(0.0)).otherwise(lost / total))
    kept = ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}lost_share") <= LOST_SHARE)
    return out.withColumn(f"{prefix}kept", kept).drop(judged, first)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, lost_share and kept."""
    out = verdict(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns: rejected rows are gone, the others' text is what the rules left of it."""
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = f"c{docs.columns.index(text_col)}"
    # a filter on q_kept itself would be pushed below and judge each text again; one on what explode returns isn't
    judged = F.explode(F.array(F.struct("q_kept", "q_cleaned_text"))).alias("q")
    out = verdict(inner, at, "q_").select(*inner.columns, judged).filter("q.q_kept").withColumn(at, F.col("q.q_cleaned_text"))
    return out.select(*inner.columns).toDF(*docs.columns)
