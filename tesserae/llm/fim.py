"""Fill-in-the-middle: texts cut at two drawn places and written prefix-suffix-middle or suffix-prefix-middle.

An Arrow-batched function does all of it where the rows lie. A finditer over a text matches runs of up to RUN units, the
regex library keeps where each repetition of the unit ended, and those places go to a compact array of 32-bit numbers; the
two drawn counts are looked up there and the text is sliced. The draws are the hash of a key and the row's id, so a task
that runs again draws the same. No rows are shuffled.

Defined results for odd input:
- a null text is an empty one; an empty text, or one that holds a mark, stays plain;
- characters that no unit covers belong to the unit after them, at the end to the suffix; with no unit at all, prefix and
  middle are empty;
- a null id is drawn for like an id spelled as nothing; rows that repeat an id are drawn alike, row by row;
- an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the marks, the seed's key, and the shares in per cent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KEY, CUT_SHARE, SPM_SHARE = "1:", 90, 20
#: Units: code points, words with the space behind them, lines with their end.
CHARACTERS, WORDS, LINES = r"(?s:.)", r"\S+\s*", r"[^\n]*\n|[^\n]+"
#: Units that one match takes; where runs are parted changes nothing.
RUN = 256


class Cut(NamedTuple):
    """A text's form, its units, and the code points of its prefix and middle (None where plain)."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(key: str, id_: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row."""
    hexes = hashlib.sha256(f"{key}{'' if id_ is None else id_}".encode()).hexdigest()
    return tuple(int(hexes[at : at + 8], 16) for at in range(0, 32, 8))


def runs_of(unit: str) -> regex.Pattern:
    """The pattern of runs of a unit, each repetition kept."""
    return regex.compile(f"(?:(?P<unit>{unit})){{1,{RUN}}}")


def unit_ends(text: str, runs: regex.Pattern) -> array:
    """Where each unit of the text ends, in code points."""
    ends = array("I")
    for match in runs.finditer(text):
        ends.fromlist(match.ends("unit"))
    return ends


def cut(text: str, id_: int | None, runs: regex.Pattern, key: str = KEY, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> Cut:
    """A text written in the form drawn for it."""
    ends = unit_ends(text, runs)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, id_)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= cut_share:
        return Cut(n, "plain", None, None, text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text that was cut, from what was written and its form alone."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, rest = output.removeprefix(one).split(two, 1)
    tail, middle = rest.split(MIDDLE, 1)
    return head + middle + tail if form == "psm" else tail + middle + head


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_CUT = "n long, form string, prefix_chars long, middle_chars long"


def _cut_function(unit: str, key: str, cut_share: int, spm_share: int, digests: bool):
    """The pandas UDF: for an id and a text the fields of ``_CUT``, and either the output or its and the rebuilt text's digest."""
    names = ["n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("output",))]

    @F.pandas_udf(_CUT + (", output_sha256 string, restored_sha256 string" if digests else ", output string"))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        runs = runs_of(unit)
        for ids, texts in batches:
            found = []
            for id_, text in zip(ids, texts, strict=True):
                made = cut(text or "", None if id_ is None else int(id_), runs, key, cut_share, spm_share)
                found.append((*made[:4], _digest(made.output), _digest(restore(made.output, made.form))) if digests else made)
            out = pd.DataFrame(found, columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def transformed(
    docs: DataFrame, unit: str = CHARACTERS, key: str = KEY, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, n (units), form, prefix_chars, middle_chars and output; instead of the last, on
    request, the SHA-256 of the output and of the text rebuilt from it.

    ``cut_share`` per cent of the texts are cut, ``spm_share`` per cent of those start with the suffix.
    """
    run = _cut_function(unit, key, cut_share, spm_share, digests)
    # ids go as text, so that a null doesn't turn the others into floating-point numbers
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return narrow.select("_id", run(F.col("_id").cast("string"), "_text").alias("_cut")).select(F.col("_id").alias(id_col), "_cut.*")


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", out_col: str = "text") -> DataFrame:
    """``rows`` and the text that each was cut from; a null output gives a null text."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return rows.withColumn(out_col, run(F.col(output_col), F.col(form_col)))
