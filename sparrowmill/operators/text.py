"""Text normal forms, tokens and masks as column expressions.

The normal forms differ on purpose: each belongs to another consumer, and they are not one.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: letters with marks and their plain forms, stop words
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"
ACCENTED_UPPER = "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ"
PLAIN_UPPER = "AAAAEEEEIIIIOOOOUUUU"
STOPWORDS = ["the", "of", "and", "to", "in", "de", "la", "el", "y", "en", "der", "die", "und", "le", "les"]


def folded(c: Column) -> Column:
    """Small letters without marks; ñ becomes n."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def folded_words(c: Column) -> Column:
    """:func:`folded`, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(folded(c), "[^a-z0-9]+", " "))


def name_form(c: Column) -> Column:
    """Capitals without marks but with Ñ, other characters as single spaces; null if nothing stays."""
    plain = F.translate(F.upper(c), ACCENTED_UPPER, PLAIN_UPPER)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(plain, "[^A-ZÑ ]", " "), " +", " ")), F.lit(""))


def spoken_form(c: Column) -> Column:
    """Small letters with their marks, punctuation as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def without_digits(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[0-9]", " "))


def tidy_spaces(c: Column) -> Column:
    """Plain spaces for other kinds, no zero-width marks, at most one blank line."""
    t = F.translate(F.translate(c, "   \t", "    "), "​‌‍﻿", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " +", " "), " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Folded alphanumeric tokens without stop words, which the pattern itself passes over."""
    stop = STOPWORDS if stopwords is None else stopwords
    pattern = f"(?<![a-z0-9])(?!(?:{'|'.join(stop)})(?![a-z0-9]))([a-z0-9]+)" if stop else "([a-z0-9]+)"
    return F.regexp_extract_all(folded(c), F.lit(pattern), F.lit(1))


# fixed values: the suffixes that the two stems know, in their order


def light_stem(w: Column) -> Column:
    """Light plural stem: -ciones to -cion, consonant + es, then -s but not -ss."""
    before = lambda n: F.substring(w, -n, 1)
    without = lambda n: F.left(w, F.length(w) - n)
    return (
        F.when((F.length(w) <= 3) | (F.translate(w, "0123456789", "") == ""), w)
        .when(w.endswith("ciones"), without(2))
        .when(w.endswith("es") & ~before(3).isin(*"aeiou"), without(2))
        .when(w.endswith("s") & (before(2) != "s"), without(1))
        .otherwise(w)
    )


def coarse_stem(w: Column) -> Column:
    """The other stem: -ces to -z, -es, -s."""
    return (
        F.when((F.length(w) <= 3) | w.rlike("^[0-9]+$"), w)
        .when(w.rlike("ces$"), F.regexp_replace(w, "ces$", "z"))
        .when(w.rlike("es$") & (F.length(w) > 4), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def useful_characters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def alphabetic_share(c: Column) -> Column:
    """Letters over characters that are not white space; 0 for a blank text."""
    shown = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.when(shown > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / shown).otherwise(0.0)


#: Kinds of personal data, in the order in which they are masked.
PERSONAL = [
    ("EMAIL", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("URL", r"(https?://|www\.)[^ \n\t]+"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("PHONE", r"(\+?[0-9]{1,3}[ .-])?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"),
]
#: Phrases that tell a career's length, by a small grammar: a span is an amount and a unit; it stands
#: up to three words before a word for work, or up to two after one, or qualifies a noun.
_AMOUNT = "([0-9]{1,2}[+]?|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|several)"
_UNIT = "(years?|yrs?|decades?)"
_WORK = "(experience|expertise|career|practice|service|tenure)"
LEAKS = [
    ("span_before_work", rf"(?i)\b{_AMOUNT} {_UNIT}( [a-z]+){{0,3}} {_WORK}\b"),
    ("work_before_span", rf"(?i)\b{_WORK}( [a-z]+){{0,2}}[: ]+{_AMOUNT} {_UNIT}\b"),
    ("span_as_quality", rf"(?i)\b{_AMOUNT}-{_UNIT}[ -][a-z]+\b"),
    ("decades", rf"(?i)\b(a|{_AMOUNT}) decades?\b"),
]


def masked(c: Column, patterns: list[tuple[str, str]], mark: str | None = None) -> Column:
    """Every match of each pattern in turn replaced by its name in brackets, or by ``mark``."""
    for name, pattern in patterns:
        c = F.regexp_replace(c, pattern, mark or f"[{name}]")
    return c


def mask_counts(df: DataFrame, column: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """How many matches of each pattern the texts hold before any masking."""
    return df.agg(*[F.coalesce(F.sum(F.regexp_count(column, F.lit(p))), F.lit(0)).alias(n.lower()) for n, p in patterns])


def edit_distance(a: list, b: list) -> int:
    """Least number of insertions, deletions and replacements between two sequences.

    A row of the table at a time: insertions along a row are a running minimum.
    """
    names: dict = {}
    left, right = (np.array([names.setdefault(x, len(names)) for x in s], np.int64) for s in (a, b))
    steps = np.arange(len(right) + 1)
    row = steps.copy()
    for i, x in enumerate(left.tolist(), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (right != x))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - steps) + steps
    return int(row[-1])


def word_error_counts(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance of two word arrays of any length; null if either is."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(reference, hypothesis)


def year_tokens(c: Column) -> Column:
    """Years 1900 to 2099 that no other digit touches."""
    return F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))


YEAR = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it and in whatever lambda."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)


def shifted_years(c: Column, by: int) -> Column:
    """A text with every year moved by the same number of years."""

    def moved(t: Column) -> Column:
        years = F.transform(F.regexp_extract_all(t, F.lit(f"({YEAR})"), F.lit(1)), lambda y: (y.cast("int") + by).cast("string"))
        return F.array_join(F.zip_with(F.split(t, YEAR), F.concat(years, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return bound(c, moved)


def without_block(c: Column, number: int, opens: str) -> Column:
    """A text without its ``number``-th block, from 0; ``opens`` matches the line that begins a block."""

    def kept(lines: Column, begins: Column) -> Column:
        first, end = F.get(begins, number), F.coalesce(F.get(begins, number + 1), F.size(lines))
        return F.when(first.isNull(), lines).otherwise(F.concat(F.slice(lines, F.lit(1), first), F.slice(lines, end + 1, F.size(lines) - end)))

    begins = lambda lines: F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(opens), i)))
    return F.array_join(bound(F.split(c, "\n"), lambda lines: bound(begins(lines), lambda b: kept(lines, b))), "\n")


def word_changes(a: Column, b: Column) -> Column:
    """What turns one text's words into another's: an array of (op, old, new), equal runs left out."""

    @F.pandas_udf("array<struct<op:string,old:string,new:string>>")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            u, v = (x or "").split(), (y or "").split()
            codes = difflib.SequenceMatcher(a=u, b=v, autojunk=False).get_opcodes()
            out.append([{"op": op, "old": " ".join(u[i:j]), "new": " ".join(v[k:m])} for op, i, j, k, m in codes if op != "equal"])
        return pd.Series(out)

    return run(a, b)


def lines_carrying_heading(df: DataFrame, ids: list[str], text: str, heading: str) -> DataFrame:
    """Numbered lines of a text, each with the last heading at or before it."""
    lines = df.select(*ids, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    head = F.when(F.col("content").rlike(heading), F.col("content"))
    w = Window.partitionBy(*ids).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last_value(head, True).over(w))
