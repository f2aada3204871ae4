"""Cleaning pages of scanned or laid-out text: headers, stamps, broken lines, ranges, redaction.

What a header or a stamp looks like is the caller's to say; the operators only find and count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def without_header(lines: Column, parts: list[str], within: int = 8) -> Column:
    """Lines without a running header: the first ``within`` lines that aren't blank, up to the last
    of them that matches a part, go if all parts are matched there; else all lines stay."""
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("t"), i.alias("i")))
    head = F.slice(F.filter(numbered, lambda x: F.trim(x["t"]) != ""), 1, within)
    matches = lambda p: F.exists(head, lambda x: x["t"].rlike(p))
    has = [matches(p) for p in parts]
    last = F.array_max(F.transform(F.filter(head, lambda x: x["t"].rlike("|".join(f"(?:{p})" for p in parts))), lambda x: x["i"]))
    every = has[0]
    for h in has[1:]:
        every &= h
    return F.when(every, F.slice(lines, last + 2, F.size(lines))).otherwise(lines)


def without_stamp(text: Column, begins: str) -> Column:
    """A text without the stamp at its end: from the last line on that ``begins`` matches, if nothing
    but a short tail of lines follows it."""
    return F.regexp_replace(text, rf"(?m)\n*^(?:{begins})[^\n]*(?:\n[^\n]*){{0,6}}\z", "")


def until_end_mark(lines: Column, mark: str) -> Column:
    """Lines up to the first that matches the end mark, that line included; all if none does."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(mark)), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), at.cast("int"))).otherwise(lines)


def below_band(lines: Column, band: float) -> Column:
    """Recognised lines (structs with ``y``) that begin below a header band; unknown places stay."""
    return F.filter(lines, lambda x: F.coalesce(x["y"] >= band, F.lit(True)))


def cropped(lines: Column, height: Column, top: float, bottom: float, most: int) -> Column:
    """The first ``most`` lines whose place lies in a vertical share of the page, both ends included."""
    return F.slice(F.filter(lines, lambda x: (x["y"] >= height * top) & (x["y"] <= height * bottom)), 1, most)


def mended(text: Column) -> Column:
    """Lines that a layout broke: hyphenated words are joined, and a line that begins with a small
    letter continues the one before, unless that ends a sentence."""
    joined = F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
    return F.regexp_replace(joined, r"(?<![.:;!?\n])\n(?=\p{Ll})", " ")


def year_ranges(text: Column) -> Column:
    """Ranges of years with any dash, ``to`` or ``until`` as ``from–to``; open ends as ``present``."""
    closed = F.regexp_replace(text, r"(?i)\b((?:19|20)\d{2})\s*(?:-|–|—|to|until)\s*((?:19|20)\d{2})\b", "$1–$2")
    return F.regexp_replace(closed, r"(?i)\b((?:19|20)\d{2})\s*(?:-|–|—|to|until)\s*(?:now|today|present|current)\b", "$1–present")


def page_text(df: DataFrame, ids: list[str], block: str, order: str, text: str) -> DataFrame:
    """A page's lines as one text, with a blank line where the block changes."""
    w = Window.partitionBy(*ids).orderBy(order)
    before = F.lag(block).over(w)
    gap = F.when(before.isNotNull() & (before != F.col(block)), F.concat(F.lit("\n"), F.col(text))).otherwise(F.col(text))
    rows = df.withColumn("__line", gap)
    held = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__line").alias("t")))).alias("__l"))
    return held.select(*ids, F.array_join(F.transform("__l", lambda x: x["t"]), "\n").alias("text"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _taken(before: pd.Series, after: pd.Series) -> pd.Series:
    """Lines of the first that the second has not, or has fewer times, sorted; null for a null first."""

    def walk(first, second) -> list[str] | None:
        if first is None:
            return None
        kept, at, gone = sorted(x for x in (() if second is None else second) if x is not None), 0, []
        for line in sorted(x for x in first if x is not None):
            if at < len(kept) and kept[at] == line:
                at += 1
            else:
                gone.append(line)
        return gone

    return pd.Series([walk(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def audited(before: Column, after: Column, known: list[str]) -> Column:
    """Lines that cleaning took away and that no known pattern accounts for, in alphabetical order.

    Cleaning only takes lines away, so both sides are walked in the same order: a line that was taken away
    once and kept elsewhere is found, too.
    """
    gone = F.filter(_taken(before, after), lambda x: F.trim(x) != "")
    return F.filter(gone, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in known))) if known else gone


def personal_lines(lines: Column, patterns: list[tuple[str, str]]) -> Column:
    """Numbers of the lines that hold personal data, for redaction."""
    every = "|".join(f"(?:{p})" for _, p in patterns)
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(every), i))
    return F.array_compact(marked)


def cleaned(df: DataFrame, text: str, masks: list[tuple[str, str]], leaks: list[tuple[str, str]]) -> DataFrame:
    """A résumé's cleaning in one plan, with a counter for each step.

    Lines are mended, ranges put in one form, personal data and then leaks masked, spaces tidied.
    """
    from . import text as texts

    c = F.col(text)
    steps = df.withColumn("__mended", mended(c)).withColumn("__ranged", year_ranges(F.col("__mended")))
    hits = lambda source, patterns: sum((F.regexp_count(source, F.lit(p)) for _, p in patterns), F.lit(0))
    steps = steps.withColumn("n_personal", hits("__ranged", masks)).withColumn("__private", texts.masked(F.col("__ranged"), masks))
    steps = steps.withColumn("n_leaks", hits("__private", leaks)).withColumn("cleaned", texts.tidy_spaces(texts.masked(F.col("__private"), leaks, "[MASKED]")))
    return steps.withColumn("n_joined", F.length(c) - F.length(F.regexp_replace(c, "\n", "")) - F.length("__mended") + F.length(F.regexp_replace("__mended", "\n", ""))).drop("__mended", "__ranged", "__private")


def without_contacts(text: Column, sections: str, patterns: list[tuple[str, str]]) -> Column:
    """A résumé's text without who it is about.

    The header block, up to the first line that opens a section, loses lines of two to four words that
    all begin with a capital, which are taken for names, and lines with personal data; personal data
    further down is masked.  A text without a section keeps its lines.
    """
    from . import text as texts

    lines = lines_of(text)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(sections)), True)
    every = "|".join(f"(?:{p})" for _, p in patterns)
    kept = F.filter(lines, lambda x, i: ~((i < first - 1) & (x.rlike(r"^\s*(?:\p{Lu}[\p{L}'.-]*\s*){2,4}$") | x.rlike(every))))
    return texts.masked(F.array_join(F.when(first > 0, kept).otherwise(lines), "\n"), patterns)


def token_chunks(df: DataFrame, ids: list[str], text: str, budget: int) -> DataFrame:
    """Lines packed into chunks of at most ``budget`` words; a longer line is a chunk of its own.

    A line begins a new chunk where it would go past the budget, an order-dependent sum that a fold
    over the text's own lines gives.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    sizes = F.transform(lines, lambda x: F.struct(x.alias("t"), F.size(F.filter(F.split(x, " "), lambda w: w != "")).alias("n")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, line: Column) -> Column:
        fits = (state["n"] == 0) | (state["n"] + line["n"] <= budget)
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        opened = F.when(fits & (state["n"] > 0), F.concat(state["open"], F.lit("\n"), line["t"])).otherwise(line["t"])
        return F.struct(done.alias("done"), opened.alias("open"), F.when(fits, state["n"] + line["n"]).otherwise(line["n"]).alias("n"))

    packed = F.aggregate(sizes, start, add, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return df.select(*ids, F.posexplode(packed).alias("position", "chunk"))
