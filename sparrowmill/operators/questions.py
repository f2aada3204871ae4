"""Filters out of questions in natural language, place names, and their merge with stated filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text as texts

# fixed values: what amounts are counted in
MULTIPLIERS = {"mil": 1_000.0, "millon": 1_000_000.0, "millones": 1_000_000.0}
_NUMBER = r"(\d+(?:[.,]\d{3})*(?:\.\d+)?)"


def plain_question(question: Column) -> Column:
    """Small letters without marks, single spaces, ``un millón`` and ``una mil`` with the figure 1."""
    plain = F.trim(F.regexp_replace(texts.folded(question), r"\s+", " "))
    return F.regexp_replace(plain, r"\bun[ao]? (?=mil\b|millon\b)", "1 ")


def named(question: Column, names: dict[str, str]) -> Column:
    """What the longest name that the question has as whole words stands for; null if none."""
    out = F.lit(None).cast("string")
    for name in sorted(names, key=lambda n: (len(n), n)):
        out = F.when(question.rlike(rf"\b{name}\b"), F.lit(names[name])).otherwise(out)
    return out


def keyed(question: Column, keywords: list[tuple[str, list[str]]]) -> Column:
    """The first category, in the given order, of which the question has a keyword's beginning."""
    out = F.lit(None).cast("string")
    for name, words in reversed(keywords):
        out = F.when(question.rlike(rf"\b(?:{'|'.join(words)})"), F.lit(name)).otherwise(out)
    return out


def amount_after(question: Column, before: str) -> Column:
    """The amount after some words, with its multiplier; a bare year is no amount."""
    pattern = rf"\b(?:{before})\s+(?:s/\s*)?{_NUMBER}(?:\s+({'|'.join(sorted(MULTIPLIERS, key=len, reverse=True))})\b)?"
    figure = F.regexp_extract(question, pattern, 1)
    unit = F.regexp_extract(question, pattern, 2)
    times = F.lit(1.0)
    for name, value in MULTIPLIERS.items():
        times = F.when(unit == name, value).otherwise(times)
    number = F.expr("try_cast(NULL as double)") if figure is None else F.regexp_replace(figure, r"[.,](?=\d{3}(?!\d))", "").try_cast("double")
    year = (unit == "") & figure.rlike(r"^(?:19|20)\d{2}$")
    return F.when((figure != "") & ~year, number * times)


def extracted_filters(df: DataFrame, question: str, places: dict[str, str], categories: list[tuple[str, list[str]]]) -> DataFrame:
    """``place``, ``category``, ``at_least`` and ``at_most`` that a question asks for."""
    q = plain_question(F.col(question))
    return df.withColumns({
        "place": named(q, places), "category": keyed(q, categories),
        "at_least": amount_after(q, "mas de|mayor(?:es)? a|desde|superior(?:es)? a|minimo"),
        "at_most": amount_after(q, "menos de|menor(?:es)? a|hasta|inferior(?:es)? a|maximo"),
    })


def merged(stated: dict[str, Column], extracted: dict[str, Column]) -> dict[str, Column]:
    """Stated filters win over extracted ones."""
    return {k: F.coalesce(stated[k], extracted[k]) if k in stated else extracted[k] for k in extracted}


def without_prefix(name: Column, prefixes: list[str]) -> Column:
    """A name without the longest of the prefixes that it begins with."""
    return F.regexp_replace(name, rf"^(?:{'|'.join(sorted(prefixes, key=len, reverse=True))}) +", "")


def place_in_name(name: Column, pattern: str) -> Column:
    """The place that an organisation's name tells, the pattern's only group; null if none."""
    return F.nullif(F.trim(F.regexp_extract(name, pattern, 1)), F.lit(""))


def located(df: DataFrame, steps: list[tuple[str, Column]], places: DataFrame, key: str, value: str) -> DataFrame:
    """``place`` of the first step whose name is a known place, and ``place_by``, that step's name.

    Names that no step knows are ``unknown`` rows with a null place; ``places`` has a row per name.
    """
    for i, (_, c) in enumerate(steps):
        df = df.withColumn(f"__n{i}", c)
        df = df.join(places.select(F.col(key).alias(f"__n{i}"), F.col(value).alias(f"__p{i}")), f"__n{i}", "left")
    place = F.coalesce(*[F.col(f"__p{i}") for i in range(len(steps))])
    by = F.coalesce(*[F.when(F.col(f"__p{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(steps)], F.lit("unknown"))
    return df.withColumns({"place": place, "place_by": by}).drop(*[f"__{x}{i}" for i in range(len(steps)) for x in "np"])
