"""Records from transcripts as columns: fields, orders, evidence, and order totals.

Scans of words run as Arrow batches; arithmetic stays with column functions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions import cues, evidence, sequences, spanish

LINES = "array<struct<item:string,size:string,amount:int,price:double>>"
EVIDENCE = "struct<status:string,mode:string,found_as:string,near:string>"


@F.pandas_udf(T.StringType())
def spoken_numbers(text: pd.Series) -> pd.Series:
    """Spoken Spanish cardinals as digits; null stays null."""
    return text.map(spanish.spoken_numbers, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal(text: pd.Series) -> pd.Series:
    """The normal form that evidence is looked for in; null stays null."""
    return text.map(spanish.normal, na_action="ignore")


def fields(text: Column, wanted: list[cues.Field], kinds: dict[str, str]) -> Column:
    """Struct of the wanted fields, of the types that ``kinds`` names (string if none)."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: json.dumps(cues.extracted(t or "", wanted)))

    return F.from_json(run(text), ", ".join(f"{f.name} {kinds.get(f.name, 'string')}" for f in wanted))


def listed(text: Column, names: list[str]) -> Column:
    """The names that a transcript has, in the order of their first mention."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: cues.listed(t or "", names))

    return run(text)


def order_lines(text: Column, menu: list[str], words: cues.OrderWords) -> Column:
    """Array of an order's lines after all corrections."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: json.dumps(cues.order_lines(t or "", menu, words)))

    return F.from_json(run(text), LINES)


def verified(value: Column, transcript: Column) -> Column:
    """Struct (status, mode, found_as, near) of a text or number against its transcript."""

    @F.pandas_udf(EVIDENCE)
    def run(v: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [evidence.verified(None if pd.isna(a) else a, b or "") for a, b in zip(v, t, strict=True)]
        return pd.DataFrame(rows, columns=["status", "mode", "found_as", "near"])

    return run(value, transcript)


def numbers_said(transcript: Column) -> Column:
    """Every figure of a transcript, spoken ones included, as an array of doubles."""
    return F.transform(F.regexp_extract_all(normal(transcript), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"), F.lit(1)), lambda x: x.cast("double"))


def matched(left: Column, right: Column) -> Column:
    """Lines of an order that find a line of their own in another; null orders have none."""

    @F.pandas_udf(T.IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cues.matched(json.loads(x), json.loads(y)) if x and y else 0 for x, y in zip(a, b, strict=True)], dtype="int32")

    return run(F.to_json(left), F.to_json(right))


def anchors(values: Column) -> Column:
    """Positions of a longest non-decreasing subsequence of an array of integers."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: [] if v is None else sequences.longest_nondecreasing(list(v)))

    return run(values)


def page_rows(lines: Column, reach: float = 0.6) -> Column:
    """Line numbers by row of a page's lines, an array of structs (x, y, h)."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sequences.reading_rows(json.loads(t), reach) if t else [])

    return run(F.to_json(lines))


def paired_discount(items: Column, pattern: str) -> Column:
    """What two for the price of one takes off: every second piece of the items that match."""
    held = F.filter(items, lambda i: F.lower(i["item"]).rlike(pattern) & i["price"].isNotNull())
    return F.aggregate(held, F.lit(0.0), lambda s, i: s + i["price"] * F.floor(i["amount"] / 2))


def bundle_discount(items: Column, pattern: str, price: Column) -> Column:
    """What a bundle's price takes off the items that match; 0 if none does."""
    held = F.filter(items, lambda i: F.lower(i["item"]).rlike(pattern))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, i: s + i["price"] * i["amount"]) - price).otherwise(0.0)


def order_totals(items: Column, stated: Column, tolerance: float = 0.5, discount: Column | None = None) -> Column:
    """Expected total, difference and status (ok, discrepancy, incomplete) of an order.

    Without items, a price or a stated total an order is incomplete.
    """
    unknown = (F.size(items) == 0) | F.exists(items, lambda i: i["price"].isNull()) | stated.isNull()
    full = F.aggregate(items, F.lit(0.0), lambda s, i: s + i["price"] * i["amount"])
    expected = F.when(~unknown, full if discount is None else full - discount)
    status = F.when(F.coalesce(unknown, F.lit(True)), "incomplete").when(F.abs(stated - expected) <= tolerance, "ok").otherwise("discrepancy")
    return F.struct(expected.alias("expected"), F.round(stated - expected, 2).alias("difference"), status.alias("status"))


def diagnosed(totals: Column, items: Column, stated: Column, said: Column) -> Column:
    """Who erred: ``speaker`` if a transcript's figures hold all of the order's, else ``recogniser``.

    ``said`` are the transcript's figures (:func:`numbers_said`), compared in cents; an order that
    adds up is ``ok``, an incomplete one, or one without a transcript, ``undetermined``.
    """
    cents = lambda a: F.transform(a, lambda x: F.round(x, 2))
    figures = F.concat(F.array(stated), F.transform(items, lambda i: i["price"]), F.transform(F.filter(items, lambda i: i["amount"] > 1), lambda i: i["amount"].cast("double")))
    blamed = F.when(F.size(F.array_except(cents(figures), cents(said))) == 0, "speaker").otherwise("recogniser")
    return F.when(totals["status"] == "ok", "ok").when((totals["status"] == "incomplete") | said.isNull(), "undetermined").otherwise(blamed)


def diagnosed_by_truth(totals: Column, stated: Column, correct: Column, spoken: Column, tolerance: float = 0.5) -> Column:
    """Who erred, where the correct total and the one spoken are known."""
    misheard = (F.abs(spoken - stated) > tolerance) | (F.abs(totals["expected"] - correct) > tolerance)
    return F.when(totals["status"] != "discrepancy", F.when(totals["status"] == "ok", "ok").otherwise("undetermined")).when(F.coalesce(misheard, F.lit(True)), "recogniser").otherwise("speaker")


def field_correct(value: Column, truth: Column, tolerance: float | None = None) -> Column:
    """Whether a field is right: numbers within a tolerance, texts in normal form; two nulls are right."""
    same = F.abs(value - truth) <= tolerance if tolerance is not None else normal(value) == normal(truth)
    return F.coalesce(same, value.isNull() & truth.isNull())
