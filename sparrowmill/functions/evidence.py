"""Whether a transcript bears out a value: literally, in normal form, or as a number or duration."""

from __future__ import annotations

import math
import re

from . import alignment
from .spanish import normal

_AMOUNT = re.compile(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])")
_SPAN = re.compile(r"(?:(?P<years>\d+(?:\.\d+)?) )?(?:anos?|(?P<months>\d+) mes(?:es)?)(?: y (?P<half>medio))?(?: (?:y )?(?P<more>\d+) mes(?:es)?)?")


def durations(text: str) -> list[tuple[float, str]]:
    """Years and the words that say them, of every span of years and months in a normal text."""
    out = []
    for m in _SPAN.finditer(text):
        if m["months"]:
            out.append((int(m["months"]) / 12, m.group()))
        elif m["years"] or m["half"] or m["more"]:
            out.append((float(m["years"] or 1) + (0.5 if m["half"] else 0) + int(m["more"] or 0) / 12, m.group()))
    return out


def number_said(value: float, text: str) -> str | None:
    """The words of a normal text that give a number, as a figure or as years and months."""
    same = lambda x: math.isclose(x, value, abs_tol=0.01)
    figures = [(float(m.group()), m.group()) for m in _AMOUNT.finditer(text)]
    return next((said for x, said in figures + durations(text) if same(x)), None)


def nearest(phrase: str, text: str, most: float = 0.3) -> str | None:
    """The words of a text that hold the part least far from a phrase, if few enough edits part them.

    Of one piece more than there may be edits, one at least stays whole; without any there is no such part.
    """
    number = int(most * len(phrase)) + 1
    if number <= len(phrase) and not any(phrase[len(phrase) * i // number : len(phrase) * (i + 1) // number] in text for i in range(number)):
        return None
    distance, begin, end = alignment.best(phrase, text)
    if not phrase or end == begin or distance > most * len(phrase):
        return None
    begin = text.rfind(" ", 0, begin + 1) + 1
    end = text.find(" ", end - 1)
    return text[begin : end if end >= 0 else None]


def coverage(anchor: str, candidate: str) -> float:
    """Share of an anchor's characters that a candidate has in the same order."""
    return alignment.common(anchor, candidate) / len(anchor) if anchor else 0.0


def verified(value: object, transcript: str) -> dict[str, str | None]:
    """``status`` (verified, unverified, empty), ``mode``, ``found_as``, and ``near``, the nearest phrase.

    A list is verified if each of its values is; ``near`` names those that are not.
    """
    out: dict[str, str | None] = {"status": "unverified", "mode": None, "found_as": None, "near": None}
    if value is None or value == "" or value == []:
        return out | {"status": "empty"}
    if isinstance(value, list):
        missing = [str(v) for v in value if verified(v, transcript)["status"] != "verified"]
        return out | {"status": "unverified" if missing else "verified", "mode": "list", "near": ", ".join(missing) or None}
    if isinstance(value, (int, float)):
        said = number_said(float(value), normal(transcript))
        return out | ({"status": "verified", "mode": "number", "found_as": said} if said else {})
    if str(value).casefold() in transcript.casefold():
        return out | {"status": "verified", "mode": "literal", "found_as": str(value)}
    phrase, text = normal(str(value)), normal(transcript)
    if phrase and f" {phrase} " in f" {text} ":
        return out | {"status": "verified", "mode": "normal", "found_as": phrase}
    return out | {"near": nearest(phrase, text)}
