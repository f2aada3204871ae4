"""Spanish cardinals in running text, and a normal form for comparing what was said.

A cardinal is read by a small grammar: millions, then thousands, then hundreds, tens and units.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# fixed values: Spanish number words without marks, and what short forms stand for
UNITS = {"un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
TEENS = {"diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19}
TWENTIES = {"veinte": 20, "veintiun": 21, "veintiuno": 21, "veintiuna": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29}
TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}
HUNDREDS = {"cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900}
ABBREVIATED = {"av": "avenida", "jr": "jiron", "dpto": "departamento", "depto": "departamento", "psje": "pasaje", "int": "interior"}

#: Nouns before which ``un`` and ``una`` count as the number one.
COUNTED = re.compile(r"(?:(?:ano|semana|dia|hora|minuto|segundo)s?|mes(?:es)?)\Z")
_WORDS = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"(?<=\d)[.,](?=\d{3}(?!\d))")


class _Marks(dict):
    """For ``str.translate``: drops marks, and remembers which characters are marks."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c)) == "Mn" else c
        return self[c]


_MARKS = _Marks()
#: Words that a cardinal can begin with.
_BEGINS = frozenset({"cero", "mil", *UNITS, *TEENS, *TWENTIES, *TENS, *HUNDREDS})


def plain(text: str) -> str:
    """Small letters without marks."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFD", text.lower()).translate(_MARKS)


_plain_word = lru_cache(1 << 16)(plain)


def _below_hundred(words: list[str]) -> tuple[int, int]:
    """(value, words used) of the longest cardinal below 100 that ``words`` begin with."""
    head = words[0] if words else ""
    for table in (TEENS, TWENTIES):
        if head in table:
            return table[head], 1
    if head in TENS:
        if len(words) > 2 and words[1] == "y" and words[2] in UNITS:
            return TENS[head] + UNITS[words[2]], 3
        return TENS[head], 1
    return (UNITS[head], 1) if head in UNITS else (0, 0)


def _below_thousand(words: list[str]) -> tuple[int, int]:
    if words and words[0] in HUNDREDS:
        rest, used = _below_hundred(words[1:])
        return HUNDREDS[words[0]] + rest, 1 + used
    return _below_hundred(words)


def _scaled(words: list[str], names: tuple[str, ...], scale: int, below, least: bool) -> tuple[int, int]:
    """``below`` cardinals, then a scale word, then ``below`` cardinals; ``least``: a bare scale word counts."""
    count, used = below(words)
    if used < len(words) and words[used] in names and (used or least):
        rest, more = below(words[used + 1 :])
        return (count if used else 1) * scale + rest, used + 1 + more
    return count, used


def cardinal(words: list[str]) -> tuple[int, int]:
    """(value, words used) of the longest cardinal that plain ``words`` begin with; (0, 0) if none."""
    if words and words[0] == "cero":
        return 0, 1
    thousands = lambda w: _scaled(w, ("mil",), 1000, _below_thousand, True)
    return _scaled(words, ("millon", "millones"), 1_000_000, thousands, False)


def spoken_numbers(text: str) -> str:
    """Spoken cardinals as digits, and digits without separators of thousands.

    ``un``, ``una`` and ``uno`` alone are numbers only before a counted noun (``un año``).  Words
    of a cardinal have nothing but white space between them.
    """
    found = list(_WORDS.finditer(text))
    words = [_plain_word(m.group()) for m in found]
    out, at, i = [], 0, 0
    while i < len(found):
        if words[i] not in _BEGINS:
            i += 1
            continue
        end = i + 1  # words up to here stand next to each other
        while end < len(found) and not text[found[end - 1].end() : found[end].start()].strip() and end - i < 16:
            end += 1
        value, used = cardinal(words[i:end])
        alone = used == 1 and words[i] in ("un", "una", "uno")
        if alone and not (words[i] != "uno" and i + 1 < end and COUNTED.match(words[i + 1])):
            used = 0
        if used:
            out += [text[at : found[i].start()], str(value)]
            at = found[i + used - 1].end()
        i += max(1, used)
    return _SEPARATOR.sub("", "".join(out) + text[at:])


def normal(text: str, numbers: bool = True) -> str:
    """Plain words and numbers with single spaces; decimal points stay, short forms are spelled out."""
    digits = spoken_numbers(text) if numbers else _SEPARATOR.sub("", text)
    found = re.findall(r"\d+(?:\.\d+)?|\w+", plain(digits))
    return " ".join(ABBREVIATED.get(w, w) for w in found)
