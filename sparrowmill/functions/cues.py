"""Fields and order lines out of transcripts, by mentions that cue words speak for or against.

The engine knows no vocabulary.  A caller states for each field what a mention looks like, how it
becomes a value, and which words near it count for or against it; the mention with the best
balance is taken.  Order lines are folded from events in the order in which they are said.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from .spanish import normal


#: Normal forms of a caller's names, and patterns of whole words, of which there are few.
named = lru_cache(4096)(normal)
whole = lru_cache(4096)(lambda pattern: re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"))


@dataclass(frozen=True)
class Field:
    """A field: its name, the pattern of a mention in normal text, and its cues.

    ``cues`` gives weights to word beginnings; a cue counts in full next to the mention and not
    at all from ``reach`` words on.  ``read`` makes the value of a match, None to pass it over.
    Mentions whose balance is below ``least`` don't count; of equals the earliest does, or the
    latest with ``latest``.
    """

    name: str
    mention: str
    read: Callable[[re.Match], object] = lambda m: m.group()
    cues: dict[str, float] = field(default_factory=dict)
    reach: int = 12
    least: float = 0.0
    latest: bool = False


def balance(words: list[str], begin: int, end: int, cues: dict[str, float], reach: int) -> float:
    """Weights of the cue words around ``words[begin:end]``, falling off evenly with distance."""
    total = 0.0
    for i in range(max(0, begin - reach), min(len(words), end + reach)):
        if begin <= i < end:
            continue
        distance = begin - i if i < begin else i - end + 1
        total += sum(w for cue, w in cues.items() if words[i].startswith(cue)) * (1 - (distance - 1) / reach)
    return total


def extracted(text: str, fields: list[Field]) -> dict[str, object]:
    """Every field's value in a transcript, None where no mention counts."""
    said = normal(text)
    words = said.split()
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    place = {at: i for i, at in enumerate(starts)}
    out: dict[str, object] = {}
    for f in fields:
        best = None
        for m in whole(f.mention).finditer(said):
            value = f.read(m)
            if value is None:
                continue
            begin = place[m.start()]
            score = balance(words, begin, begin + len(m.group().split()), f.cues, f.reach)
            if score >= f.least and (best is None or score > best[0] or (f.latest and score == best[0])):
                best = score, value
        out[f.name] = best[1] if best else None
    return out


def listed(text: str, names: list[str]) -> list[str]:
    """The names that a transcript has as whole words, in the order of their first mention."""
    said = f" {normal(text)} "
    at = {n: said.find(f" {named(n)} ") for n in names}
    return sorted((n for n in names if at[n] >= 0), key=lambda n: (at[n], n))


@dataclass(frozen=True)
class OrderWords:
    """What a caller's orders sound like; patterns of normal text.

    ``withdraw`` stands before an item that is taken back, ``price`` after one, with the price as
    its only group; ``measure`` may stand between an amount and the item; ``sizes`` after it.
    """

    withdraw: str
    price: str
    measure: str = ""
    sizes: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)


def order_lines(text: str, menu: list[str], words: OrderWords) -> list[dict[str, object]]:
    """Items of an order after all corrections: item, size, amount, price.

    Longer names of the menu win where names overlap; plurals count.  An item that is mentioned
    again keeps what the later mention doesn't say anew; a withdrawn one goes.
    """
    said = normal(text)
    names = {named(n): n for n in menu} | {named(a): n for a, n in words.aliases.items()}
    if not names:
        return []
    events = [(m, names[_singular(m.group(), names)]) for m in whole(_mentions(tuple(names))).finditer(said)]
    lines: dict[str, dict[str, object]] = {}
    for k, (m, item) in enumerate(events):
        before = said[events[k - 1][0].end() if k else 0 : m.start()]
        after = said[m.end() : events[k + 1][0].start() if k + 1 < len(events) else len(said)]
        if re.search(rf"(?<!\S)(?:{words.withdraw})(?: (?:el|la|los|las|\d+))*\s*$", before):
            lines.pop(item, None)
            continue
        line = lines.setdefault(item, {"item": item, "size": None, "amount": 1, "price": None})
        measure = rf"(?: (?:{words.measure}) de)?" if words.measure else ""
        if amount := re.search(rf"(?<!\S)(\d+|una?){measure}\s*$", before):
            line["amount"] = int(amount[1]) if amount[1].isdigit() else 1
        if size := next((s for s in words.sizes if re.match(rf"\s*{re.escape(named(s))}s?(?!\S)", after)), None):
            line["size"] = size
        if price := whole(words.price).search(after):
            line["price"] = float(price[1])
    return list(lines.values())


@lru_cache(256)
def _mentions(names: tuple[str, ...]) -> str:
    """The pattern of all names, longer ones first, in the singular or plural."""
    return "|".join(r"\s".join(rf"{re.escape(w)}(?:e?s)?" for w in n.split()) for n in sorted(names, key=lambda n: (-len(n), n)))


def _singular(said: str, names: dict[str, str]) -> str:
    """The name that a mention, maybe in the plural, stands for."""
    stem = lambda n: [re.sub(r"e?s$", "", w) for w in n.split()]
    return said if said in names else next(n for n in sorted(names, key=lambda n: (-len(n), n)) if stem(n) == stem(said))


def matched(left: list[dict], right: list[dict], name: str = "item", amount: str = "amount") -> int:
    """Lines of ``left`` that find a line of ``right`` of their own: equal amounts, and names that
    share four fifths of the shorter one's words and half of the longer one's; first come, first served."""
    taken: set[int] = set()
    for line in left:
        own = set(normal(line[name]).split())
        for k, other in enumerate(right):
            theirs = set(normal(other[name]).split())
            both, sizes = len(own & theirs), sorted((len(own), len(theirs)))
            if k not in taken and sizes[0] and both >= 0.8 * sizes[0] and both >= 0.5 * sizes[1] and line[amount] == other[amount]:
                taken.add(k)
                break
    return len(taken)
