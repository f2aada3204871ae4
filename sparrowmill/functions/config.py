"""Checks of nested settings that name every fault at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Setting:
    """A dotted path, the types its value may have, and a further rule with what it says if broken."""

    path: str
    kinds: tuple[type, ...]
    rule: Callable[[object], bool] = lambda _: True
    says: str = "is out of range"
    needed: bool = True


def faults(config: dict, settings: list[Setting], between: list[tuple[Callable[[dict], bool], str]] = ()) -> list[str]:
    """What is wrong with a configuration: absent and ill-typed values, broken rules, unknown names.

    ``between`` has rules over several settings, which count only if nothing else is wrong.
    """
    out, known = [], set()
    for s in settings:
        at, names = config, s.path.split(".")
        known.update(".".join(names[: i + 1]) for i in range(len(names)))
        for name in names:
            at = at.get(name) if isinstance(at, dict) else None
        if at is None:
            if s.needed:
                out.append(f"{s.path} is missing")
        elif not isinstance(at, s.kinds) or (isinstance(at, bool) and bool not in s.kinds):
            out.append(f"{s.path} is no {' or '.join(k.__name__ for k in s.kinds)}")
        elif not s.rule(at):
            out.append(f"{s.path} {s.says}")

    def names_of(held: dict, before: str = ""):
        for k, v in held.items():
            yield before + k
            if isinstance(v, dict):
                yield from names_of(v, f"{before}{k}.")

    out += [f"{n} is unknown" for n in names_of(config) if n not in known]
    return out or [says for rule, says in between if not rule(config)]
