"""What any match of a regular expression must contain, as a cheap test before the expression itself."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

#: Shorter literals are in nearly every text and tell nothing.
LEAST = 3
_SAME = {0x131: "i", 0x307: None}  # what case-insensitive matching takes for an i

Groups = list[frozenset[str]]


def folded(text: str) -> str:
    """A text as literals are looked for in it: without letter case, as case-insensitive expressions see it."""
    return text.lower() if text.isascii() else text.casefold().translate(_SAME)


def _one_group(alternatives: list[Groups]) -> Groups:
    """A single group that holds for all alternatives: of each the one with the longest shortest literal; none if one has none."""
    if not all(alternatives):
        return []
    return [frozenset().union(*(max(groups, key=lambda g: (min(map(len, g)), -len(g))) for groups in alternatives))]


def _sequence(items) -> list[Groups]:
    """Alternatives of groups: of a sequence whose one part needs something, that part's; else what all parts need together."""
    parts: list[list[Groups]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= LEAST:
            parts.append([[frozenset([folded(run)])]])
        run = ""

    for op, value in items:
        if op is C.LITERAL:
            run += chr(value)
            continue
        close()
        if op is C.BRANCH:
            parts.append([g for branch in value[1] for g in _sequence(branch)])
        elif op is C.SUBPATTERN:
            parts.append(_sequence(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            parts.append(_sequence(value[2]))
        elif op is C.ATOMIC_GROUP:
            parts.append(_sequence(value))
    close()
    telling = [p for p in parts if all(p)]
    return telling[0] if len(telling) == 1 else [[g for p in telling for g in _one_group(p)]]


def prerequisites(pattern: str, flags: int = re.IGNORECASE) -> list[list[tuple[str, ...]]]:
    """Alternatives, of which one holds for any match: each a list of groups, of which all have a literal in the folded text."""
    return [[tuple(sorted(g)) for g in groups] for groups in _sequence(parser.parse(pattern, flags))]


def may_match(needed: list[list[tuple[str, ...]]], text: str) -> bool:
    """Whether a folded text has what a match needs; without it there is no match."""
    return any(all(any(literal in text for literal in group) for group in groups) for groups in needed)
