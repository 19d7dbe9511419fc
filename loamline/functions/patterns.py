"""What a regular expression needs to match: literals, and one automaton for those of many expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _parser

MOST_LITERALS = 64  # of one expression


def required_literals(pattern: str) -> frozenset[str] | None:
    """Literals one of which every match of ``pattern`` contains; None where there are none to be found.

    Blanks end a literal, as a text may have had other characters blanked out.
    Expressions that only another dialect knows give None.
    """
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    return None if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) else _of_sequence(parsed)


def _of_sequence(items) -> frozenset[str] | None:
    found, run = [], ""
    for kind, value in [*items, (None, None)]:
        if kind is _parser.LITERAL and not chr(value).isspace():
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if kind is _parser.SUBPATTERN and not value[1] and not value[2]:
            inner = _of_sequence(value[3])
        elif kind is _parser.BRANCH:
            ways = [_of_sequence(way) for way in value[1]]
            inner = None if None in ways else frozenset().union(*ways)
        elif kind is _parser.IN and all(k is _parser.LITERAL and not chr(v).isspace() for k, v in value):
            inner = frozenset(chr(v) for _, v in value)
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            inner = _of_sequence(value[2])
        if inner is not None and len(inner) <= MOST_LITERALS:
            found.append(inner)
    return max(found, key=lambda literals: (min(map(len, literals)), -len(literals), sorted(literals)), default=None)


def any_of(literals: Iterable[str]) -> str:
    """One expression that finds any of ``literals``: their trie, so that a place is left at the first letter that none has."""
    trie: dict = {}
    for literal in sorted(set(literals)):
        at = trie
        for letter in literal:
            at = at.setdefault(letter, {})
        at[""] = {}
    return _spelled(trie)


def _spelled(trie: dict) -> str:
    if "" in trie:
        return ""  # a literal ends here; longer ones are found with it
    ways = []
    for letter, rest in trie.items():
        ways.append((re.escape(letter) if letter.isascii() else letter) + _spelled(rest))
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def prefilter(patterns: Iterable[str]) -> str | None:
    """An expression found in the lower case of every text that one of ``patterns`` matches; None where some pattern needs no literal."""
    every = [required_literals(p) for p in patterns]
    if None in every or not every:
        return None
    literals = frozenset().union(*every)
    return None if any(x != x.lower() and not x.isascii() for x in literals) else any_of(x.lower() for x in literals)


def ascii_boundaries(pattern: str) -> str:
    r"""``pattern`` with ``\b`` as an edge of a run of ``[A-Za-z0-9_]``, as in RE2; Java's own also counts other letters and marks."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    out, inside = [], 0
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        inside += (part == "[") - (part == "]" and inside > 0)
        out.append(edge if part == r"\b" and not inside else part)
    return "".join(out)
