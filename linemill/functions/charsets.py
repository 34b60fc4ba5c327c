"""Character sets in the notation of tr, and the translations that use them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linemill.functions.patterns import POSIX_CLASSES

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\", "0": "\0"}


def _span(first: str, last: str) -> str:
    if ord(last) < ord(first):
        raise ValueError(f"range {first}-{last} runs backwards")
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


def _class_members(name: str) -> str:
    if name not in POSIX_CLASSES:
        raise ValueError(f"unknown character class [:{name}:]")
    inside = re.compile(f"[{POSIX_CLASSES[name]}]")
    return "".join(c for c in map(chr, range(128)) if inside.match(c))


def expand(notation: str) -> str:
    """The characters of a set: ranges, [:classes:], escapes, and dashes at the edges."""
    parts: list[tuple[str, bool]] = []  # characters, and whether they can start a range
    at = 0
    while at < len(notation):
        if named := re.match(r"\[:([a-z]+):\]", notation[at:]):
            parts.append((_class_members(named[1]), False))
            at += len(named[0])
        elif notation[at] == "\\" and at + 1 < len(notation):
            parts.append((_ESCAPES.get(notation[at + 1], notation[at + 1]), True))
            at += 2
        elif notation[at] == "-" and parts and parts[-1][1] and at + 1 < len(notation):
            last = _ESCAPES.get(notation[at + 2], notation[at + 2]) if notation[at + 1] == "\\" and at + 2 < len(notation) else notation[at + 1]
            first = parts.pop()[0]
            parts.append((_span(first, last), False))
            at += 3 if notation[at + 1] == "\\" and at + 2 < len(notation) else 2
        else:
            parts.append((notation[at], True))
            at += 1
    return "".join(p for p, _ in parts)


def bracket(chars: str, negate: bool = False) -> str:
    """A bracket expression of single characters."""
    return "[" + "^" * negate + "".join("\\" + c if c in "\\[]^-&~" else c for c in dict.fromkeys(chars)) + "]"


def translate(value: Column, set1: str, set2: str) -> Column:
    """Characters of set1 become those of set2; a short set2 is filled with its last, a long one cut."""
    one, two = expand(set1), expand(set2)
    if not two:
        raise ValueError("set2 is empty")
    two = (two + two[-1] * len(one))[: len(one)]
    last = dict(zip(one, two))  # of a repeated character the last pair counts
    return F.translate(value, "".join(last), "".join(last.values()))


def translate_complement(value: Column, set1: str, set2: str) -> Column:
    """Every character outside set1 becomes the last one of set2."""
    return F.regexp_replace(value, bracket(expand(set1), True), F.lit(re.sub(r"([\\$])", r"\\\1", expand(set2)[-1])))


def delete(value: Column, chars: str, complement: bool = False) -> Column:
    """Characters of the set (or all others) are dropped."""
    members = expand(chars)
    return F.regexp_replace(value, bracket(members, True), "") if complement else F.translate(value, members, "")


def squeeze(value: Column, chars: str, set2: str | None = None, complement: bool = False) -> Column:
    """Runs of a character of the set become one; with set2 the value is translated first."""
    if set2 is not None:
        value, chars = translate(value, chars, set2), set2
    return F.regexp_replace(value, f"({bracket(expand(chars), complement)})\\1+", "$1")
