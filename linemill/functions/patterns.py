"""Patterns of the line dialect as Java regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of POSIX in ASCII, as the inside of a bracket expression.
POSIX_CLASSES = {
    "alnum": "A-Za-z0-9",
    "alpha": "A-Za-z",
    "blank": " \\t",
    "cntrl": "\\x00-\\x1F\\x7F",
    "digit": "0-9",
    "graph": "\\x21-\\x7E",
    "lower": "a-z",
    "print": "\\x20-\\x7E",
    "punct": "!-/:-@\\[-`{-~",
    "space": " \\t\\n\\x0B\\f\\r",
    "upper": "A-Z",
    "word": "A-Za-z0-9_",
    "xdigit": "0-9A-Fa-f",
}

#: A dot of the dialect: anything but a line feed.
ANY = "[^\\n]"


def quote(literal: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def quote_replacement(literal: str) -> str:
    """A literal as the replacement of regexp_replace."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def _bracket(p: str, at: int) -> tuple[str, int]:
    """The bracket expression at p[at], translated, and where it ends."""
    end, out = at + 1, "["
    if p[end : end + 1] == "^":
        out, end = "[^", end + 1
    first = end
    while end < len(p) and (p[end] != "]" or end == first):
        if named := re.match(r"\[:([A-Za-z]+):\]", p[end:]):
            if named[1] not in POSIX_CLASSES:
                raise ValueError(f"unknown character class {named[0]}")
            out += POSIX_CLASSES[named[1]]
            end += len(named[0])
        elif p[end] == "\\" and end + 1 < len(p):
            out += {"s": " ", "b": "\\x08"}.get(p[end + 1], p[end : end + 2])
            end += 2
        else:
            out += "\\" + p[end] if p[end] in "[&~]" else p[end]
            end += 1
    if end >= len(p):
        raise ValueError(f"bracket expression without an end in {p!r}")
    return out + "]", end + 1


def pattern(p: str) -> str:
    """A pattern of the dialect for rlike: a dot is anything but a line feed, POSIX classes are ASCII."""
    out, at = "", 0
    while at < len(p):
        if p[at] == "[":
            part, at = _bracket(p, at)
        elif p[at] == "\\" and at + 1 < len(p):
            part, at = {"s": " ", "b": "\\x08"}.get(p[at + 1], p[at : at + 2]), at + 2
        elif p[at] == "$" and at == len(p) - 1:
            part, at = "\\z", at + 1
        elif p[at] == "^" and at == 0:
            part, at = "\\A", at + 1
        else:
            part, at = ANY if p[at] == "." else p[at], at + 1
        out += part
    return out


def full(p: str) -> str:
    """The pattern anchored to the whole value."""
    return f"\\A(?:{pattern(p)})\\z"


def literal_of(p: str) -> str | None:
    """The only string that a pattern without operators matches."""
    if re.search(r"(?<!\\)[.^$|?*+()\[\]{}]", p) or re.search(r"\\[A-Za-z0-9]", p):
        return None
    return re.sub(r"\\(.)", r"\1", p)


def refuse_empty(p: str) -> str:
    """Raises ValueError for a pattern that can match the empty string."""
    if re.fullmatch(re.sub(r"\\z\Z", "$", pattern(p)).replace("\\A", "^"), ""):
        raise ValueError(f"{p!r} can match the empty string")
    return p


def matches(value: Column, p: str) -> Column:
    """Whether the whole value is in the language of the pattern."""
    return value.rlike(full(p))


def found(value: Column, p: str, ignore_case: bool = False) -> Column:
    """Whether the pattern is found in the value; plain literals and anchored literals need no regex."""
    body = p[1:] if p.startswith("^") else p
    body = body[:-1] if body.endswith("$") and not body.endswith("\\$") else body
    text = literal_of(body)
    if text is None or ignore_case:
        return value.rlike(("(?i)" if ignore_case else "") + pattern(p))
    start, end = p.startswith("^"), len(body) < len(p) - p.startswith("^")
    if start and end:
        return value == F.lit(text)
    return value.startswith(text) if start else value.endswith(text) if end else F.contains(value, F.lit(text))
