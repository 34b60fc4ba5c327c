"""Replacement and extraction inside a line, in the manner of sed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linemill.functions.patterns import literal_of, pattern, quote, quote_replacement, refuse_empty


def substitute(line: Column, p: str, replacement: str, everywhere: bool = False) -> Column:
    """s/p/replacement/ for the first match, or all.

    Anchors at the pattern's edges hold it to the line's start or end. The
    replacement is literal. Raises ValueError if the pattern can be empty.
    """
    if p in ("^", "$"):
        return F.concat(F.lit(replacement), line) if p == "^" else F.concat(line, F.lit(replacement))
    refuse_empty(p)
    put = quote_replacement(replacement)
    text = literal_of(p)
    if everywhere and text is not None:
        return F.replace(line, F.lit(text), F.lit(replacement))
    start, end = p.startswith("^"), p.endswith("$") and not p.endswith("\\$")
    body = pattern(p[start : len(p) - end])
    if start and end:
        return F.when(line.rlike(f"\\A(?:{body})\\z"), F.lit(replacement)).otherwise(line)
    if start:
        return F.regexp_replace(line, f"\\A(?:{body})", put)
    if end:
        return F.regexp_replace(line, f"(?:{body})\\z", put)
    if everywhere:
        return F.regexp_replace(line, body, put)
    return F.regexp_replace(line, f"\\A([^\\n]*?)(?:{body if text is None else quote(text)})", "$1" + put)


def substitute_groups(line: Column, p: str, replacement: str, everywhere: bool = False) -> Column:
    r"""s/p/replacement/ where \1 to \9 of the replacement stand for the pattern's groups."""
    refuse_empty(p)
    parts = replacement.split("\\")
    if everywhere:
        put = quote_replacement(parts[0]) + "".join(f"${x[0]}" + quote_replacement(x[1:]) for x in parts[1:])
        return F.regexp_replace(line, pattern(p), put)
    put = quote_replacement(parts[0]) + "".join(f"${int(x[0]) + 1}" + quote_replacement(x[1:]) for x in parts[1:])
    return F.regexp_replace(line, f"\\A([^\\n]*?)(?:{pattern(p)})", "$1" + put)


def all_matches(line: Column, p: str) -> Column:
    """The matches of a pattern from left to right."""
    refuse_empty(p)
    return F.regexp_extract_all(line, F.lit(pattern(p)), F.lit(0))


def extract(line: Column, p: str) -> Column:
    """The first match of a pattern, null if there is none."""
    refuse_empty(p)
    return F.when(line.rlike(pattern(p)), F.regexp_extract(line, pattern(p), 0))
