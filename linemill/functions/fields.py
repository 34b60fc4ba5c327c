"""Fields and characters of a line: cut, awk's fields, formatting, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linemill.functions.patterns import quote

#: A position, or a range with open ends.
Span = int | tuple[int | None, int | None]


def _ranges(spans: list[Span]) -> list[tuple[int, int | None]]:
    """Sorted ranges without overlap; None is an open end."""
    plain = sorted(((s, s) if isinstance(s, int) else (s[0] or 1, s[1]) for s in spans), key=lambda r: r[0])
    out: list[tuple[int, int | None]] = []
    for first, last in plain:
        if first < 1 or (last is not None and last < first):
            raise ValueError(f"range {first}-{last}")
        if out and (out[-1][1] is None or first <= out[-1][1] + 1):
            before = out[-1][1]
            out[-1] = (out[-1][0], None if before is None or last is None else max(before, last))
        else:
            out.append((first, last))
    return out


def cut_fields(line: Column, spans: list[Span], delimiter: str = "\t", complement: bool = False) -> Column:
    """The listed fields in their order in the line; a line without the delimiter passes whole."""
    parts = F.split(line, quote(delimiter), -1)
    inside = lambda i: _any_of([(i + 1 >= a) & ((i + 1 <= b) if b is not None else F.lit(True)) for a, b in _ranges(spans)])
    if complement:
        kept = F.filter(parts, lambda x, i: ~inside(i))
    else:
        pieces = [F.slice(parts, a, F.greatest(F.size(parts), F.lit(1)) if b is None else F.lit(b - a + 1)) for a, b in _ranges(spans)]
        kept = F.concat(*pieces) if len(pieces) > 1 else pieces[0]
    return F.when(F.contains(line, F.lit(delimiter)), F.array_join(kept, delimiter)).otherwise(line)


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def cut_characters(line: Column, spans: list[Span]) -> Column:
    """The characters at the listed places."""
    return F.concat(*[F.substring(line, a, 2**31 - 1 if b is None else b - a + 1) for a, b in _ranges(spans)])


def cut_bytes(line: Column, spans: list[Span]) -> Column:
    """cut -b: the UTF-8 bytes at the listed places, as a text; bytes of a character that is cut apart are left out.

    Bytes are handled as hexadecimal digits. What is left over of a character,
    lone leading or following bytes, is no text and is removed.
    """
    digits = F.hex(F.encode(line, "utf-8"))
    kept = F.concat(*[F.substring(digits, 2 * a - 1, 2**31 - 1 if b is None else 2 * (b - a + 1)) for a, b in _ranges(spans)])
    spaced = F.regexp_replace(kept, "(..)", "$1 ")
    whole = r"((?:[0-7]. )|(?:[CD]. [89AB]. )|(?:E. (?:[89AB]. ){2})|(?:F. (?:[89AB]. ){3}))|(?:.. )"
    return F.decode(F.unhex(F.replace(F.regexp_replace(spaced, whole, "$1"), F.lit(" "), F.lit(""))), "utf-8")


def blank_fields(line: Column) -> Column:
    """Fields parted by runs of blanks; none in a blank line."""
    trimmed = F.regexp_replace(line, r"\A[ \t]+|[ \t]+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t]+", -1))


def char_fields(line: Column, separator: str) -> Column:
    """Fields parted by one character; none in an empty line."""
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, quote(separator), -1))


def field(line: Column, k: int, separator: str | None = None) -> Column:
    """awk's $k: the whole line for 0, an empty string past the end."""
    if k == 0:
        return line
    parts = blank_fields(line) if separator is None else char_fields(line, separator)
    return F.coalesce(F.get(parts, F.lit(k - 1)), F.lit(""))


def last_field(line: Column, separator: str | None = None) -> Column:
    """awk's $NF; the whole line if it has no field."""
    parts = blank_fields(line) if separator is None else char_fields(line, separator)
    return F.when(F.size(parts) == 0, line).otherwise(F.try_element_at(parts, F.lit(-1)))


def field_count(line: Column, separator: str | None = None) -> Column:
    """awk's NF."""
    return F.size(blank_fields(line) if separator is None else char_fields(line, separator)).cast("long")


def print_fields(line: Column, ks: list[int], separator: str | None = None) -> Column:
    """awk's print $a, $b: fields joined by a space."""
    return F.concat_ws(" ", *[field(line, k, separator) for k in ks])


def number(value: Column) -> Column:
    """awk's numeric value of a string: its leading number, else 0."""
    return F.coalesce(F.regexp_extract(value, r"\A[ \t]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def repeat_line(line: Column, n: int, separator: str = "") -> Column:
    """n copies of the line in one."""
    return F.array_join(F.array_repeat(line, n), separator) if separator else F.repeat(line, F.lit(n))


def expand_tabs(line: Column, stop: int = 8) -> Column:
    """Tabs become spaces up to the next stop."""

    def put(out: Column, part: Column) -> Column:
        width = F.floor(F.length(out) / stop) * stop + stop
        return F.concat(F.rpad(out, width.cast("int"), F.lit(" ")), part)

    parts = F.split(line, "\t", -1)
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), put)


def unexpand(line: Column, stop: int = 8) -> Column:
    """Leading blanks become tabs, one for each full stop."""
    blanks = F.length(F.regexp_extract(line, r"\A( *)", 1))
    tabs = F.floor(blanks / stop).cast("int")
    return F.concat(F.repeat(F.lit("\t"), tabs), F.substr(line, tabs * stop + 1, F.length(line)))


def basename(path: Column) -> Column:
    """The last part of a path."""
    bare = F.regexp_replace(path, "(?<=.)/+\\z", "")
    return F.when(bare.rlike("\\A/+\\z"), F.lit("/")).otherwise(F.regexp_extract(bare, "([^/]*)\\z", 1))


def dirname(path: Column) -> Column:
    """The path without its last part; a dot if there is no other."""
    bare = F.regexp_replace(path, "(?<=.)/+\\z", "")
    parent = F.regexp_replace(F.regexp_extract(bare, "\\A(.*)/[^/]*\\z", 1), "(?<=.)/+\\z", "")
    return F.when(~F.contains(bare, F.lit("/")), F.lit(".")).when(parent == "", F.lit("/")).otherwise(parent)


def to_base64(value: Column) -> Column:
    """Base64 of a text's bytes in one line, whatever line length the session sets."""
    return F.regexp_replace(F.base64(F.encode(value, "utf-8")), "[\r\n]+", "")


def from_base64(value: Column) -> Column:
    return F.decode(F.unbase64(value), "utf-8")
