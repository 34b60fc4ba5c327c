"""Golden pairs and properties of the Column functions."""

import random

import pytest
from pyspark.sql import functions as F

from linemill.functions import charsets, fields, patterns, replace




def apply(lines, f, *values):
    return [r[0] for r in lines(*values).orderBy("line_no").select(f(F.col("line"))).collect()]


def random_lines(n=120):
    draw = random.Random(5)
    return ["".join(draw.choice("abcxyz AB01.") for _ in range(draw.randrange(12))) for _ in range(n)]


def test_cut_characters(lines):
    assert apply(lines, lambda x: fields.cut_characters(x, [1]), "abc", "") == ["a", ""]
    assert apply(lines, lambda x: fields.cut_characters(x, [1, 3]), "abcde", "ab") == ["ac", "a"]
    assert apply(lines, lambda x: fields.cut_characters(x, [(2, None)]), "abcde", "a") == ["bcde", ""]


def test_cut_fields(lines):
    cut = lambda spans, **k: lambda x: fields.cut_fields(x, spans, " ", **k)
    assert apply(lines, cut([3]), "a b x", "x", "a b") == ["x", "x", ""]
    assert apply(lines, cut([3, 1, 1]), "a b c d") == ["a c"]
    assert apply(lines, cut([(None, 2)]), "a b c") == ["a b"]
    assert apply(lines, cut([2], complement=True), "a b c") == ["a c"]
    with pytest.raises(ValueError):
        fields.cut_fields(F.col("line"), [0])


@pytest.mark.parametrize("notation,chars", [("a-c", "abc"), ("-abc", "-abc"), ("abc-", "abc-"), ("a-c\\n", "abc\n"), ("[:digit:]", "0123456789"), ("[:blank:]", "\t "), ("[:xdigit:]", "0123456789ABCDEFabcdef")])
def test_set_notation(notation, chars):
    assert charsets.expand(notation) == chars


@pytest.mark.parametrize("notation", ["z-a", "9-0", "f-b", "[:none:]"])
def test_bad_set_notation(notation):
    with pytest.raises(ValueError):
        charsets.expand(notation)


def test_translate_pads_with_the_last_character(lines):
    values = random_lines()
    table = {"a": "x", "b": "y", "c": "y"}
    assert apply(lines, lambda x: charsets.translate(x, "abc", "xy"), *values) == ["".join(table.get(c, c) for c in v) for v in values]


def test_delete_and_squeeze(lines):
    values = random_lines()
    assert apply(lines, lambda x: charsets.delete(x, "a-c"), *values) == [v.translate({97: None, 98: None, 99: None}) for v in values]
    assert apply(lines, lambda x: charsets.delete(x, "a-c", complement=True), *values) == ["".join(c for c in v if c in "abc") for v in values]
    assert all(a + a not in v for v in apply(lines, lambda x: charsets.squeeze(x, "ab"), *values, "aabbb") for a in "ab")
    assert apply(lines, lambda x: charsets.squeeze(x, "a", complement=True), "aaxxy") == ["aaxy"]


def test_literal_replacement(lines):
    values = [*random_lines(), "aba", "bab", "xyz"]
    assert apply(lines, lambda x: replace.substitute(x, "a", "X", everywhere=True), *values) == [v.replace("a", "X") for v in values]
    assert apply(lines, lambda x: replace.substitute(x, "a", "X"), *values) == [v.replace("a", "X", 1) for v in values]
    assert apply(lines, lambda x: replace.substitute(x, "b", "$1\\"), "abc") == ["a$1\\c"]


def test_pattern_replacement(lines):
    assert apply(lines, lambda x: replace.substitute(x, "^a+", "-"), "aab", "baa") == ["-b", "baa"]
    assert apply(lines, lambda x: replace.substitute(x, "a+$", "-"), "aab", "baa") == ["aab", "b-"]
    assert apply(lines, lambda x: replace.substitute(x, "^a+$", "-"), "aa", "aab") == ["-", "aab"]
    assert apply(lines, lambda x: replace.substitute_groups(x, "(a)(b)", "\\2\\1"), "abab") == ["baab"]
    with pytest.raises(ValueError):
        replace.substitute(F.col("line"), "a*", "x")


def test_extract(lines):
    assert apply(lines, lambda x: replace.extract(x, "a+"), "baab", "xyz") == ["aa", None]
    assert apply(lines, lambda x: replace.extract(x, "^a+"), "aab", "baa") == ["aa", None]


def test_dialect(lines):
    ok = lambda p, *v: apply(lines, lambda x: patterns.matches(x, p), *v)
    assert ok("a.b", "a\rb", "a\nb") == [True, False]
    assert ok("[[:alpha:]]+", "xZ", "x1", "a]") == [True, False, False]
    assert ok("a", "a", "a\n") == [True, False]
    assert ok("[a&&b]", "&", "a", "c") == [True, True, False]
    with pytest.raises(ValueError):
        patterns.pattern("[[:none:]]")


def test_awk_fields(lines):
    assert apply(lines, lambda x: fields.field(x, 2), "  a \t b ", "a", "") == ["b", "", ""]
    assert apply(lines, fields.last_field, "a b", "", "x") == ["b", "", "x"]
    assert apply(lines, fields.field_count, "a  b", "", "  ") == [2, 0, 0]
    assert apply(lines, fields.number, "12x", "-1.5e1", "x", "") == [12.0, -15.0, 0.0, 0.0]


def test_paths_and_tabs(lines):
    assert apply(lines, fields.basename, "/a/b", "b/", "/", "c") == ["b", "b", "/", "c"]
    assert apply(lines, fields.dirname, "/a/b", "b/", "/", "c", "/x") == ["/a", ".", "/", ".", "/"]
    assert apply(lines, lambda x: fields.expand_tabs(x, 4), "a\tb", "\tb", "abcd\te") == ["a   b", "    b", "abcd    e"]
    assert apply(lines, lambda x: fields.unexpand(x, 4), "      a", "a") == ["\t  a", "a"]
    assert apply(lines, lambda x: fields.from_base64(fields.to_base64(x)), "é" * 200) == ["é" * 200]
