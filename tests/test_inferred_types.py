"""Inferred patterns, classes and literals on small frames."""

import re

import pytest
from pyspark.sql import functions as F

from linemill.functions.patterns import matches
from linemill.operators import infer


def test_one_pattern_of_shapes(lines):
    some = lines("ab-1", "ab-12", "AB-1", "ab", "ab-1.x", None, "ab-1.x", "x?")
    n_shapes, pattern = infer.infer_pattern(some, "line").first()
    assert n_shapes == 5
    assert some.where("line is not null").where(~matches(F.col("line"), pattern)).count() == 0
    assert len(pattern) <= len("|".join(r["shape"] for r in infer.infer_shapes(some.where("line is not null"), "line").collect()))
    assert infer.infer_pattern(lines("q.e"), "line").first()["pattern"] == "[a-z]+\\.[a-z]+"
    assert tuple(infer.infer_pattern(lines(), "line").first()) == (0, "")
    assert infer.infer_pattern(lines(*["-" * i for i in range(1, 30)]), "line").first()["pattern"] is None


@pytest.mark.parametrize(
    "shapes, expected",
    [
        (["ab", "ab"], "ab"), (["ab", "ac"], "ab|ac"), (["wwxyza", "wwxyzb"], "wwxyz(?:a|b)"), (["awxyz", "bwxyz"], "(?:a|b)wxyz"), (["a", ""], "a?"), (["[a-z]+", ""], "(?:[a-z]+)?"), (["a1b", "a2b", "ab"], "a(?:1|2)?b"), (["abcdef", "abcxef"], "abc(?:d|x)ef"),
        (["abc", "abd", "xyz"], "abc|abd|xyz"), (["aa", "a"], "aa?"), (["\\.", ""], "\\.?"), (["ab", ""], "(?:ab)?"), (["[0-9]+-[0-9]+", "[0-9]+"], "[0-9]+(?:-[0-9]+)?"),
    ],
)
def test_folding(shapes, expected):
    assert infer.folded(shapes) == expected
    assert all(re.fullmatch(infer.folded(shapes), s.replace("\\.", ".").replace("[a-z]+", "q").replace("[0-9]+", "7")) for s in shapes)


def test_folding_loses_nothing():
    """Random unions: the folded pattern matches just their members, and is no longer than a grouped union."""
    import random

    draw = random.Random(3)
    every = ["".join(c) for n in range(5) for c in __import__("itertools").product("ab", repeat=n)]
    for _ in range(300):
        some = sorted(draw.sample(every, draw.randint(1, 8)))
        pattern = infer.folded(some)
        assert [x for x in every if re.fullmatch(pattern, x)] == sorted(some, key=every.index)
        assert len(pattern) <= len("(?:" + "|".join(some) + ")?")


def test_character_classes(lines):
    letters = "abcdefghijklmnopqrstuvwxyz"
    told = lambda alphabet, *v: tuple(infer.infer_charclass(lines(*v), "line", alphabet).first())
    assert told(letters, letters) == (".+", 26)
    assert told(letters, letters[:13], letters[16:], "") == ("[^nop]*", 23)
    assert told(letters, letters + "A") == ("[" + "A" + letters + "]+", 27)
    assert told(letters, "ab") == ("[ab]+", 2)
    assert told("ab^]-", "ab") == ("[^\\-\\]\\^]+", 2)
    everything = "".join(c for c in infer.LATIN_1)
    assert told(infer.LATIN_1, everything) == (".+", 255) and told(infer.LATIN_1, everything.replace("|", "")) == ("[^|]+", 254)
    assert told(letters) == ("[]*", 0)


@pytest.mark.parametrize(
    "values, expected",
    [
        (["abc", "abd"], ("prefix", "ab", "", "", "ab.*")), (["1.x", "2.x"], ("suffix", "", "", ".x", ".*\\.x")), (["a1z", "a22z"], ("both", "a", "", "z", "a.*z")), (["aa", "aaa"], ("prefix", "aa", "", "", "aa.*")),
        (["1-mid-2", "33-mid-4", "5-mid-66"], ("inner", "", "-mid-", "", ".*-mid-.*")), (["a", "b"], ("any", "", "", "", ".*")), (["a.b", "a.b", None], ("singleton", "a.b", "", "", "a\\.b")), (["", "x"], ("any", "", "", "", ".*")),
        (["1ab2cd3", "xcd4ab5"], ("inner", "", "ab", "", ".*ab.*")), ([None], (None,) * 5), ([], (None,) * 5),
    ],
)
def test_literals(lines, values, expected):
    assert tuple(infer.infer_literal(lines(*values), "line").first()) == expected


def test_named_types(lines):
    held = {"filename": "a.txt", "mask": "rwxr-xr--", "base64": "QUJD", "integer": "-12", "float": "1.5", "md5": "a" * 32, "sha128": "0" * 32, "sha256": "F" * 64, "number": ".5", "day-of-the-week": "Mon", "month": "May", "hh:mm:ss": "23:59:01", "year": "2024", "username": "_a-1", "hh:mm": "09:30", "absolute-path": "/a/b", "ip-address": "10.0.0.1"}
    assert set(held) == set(infer.NAMED_TYPES) and len(held) == 17
    told = infer.classify_types(lines(*held.values(), "/", "24:00"), ["line"]).collect()
    hits = {r["type"]: r["n_match"] for r in told}
    assert all(hits[t] >= 1 for t in held) and hits["hh:mm"] == 1 and hits["year"] == 1 and hits["absolute-path"] == 2
