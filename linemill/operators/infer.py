"""Types inferred from the values of a column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.functions.patterns import POSIX_CLASSES, matches, quote
from linemill.operators.filters import pattern_chunks

# Named types.
NAMED_TYPES = {
    "filename": "[^/\\n]+",
    "mask": "[rwx-]{9}",
    "base64": "(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
    "integer": "-?[0-9]+",
    "float": "-?(?:[0-9]+\\.[0-9]*|\\.[0-9]+)",
    "md5": "[A-Fa-f0-9]{32}",
    "sha128": "[A-Fa-f0-9]{32}",
    "sha256": "[A-Fa-f0-9]{64}",
    "number": "-?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)",
    "day-of-the-week": "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Mon|Tue|Wed|Thu|Fri|Sat|Sun)",
    "month": "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    "hh:mm:ss": "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]",
    "year": "[0-9]{4}",
    "username": "[a-z_][a-z0-9_-]*",
    "hh:mm": "(?:[01][0-9]|2[0-3]):[0-5][0-9]",
    "absolute-path": "/.*",
    "ip-address": "(?:[0-9]{1,3}\\.){3}[0-9]{1,3}",
}

# What a readable pattern holds at most.
SHAPES, PATTERN_CHARACTERS = 24, 4096
#: The alphabet of negated classes: Latin-1 without the line feed.
LATIN_1 = "".join(chr(c) for c in range(256) if c != 10)


def concretize(df: DataFrame, column: str, budget: int = 1000) -> DataFrame:
    """One row: the number of distinct values, and their union as a pattern, null beyond the budget of values."""
    values = df.select(F.col(column).alias("v")).where(F.col(column).isNotNull()).distinct()
    few = values.limit(budget + 1)
    escaped = F.regexp_replace("v", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    held = F.array_join(F.sort_array(F.collect_list(escaped)), "|")
    pattern = few.agg(F.when(F.count("*") <= budget, held).alias("pattern"))
    return values.agg(F.count("*").alias("n_values")).crossJoin(pattern)


def shape(value: Column) -> Column:
    """A readable pattern of a value: runs of upper, lower, digits and blanks as classes, all else escaped."""
    escaped = F.regexp_replace(value, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    # Stand-ins that no class matches, so that a class's own letters stay untouched.
    marks = (("[A-Z]+", "\x01"), ("[a-z]+", "\x02"), ("[0-9]+", "\x03"), ("[ \\t]+", "\x04"))
    for p, mark in marks:
        escaped = F.regexp_replace(escaped, p, mark)
    for p, mark in marks:
        escaped = F.replace(escaped, F.lit(mark), F.lit(p))
    return escaped


def infer_shapes(df: DataFrame, column: str) -> DataFrame:
    """Shapes of the values and their counts; distinct values are shaped once."""
    return df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")).groupBy(shape(F.col("v")).alias("shape")).agg(F.sum("c").alias("n"))


def infer_pattern(df: DataFrame, column: str) -> DataFrame:
    """One row: the number of distinct shapes, and one pattern of them all, null beyond the budget.

    Shapes that start or end alike share that part, so the pattern is no longer
    than their plain union. At most SHAPES + 1 shapes reach the driver.
    """
    shapes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.lit(1)).select(shape(F.col("v")).alias("shape")).distinct()
    few = sorted(r["shape"] for r in shapes.limit(SHAPES + 1).collect())
    pattern = folded(few) if len(few) <= SHAPES else None
    if pattern is not None and len(pattern) > PATTERN_CHARACTERS:
        pattern = None
    return shapes.agg(F.count("*").alias("n_shapes"), F.lit(pattern).alias("pattern"))


def _units(text: str) -> tuple[str, ...]:
    """A shape in its indivisible parts: classes with their sign, escaped characters, characters."""
    return tuple(re.findall(r"\[a-z\]\+|\[A-Z\]\+|\[0-9\]\+|\[ \\t\]\+|\\.|[\s\S]", text))


def folded(shapes: list[str]) -> str:
    """The union of shapes with common starts and ends taken out, group by group, as in a prefix tree."""

    def fold(rows: list[tuple[str, ...]]) -> str:
        rows = sorted(set(rows))
        if len(rows) == 1:
            return "".join(rows[0])
        short = min(map(len, rows))
        start = next((i for i in range(short) if len({r[i] for r in rows}) > 1), short)
        end = next((i for i in range(short - start) if len({r[-1 - i] for r in rows}) > 1), short - start)
        middle = [r[start : len(r) - end] for r in rows]
        groups: dict[str, list[tuple[str, ...]]] = {}
        for r in middle:
            if r:
                groups.setdefault(r[0], []).append(r)
        body = "|".join(fold(g) for g in groups.values())
        if () in middle:
            single = len(groups) == 1 and len(next(iter(groups.values()))) == 1 and len(_units(body)) == 1 and not body.endswith("+")
            body = f"{body}?" if single else f"(?:{body})?"
        elif start or end:
            body = f"(?:{body})"
        plain = "|".join("".join(r) for r in rows if r)
        plain = f"(?:{plain})?" if () in rows else plain
        return min("".join(rows[0][:start]) + body + "".join(rows[0][len(rows[0]) - end :]), plain, key=len)

    return fold([_units(s) for s in shapes]) if shapes else ""


_IN_CLASS = r"([\\\[\]^&~-])"


def infer_charclass(df: DataFrame, column: str, alphabet: str = LATIN_1) -> DataFrame:
    """One row: a class of the characters in use, their number, and + or * by the least length.

    Where few characters of the alphabet are not in use, at most 12 or half as
    many as those that are, the class names these (`[^…]`), and with none left
    it is a dot; both only if no value goes beyond the alphabet.
    """
    values = df.select(F.col(column).alias("v")).distinct()
    chars = values.select(F.explode(F.array_distinct(F.split("v", ""))).alias("c"), F.lit(None).cast("int").alias("size"))
    each = chars.where("c <> ''").unionByName(values.select(F.lit(None).cast("string").alias("c"), F.length("v").alias("size")))
    least = each.groupBy("c").agg(F.min("size").alias("size"))
    held = least.agg(F.sort_array(F.collect_list("c")).alias("used"), F.min("size").alias("size"))  # as many as there are characters
    letters = F.array(*[F.lit(c) for c in sorted(set(alphabet))])
    left = F.array_except(letters, "used")
    within = F.size(F.array_except("used", letters)) == 0
    inside = lambda kept: F.array_join(F.transform(kept, lambda c: F.regexp_replace(c, _IN_CLASS, r"\\$1")), "")
    few = within & (F.size("used") > 0) & (F.size(left) <= F.greatest(F.lit(12), F.floor(F.size("used") / 2)))
    named = F.when(few & (F.size(left) == 0), F.lit(".")).when(few, F.concat(F.lit("[^"), inside(left), F.lit("]"))).otherwise(F.concat(F.lit("["), inside(F.col("used")), F.lit("]")))
    return held.select(F.concat(named, F.when(F.col("size") > 0, "+").otherwise("*")).alias("type"), F.size("used").cast("long").alias("n_chars"))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common start of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.substr(a, F.lit(1), F.array_max(same))


def infer_affixes(df: DataFrame, column: str) -> DataFrame:
    """One row: the common start and end of all values, from their least and greatest."""
    v = F.col(column)
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.min(F.reverse(v)).alias("c"), F.max(F.reverse(v)).alias("d"))
    return ends.select(common_prefix(F.col("a"), F.col("b")).alias("prefix"), F.reverse(common_prefix(F.col("c"), F.col("d"))).alias("suffix"))


def infer_literal(df: DataFrame, column: str, most: int = PATTERN_CHARACTERS) -> DataFrame:
    """One row: the literals that all values share, and the type they make.

    prefix and suffix don't overlap in the shortest value. Where both are empty,
    inner is the longest text that every value holds, the first of the shortest
    value's in case of a tie; it is not looked for if that value has more than
    `most` characters. type is the value itself if there is one only (form
    singleton), else lit.*, .*lit, lit.*lit, .*lit.* or .*; no values give nulls.

    Candidates for inner are the shortest value's parts of one length, halved
    between the longest known to be shared and the shortest known not to be;
    each length is one pass, which gathers the candidates that some value lacks.
    """
    spark = df.sparkSession
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    least = F.min(F.struct(F.length("v").alias("size"), F.col("v").alias("v"))).getField("v")
    ends = infer_affixes(values, "v").crossJoin(values.agg(least.alias("short"), F.min("v").alias("a"), F.max("v").alias("b")))  # one row each
    one = ends.first()
    schema = "form string, prefix string, inner string, suffix string, type string"
    if one["short"] is None:
        return spark.createDataFrame([(None,) * 5], schema)
    short, prefix, suffix, inner = one["short"], one["prefix"], one["suffix"], ""
    if one["a"] == one["b"]:
        return spark.createDataFrame([("singleton", short, "", "", quote(short))], schema)
    suffix = suffix[len(suffix) - min(len(suffix), len(short) - len(prefix)) :]
    if not prefix and not suffix and len(short) <= most:
        low, high = 0, len(short) + 1
        while high - low > 1:
            size = (low + high) // 2
            parts = list(dict.fromkeys(short[i : i + size] for i in range(len(short) - size + 1)))
            lacking = values.select(F.explode(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: ~F.contains(F.col("v"), p))).alias("p")).distinct()
            gone = {r["p"] for r in lacking.collect()}  # at most as many as the shortest value has places
            shared = [p for p in parts if p not in gone]
            if shared:
                low, inner = size, shared[0]
            else:
                high = size
    form = {(True, False): "prefix", (False, True): "suffix", (True, True): "both"}.get((bool(prefix), bool(suffix)), "inner" if inner else "any")
    told = f"{quote(prefix)}.*{quote(suffix)}" if not inner else f".*{quote(inner)}.*"
    return spark.createDataFrame([(form, prefix, inner, suffix, told)], schema)


def summarize_type(df: DataFrame, column: str) -> DataFrame:
    """One row: exact counts of distinct values and shapes, and whether they fit a readable pattern."""
    per_shape = df.select(F.col(column).alias("v")).distinct().groupBy(shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"))
    return per_shape.agg(F.sum("n").alias("n_values"), F.count("*").alias("n_shapes"), ((F.count("*") <= SHAPES) & (F.sum(F.length("shape") + 1) <= PATTERN_CHARACTERS)).alias("readable"))


def classify_types(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """For each column and named type, how many of the values match; one pass over the data."""
    types = NAMED_TYPES if types is None else types
    aggs = [F.count_if(matches(F.col(c), p)).alias(f"m{i}_{j}") for i, c in enumerate(columns) for j, p in enumerate(types.values())]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"m{i}_{j}").alias("n_match"), F.col(f"t{i}").alias("n_values")) for i, c in enumerate(columns) for j, t in enumerate(types)]
    return df.agg(*aggs, *[F.count(c).alias(f"t{i}") for i, c in enumerate(columns)]).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def best_types(classified: DataFrame) -> DataFrame:
    """For each column the type of the most matches, ties by name."""
    best = F.min(F.struct((-F.col("n_match")).alias("x"), "type"))
    return classified.groupBy("column").agg(best.getField("type").alias("type"), F.max("n_match").alias("n_match"))


def resolve_types(names: DataFrame, built_in: DataFrame, own: DataFrame) -> DataFrame:
    """The pattern of each name: the built-in one first, then the user's, else the wildcard."""
    a, b = built_in.select("name", F.col("pattern").alias("__a")), own.select("name", F.col("pattern").alias("__b"))
    return names.join(a, "name", "left").join(b, "name", "left").select("name", F.coalesce("__a", "__b", F.lit("[^\\n]*")).alias("pattern"))


def check_name(name: str) -> str:
    """A type's name: letters, digits, underscores and dashes. Raises ValueError otherwise."""
    if not re.fullmatch("[A-Za-z0-9_-]+", name):
        raise ValueError(f"{name!r} is no name of a type")
    return name


def classify_lines(lines: DataFrame, signatures: DataFrame) -> DataFrame:
    """How many lines each known output shape fits first, by its place in the table.

    Distinct lines are matched once. The table is broadcast, in chunks of about 10,000 rows.
    """
    distinct = lines.groupBy("line").agg(F.count("*").alias("c"))
    hits = reduce(DataFrame.unionByName, [distinct.join(F.broadcast(part), F.expr("line rlike pattern")) for part in pattern_chunks(signatures, "pattern")])
    first = hits.groupBy("line").agg(F.min(F.struct("pos", "name")).getField("name").alias("name"), F.first("c").alias("c"))
    return first.groupBy("name").agg(F.sum("c").alias("n"))


def posix_profile(df: DataFrame, column: str) -> DataFrame:
    """How many characters of the values each POSIX class holds."""
    names = [n for n in POSIX_CLASSES if n != "word"]
    sums = df.agg(*[F.sum(F.regexp_count(F.col(column), F.lit(f"[{POSIX_CLASSES[n]}]"))).alias(n) for n in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).cast("long").alias("n")) for n in names])).alias("r")).select("r.*")
