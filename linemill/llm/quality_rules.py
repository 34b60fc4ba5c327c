"""Quality rules on whole texts, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated runs of words.
The divergence rule compares a text's histogram of character classes and its
histogram of common words with those of its language, by Jensen-Shannon
distance (0 to 1). Both references are learned from all documents: one
aggregate of word counts gives each language's most frequent words and their
shares; one pass over the texts leaves compact counts for each document, from
which the shares of character classes are summed and all distances computed.
Texts too short for a histogram to mean anything are guarded from it.

Words are compared by a 64-bit hash.

Defined results: a null, empty or blank text has no words, so it fails the base
rule. A null language is a language of its own. A language of fewer words than
the guard has no reference, and its documents pass the divergence rule. Equally
frequent words are taken in the order of their hashes. Rows are judged each on
its own, so ties and repeats agree; texts of any length are counted whole.
Columns named like a result are replaced; names that start with two underscores
are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linemill.llm._common import WORD_GAP, broadcast_up_to, cut_lineage

#: Base rules: fewest words, and most percent of words in repeated runs of three.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Words of a language whose shares are compared.
COMMON_WORDS = 50
#: Divergence rules: largest distances (that of words beyond what drawing so few words makes), and the fewest words and characters that are compared.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.29, 0.22
GUARD_CHARS, GUARD_WORDS = 200, 100
#: Words that a language must have, in all its documents, to be a reference.
GUARD_REFERENCE = 2_000
#: Common words of all languages that are looked up as literals; more are joined by language.
LITERAL_WORDS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "[#*$%&|<>]"
#: Lower-case letters and white space are most of a usual text; the other classes are counted on what is left.
_PLAIN = r"[\p{Ll}\x20\x09-\x0D]+"
_UPPER, _DIGIT, _MARK = r"\p{Lu}", r"\p{N}", r"[\p{P}&&[^#*%&]]"
#: Character classes of the histogram; the last one is what no other has.
CLASSES = ("space", "symbol", "upper", "digit", "mark", "lower", "other")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column) -> Column:
    """Places covered by a run of three words that is found twice or more; words are hashes.

    A text without such a run is told by its distinct runs alone. Else the runs
    are sorted as the high bits of their hash before their place, as plain
    numbers; neighbours are compared by their whole hash.
    """

    def places(runs: Column) -> Column:
        bits = F.ceil(F.log2(F.size(runs) + F.lit(1.0))).cast("int")
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def repeated(mask: Column) -> Column:
            at = lambda packed: packed.bitwiseAND(mask).cast("int")
            packed = F.transform(runs, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))

            def again(order: Column) -> Column:
                run = lambda k: F.get(runs, at(F.get(order, k)))
                return F.filter(order, lambda x, k: F.get(runs, at(x)).eqNullSafe(run(k - 1)) | F.get(runs, at(x)).eqNullSafe(run(k + 1)))

            found = _let(F.sort_array(packed), again)
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: _let(at(x), lambda i: F.array(i, i + 1, i + 2))))))

        return _let(low, repeated)

    def count(w: Column) -> Column:
        runs = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(runs, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), places(h)).otherwise(0))

    return _let(words, lambda w: F.when(F.size(w) > 2, count(w)).otherwise(0)).cast("long")


def common_words(docs: DataFrame, text: str = "text", language: str = "lang", most: int = COMMON_WORDS) -> DataFrame:
    """For each language (its hash) its most frequent words (hashes) and their share of all its words."""
    each = docs.select(F.xxhash64(F.col(f"`{language}`")).alias("__of"), F.explode(words_of(F.col(f"`{text}`"))).alias("word")).select("__of", F.xxhash64("word").alias("word"))
    counted = cut_lineage(each.groupBy("__of", "word").agg(F.count("*").alias("n")))
    totals = counted.groupBy("__of").agg(F.sum("n").alias("all")).where(F.col("all") >= GUARD_REFERENCE)
    place = F.row_number().over(Window.partitionBy("__of").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("place", place).where(F.col("place") <= most)
    return top.join(broadcast_up_to(cut_lineage(totals), 100_000), "__of").select("__of", "word", (F.col("n") / F.col("all")).alias("share"))


def _among(common: DataFrame, docs: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """docs, and the test whether a word is a common one of any language or (where these are many) of the row's."""
    listed = [r["word"] for r in common.select("word").distinct().limit(LITERAL_WORDS + 1).collect()]
    if len(listed) <= LITERAL_WORDS:
        return docs, (lambda word: word.isin(listed)) if listed else (lambda word: F.lit(False))
    lists = common.groupBy("__of").agg(F.collect_list("word").alias("__listed"))
    return docs.join(broadcast_up_to(cut_lineage(lists), LITERAL_WORDS), "__of", "left"), lambda word: F.coalesce(F.array_contains("__listed", word), F.lit(False))


def compact_counts(docs: DataFrame, common: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """docs without its text, with the base counts, counts of character classes and of common words (__found, __times)."""
    body = F.col(f"`{text}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *COUNTS)]
    keyed, is_common = _among(common, docs.withColumn("__of", F.xxhash64(F.col(f"`{language}`"))))
    split = keyed.select(*others, "__of", *[c for c in keyed.columns if c == "__listed"], body.alias("__text"), words_of(body).alias("__words"), F.regexp_replace(F.coalesce(body, F.lit("")), _PLAIN, "").alias("__rest"))
    hashed = split.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    some = [F.regexp_count("__rest", F.lit(p)).cast("long") for p in (SYMBOLS, _UPPER, _DIGIT, _MARK)]
    counted = hashed.select(
        *others,
        "__of",
        F.size("__hashes").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        some[0].alias("n_symbols"),
        repeated_lines(F.col("__text")).alias("n_dup_lines"),
        repeated_words(F.col("__hashes")).alias("n_repeat_words"),
        F.coalesce(F.length("__text"), F.lit(0)).cast("long").alias("__chars"),
        F.length("__rest").cast("long").alias("__not_lower"),
        *[c.alias(f"__{name}") for c, name in zip(some[1:], ("upper", "digit", "mark"))],
        F.sort_array(F.filter("__hashes", is_common)).alias("__common"),
    )
    ends = F.transform("__found", lambda w: F.array_position("__common", w).cast("int"))
    times = _let(ends, lambda at: F.transform(at, lambda x, i: F.coalesce(F.get(at, i + 1), F.size("__common") + 1) - x))
    return counted.withColumn("__found", F.array_distinct("__common")).withColumn("__times", times).drop("__common")


def _shares(counts: list[Column]) -> Column:
    total = F.greatest(sum(counts[1:], counts[0]), F.lit(1)).cast("double")
    return F.array(*[c / total for c in counts])


def _class_counts() -> list[Column]:
    upper, digit, mark, symbol, rest = (F.col(c) for c in ("__upper", "__digit", "__mark", "n_symbols", "__not_lower"))
    return [F.col("__chars") - F.col("word_chars"), symbol, upper, digit, mark, F.col("word_chars") - rest, rest - symbol - upper - digit - mark]


def _half(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)


def _distance(divergence: Column) -> Column:
    """The distance of a sum of both halves of a Jensen-Shannon divergence."""
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence / 2)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (to the base 2) of two arrays of shares of one length."""
    return _distance(F.aggregate(F.zip_with(p, q, lambda x, y: _half(x, y) + _half(y, x)), F.lit(0.0), lambda a, b: a + b))


def _word_distance() -> Column:
    """Distance of the found words' shares to the reference's; what is in no list is one class, the other words.

    A listed word that is not found adds its whole reference share.
    """
    listed, total = F.col("__word_share"), F.col("n_words").cast("double")
    pairs = F.transform("__found", lambda w, i: F.struct((F.get("__times", i) / total).alias("p"), F.try_element_at(listed, w).alias("q")))

    def summed(known: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("p"))
        add = lambda s, x: F.struct((s["sum"] + _half(x["p"], x["q"]) + _half(x["q"], x["p"]) - x["q"]).alias("sum"), (s["p"] + x["p"]).alias("p"))
        q = F.aggregate(F.map_values(listed), F.lit(0.0), lambda a, b: a + b)
        return _let(F.aggregate(known, zero, add), lambda s: s["sum"] + q + _half(1 - s["p"], 1 - q) + _half(1 - q, 1 - s["p"]))

    return _distance(_let(F.filter(pairs, lambda x: x["q"].isNotNull()), summed))


def references(counts: DataFrame, common: DataFrame) -> DataFrame:
    """For each language (its hash) its shares of character classes, and of common words as a map."""
    sums = counts.groupBy("__of").agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(_class_counts())])
    classes = sums.select("__of", _shares([F.col(f"c{i}") for i in range(len(CLASSES))]).alias("__class_share"))
    words = common.groupBy("__of").agg(F.map_from_entries(F.collect_list(F.struct("word", "share"))).alias("__word_share"))
    return words.join(classes, "__of")


def quality_rules(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """docs without its text, with the base counts, both distances, base_failed and kept."""
    common = cut_lineage(common_words(docs, text, language))
    counts = cut_lineage(compact_counts(docs, common, text, language))
    known = broadcast_up_to(cut_lineage(references(counts, common)), 10_000)
    joined = counts.join(known, "__of", "left")
    class_distance = F.when((F.col("__chars") >= GUARD_CHARS) & F.col("__class_share").isNotNull(), jensen_shannon(_shares(_class_counts()), F.col("__class_share")))
    word_distance = F.when((F.col("n_words") >= GUARD_WORDS) & F.col("__word_share").isNotNull(), _word_distance())
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    measured = joined.withColumn("class_distance", class_distance).withColumn("word_distance", word_distance)
    # Shares of n words drawn from the reference itself differ from it by about this squared distance.
    chance = F.size("__word_share") / (8 * math.log(2) * F.col("n_words"))
    far_words = F.pow("word_distance", F.lit(2)) > MOST_WORD_DISTANCE**2 + chance
    apart = F.coalesce(F.col("class_distance") > MOST_CLASS_DISTANCE, F.lit(False)) | F.coalesce(far_words, F.lit(False))
    return measured.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (text, *COUNTS, "base_failed", "kept", "class_distance", "word_distance")],
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & ~apart).alias("kept"),
        "class_distance",
        "word_distance",
    )
