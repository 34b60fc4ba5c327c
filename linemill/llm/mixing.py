"""Mixing sources to target weights by repetition rates.

Sizes are word counts, summed for each source. Targets share a multiple of all
sizes by the sources' weights; a target stops at a multiple of its source's
size and what it leaves is shared out again. A source's rate is its target over
its size: every row is emitted floor(rate) times, and once more if its draw,
hashed from the whole row and a seed, falls below the rate's fraction.

Independent draws would let a source stray from its target by chance. So there
is one systematic draw over each source: its rows are ordered by size class,
then by hash, and the copies due are rounded cumulatively from the largest
class on, with one offset for the source. In a class they go to neighbours in
the order of hashes, from a hashed start on; places are counted exactly. Each
row's chance of the extra copy is still the fraction, and a source takes what
is due to within about one document of each size.

Equal rows have equal hashes. They are told by an aggregated count, and of n of
them floor(n * fraction) or one more get the extra copy, so that a row that is
repeated a million times is split as evenly as different rows.

Defined results: a null or blank text has size 0 and is emitted floor(rate)
times or once more as any other; a source of no words at all has target 0 and
rate 0. Null sources are one source, after all others. Null keys are values
like any others. Texts of any length are counted whole. Columns named like a
result are replaced; names that start with two underscores are reserved. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import WORD, broadcast_up_to, cut_lineage, with_groups
from linemill.operators.large import with_position

#: Weights of the sources in the order of their code points, repeated as often as needed; null comes last.
WEIGHTS = (3, 1, 2)
#: The mix's size as a multiple of all sizes, and a target's bound as a multiple of its source's size.
TOTAL, MOST = 1.5, 2.0
#: Size classes of a source in each power of two.
CLASSES = 4
#: Equal rows that one row stands for while they are shared out.
CHUNK = 1000


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess is shared out again.

    Sources stop in the order of their bounds for each unit of weight.
    """
    caps = [most * s for s in sizes]
    target, left, weight = list(caps), total, float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    for done, i in enumerate(order):
        if caps[i] * weight >= left * weights[i]:
            for j in order[done:]:
                target[j] = left * weights[j] / weight
            break
        left, weight = left - caps[i], weight - weights[i]
    return target


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of a frame of source totals.

    The totals have one row for each source: the list of sources is metadata of
    the corpus, like the weights, and is gathered to share out the targets.
    """
    rows = sorted(((r[0], int(r[1])) for r in sizes.select(source, size).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    shares = _targets([float(s) for _, s in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], total * sum(s for _, s in rows), most)
    schema = T.StructType([T.StructField("__source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    return sizes.sparkSession.createDataFrame([(n, s, t) for (n, s), t in zip(rows, shares)], schema)


def _uniform(*values: Column) -> Column:
    """A number from 0 to below 1, hashed from values."""
    return F.call_function("shiftrightunsigned", F.xxhash64(*values), F.lit(11)) / float(1 << 53)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _row_draw(docs: DataFrame, seed: int) -> Column:
    """A uniform draw that only equal rows share. Maps, which have no hash, are hashed as JSON; nulls are told from other values."""
    columns = [(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema]
    values = [F.to_json(F.struct(c)) if _has_map(kind) else c for c, kind in columns]
    return _uniform(F.lit(seed), *values, *[c.isNull() for c, _ in columns])


def _size_class(size: Column) -> Column:
    return F.when(size < 1, 0).otherwise(F.floor(F.log2(size.cast("double")) * CLASSES) + 1).cast("int")


def _of(source: Column) -> Column:
    """A key of the source that joins nulls as well."""
    return F.xxhash64(source, source.isNull())


def _plan(groups: DataFrame, rated: DataFrame, seed: int) -> DataFrame:
    """For each source and class: its rate, and the arc of hashes whose rows have one copy more.

    The copies that a source's classes are due are rounded cumulatively, from
    the largest documents on, with one offset for the source, so their sum is
    within one of what the source is due and a row's chance is the fraction. A
    class's copies go to as many neighbours in the order of hashes, from a
    hashed start on, counted exactly.
    """
    cell = F.concat_ws(":", F.col("__of").cast("string"), F.col("__class").cast("string")).alias("__cell")
    single = groups.where("__n = 1").select(cell, "__draw")
    rows = groups.groupBy("__of", "__class").agg(F.count_if(F.col("__n") == 1).alias("__rows")).join(broadcast_up_to(rated, 20_000), "__of")
    reached = F.sum("__rows").over(Window.partitionBy("__of").orderBy(F.desc("__class")))  # few classes of each source
    fraction = F.col("__rate") - F.floor("__rate")
    turn = _uniform(F.lit(seed), F.lit("turn"), "__of")
    due = lambda n: F.floor(n * fraction + turn)
    start = F.floor(_uniform(F.lit(seed), F.lit("start"), "__of", "__class") * F.col("__rows"))
    plan = rows.withColumn("__to", reached).withColumn("__due", due(F.col("__to")) - due(F.col("__to") - F.col("__rows")))
    plan = cut_lineage(plan.select("__of", "__class", cell, "__rows", "__due", start.alias("__start"), "source_size", "target", "__rate"))
    # The first and last hash of each arc, by exact places in the order of hashes.
    arcs = plan.where("__due > 0").select("__cell", "__rows", F.col("__start").alias("first"), F.pmod(F.col("__start") + F.col("__due") - 1, F.col("__rows")).alias("last"))
    placed = with_position(single, "pos", "__cell", ("__draw",)).withColumn("pos", F.col("pos") - 1)
    ends = with_groups(placed, cut_lineage(arcs), "__cell", "__rows", placed.count()).where("pos = first or pos = last")
    found = ends.groupBy("__cell").agg(F.max(F.when(F.col("pos") == F.col("first"), F.col("__draw"))).alias("__low"), F.max(F.when(F.col("pos") == F.col("last"), F.col("__draw"))).alias("__high"))
    return plan.join(found, "__cell", "left").select("__of", "__class", "__rows", "__due", "__low", "__high", "source_size", "target", "__rate")


def _in_arc() -> Column:
    """Whether the row's hash is in the arc of its class; an arc may go over the end of the hashes to their start."""
    above, below = F.col("__draw") >= F.col("__low"), F.col("__draw") <= F.col("__high")
    whole, over = F.col("__due") >= F.col("__rows"), F.col("__low") > F.col("__high")
    return (F.col("__due") > 0) & (whole | F.when(over, above | below).otherwise(above & below))


def _shared_out(repeated_rows: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Rows that are repeated, each as often as it was, with copies shared out among equal ones.

    Equal rows are counted before they are shuffled and come back in chunks of bounded size.
    """
    names = ["__draw", "size", "source_size", "target", "__rate", "__fraction"]
    one = repeated_rows.groupBy(*names).agg(F.count("*").alias("__times"), F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("__row"))
    extra = F.floor(F.col("__times") * F.col("__fraction") + _uniform(F.lit(seed), F.lit("equal"), "__draw"))
    chunks = one.withColumn("__extra", extra).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(CHUNK).cast("long"))))
    spread = chunks.repartition(F.col("__draw"), F.col("__from"))
    each = spread.withColumn("__at", F.explode(F.sequence("__from", F.least(F.col("__from") + CHUNK, F.col("__times")) - 1)))
    copies = F.floor("__rate") + (F.col("__at") < F.col("__extra")).cast("int")
    return each.select("__row.*", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 9) -> DataFrame:
    """docs with size, source_size, target and copies, how often the mix takes each row."""
    docs = docs.drop("size", "source_size", "target", "copies")
    columns = docs.columns
    sized = docs.withColumn("size", word_count(F.col(f"`{text}`"))).withColumn("__draw", _row_draw(docs, seed)).withColumn("__of", _of(F.col(f"`{source}`"))).withColumn("__class", _size_class(F.col("size")))
    groups = cut_lineage(sized.groupBy("__of", F.col(f"`{source}`").alias("__source"), "__class", "__draw").agg(F.count("*").alias("__n"), F.sum("size").alias("__words")))
    sums = groups.groupBy("__source").agg(F.sum("__words").alias("__size"))
    targets = source_targets(sums, "__source", "__size", weights, total, most)
    rated = targets.select(_of(F.col("__source")).alias("__of"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"))
    several = groups.where("__n > 1").select("__draw").distinct().withColumn("__equal", F.lit(True))
    plan = cut_lineage(_plan(groups, rated, seed))
    placed = sized.join(broadcast_up_to(plan, 20_000), ["__of", "__class"]).join(broadcast_up_to(cut_lineage(several), 200_000), "__draw", "left")
    placed = placed.withColumn("__fraction", F.col("__rate") - F.floor("__rate"))
    copies = F.floor("__rate") + F.coalesce(_in_arc(), F.lit(False)).cast("int")
    single = placed.where(F.col("__equal").isNull()).select(*[F.col(f"`{c}`") for c in columns], "size", "source_size", "target", copies.cast("int").alias("copies"))
    if several.isEmpty():
        return single
    return single.unionByName(_shared_out(placed.where("__equal"), columns, seed))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each row of a mix, as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*[F.col(f"`{c}`") for c in columns])
