"""Near-duplicate documents by MinHash with tensored banding.

Two collections of short MinHash keys are drawn for each set; each pair of a
key of the first and a key of the second is a table key. So collections *
collections tables need only 2 * collections * rows hashes. With s the
similarity of two sets they meet with probability
(1 - (1 - s ** rows) ** collections) ** 2, 0.9996 at 0.8 and 0.99997 at 0.85 for
the defaults. Every link is confirmed on the full sets.

Sets that are equal are one class from the start, found by fingerprint, so
large groups of copies cost one row. Within a bucket nobody is compared with
everybody at once: each class first meets one leader, components are formed,
and only classes of different components in one bucket are compared after that,
in small buckets as pairs, in large ones as blocks against blocks. No bucket is
cut.

Defined results: texts that are null, empty or without words have an empty set
and are linked with nothing. Documents with equal sets are linked whatever
their length. Rows that share a key are one node. A row with a null key takes
no part in linking; its component is null and it is kept. Sets of texts of any
length are whole. An empty table gives an empty result. Columns of other names
do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.llm._common import broadcast_up_to, cut_lineage, with_groups
from linemill.llm._memo import release
from linemill.llm.components import components
from linemill.llm.shingles import mix, shingle_set

#: Short keys in each of the two collections, and hashes in a short key.
COLLECTIONS, ROWS = 12, 3
#: Most classes of a bucket whose unmet members are compared as pairs; beyond it, in blocks of so many classes.
SMALL_BUCKET, BLOCK_CLASSES = 12, 64
#: Bytes of packed sets that a block has on average at most; a set larger than that is whole, so a block holds about this and its largest set.
BLOCK_BYTES = 16 << 20
#: Copies of a set beyond which its class is broadcast to its rows.
HOT_ROWS = 1_000
_BLOCK = 4096


def _multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def short_keys(found: np.ndarray, rows: int, factors: np.ndarray) -> np.ndarray:
    """Keys of `rows` minima each; all sets use the same hash functions."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        np.minimum(least, mix(found[at : at + _BLOCK, None] * factors).min(axis=0), out=least)
    parts = least.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for at in range(rows):
        key = mix(key + parts[:, at])
    return key.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds few texts' sets at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, key: str, text: str, words: int, collections: int, rows: int) -> DataFrame:
    """id, n_shingles, a 128-bit fingerprint of the set and its short keys of both collections."""
    factors = _multipliers(2 * collections * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, prints, keys = [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(raw, words)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(short_keys(found, rows, factors) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "print", "short"])
        release()

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(sign, "id long, n_shingles long, print binary, short array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id and its set as packed hashes; of rows with one id, one row for each set."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(raw, words).tobytes() for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(pack, "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(few) < percent * len(many):
                    keep.append(False)
                    continue
                at = np.searchsorted(many, few)
                both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"), F.octet_length("set").alias("size_b")), "b")
    with_a = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"), F.octet_length("set").alias("size_a")), "a")
    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    return with_a.where(near).select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def _near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of two sizes can be similar at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _shared_short_keys(classes: DataFrame) -> DataFrame:
    """(rep, size, x, place) of the short keys that several classes have.

    A table key is shared only if both its short keys are, so classes are
    searched for by 2 * collections rows each and only what is left is combined.
    Classes are small rows that become many, so they are dealt to all tasks
    first: adaptive execution would leave them in few.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = classes.repartition(parts, "rep").select("rep", "size", F.posexplode("short").alias("place", "x"))
    shared = cut_lineage(keys.groupBy("x").agg(F.count("*").alias("sharers")).where("sharers > 1"))
    total = shared.agg(F.coalesce(F.sum("sharers"), F.lit(0))).first()[0]
    return with_groups(keys, shared, "x", "sharers", total).drop("sharers")


def _buckets(classes: DataFrame, collections: int) -> DataFrame:
    """(table_key, rep, size, leader, leader_size, n) of all table keys that several classes have; the leader is the least of them."""
    held = _shared_short_keys(classes)
    one, other = (F.collect_list(F.when(side, F.col("x"))) for side in (F.col("place") < collections, F.col("place") >= collections))
    held = cut_lineage(held.groupBy("rep", "size").agg(one.alias("one"), other.alias("other")))
    pairs = held.select("rep", "size", "other", F.explode("one").alias("x")).select("rep", "size", "x", F.explode("other").alias("y"))
    keys = pairs.select("rep", "size", F.xxhash64("x", "y").alias("table_key"))
    several = keys.groupBy("table_key").agg(F.min(F.struct("rep", "size")).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = cut_lineage(several.select("table_key", F.col("first.rep").alias("leader"), F.col("first.size").alias("leader_size"), "n"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return with_groups(keys, several, "table_key", "n", total)


def _open_members(members: DataFrame, of: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that still hold several components."""
    placed = cut_lineage(members.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("table_key", "rep", "size", "n", F.coalesce("component", "rep").alias("component")))
    mixed = placed.groupBy("table_key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("table_key")
    return cut_lineage(placed.join(mixed, "table_key"))


def _unmet_pairs(small: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in small buckets, of sets that can be similar by their sizes."""
    mates = small.select("table_key", F.col("rep").alias("mate"), F.col("size").alias("mate_size"), F.col("component").alias("mate_component"))
    met = small.join(mates, "table_key").where("rep < mate and component <> mate_component").where(_near_sizes("size", "mate_size", percent))
    return met.select(F.col("rep").alias("a"), F.col("mate").alias("b")).distinct()


def _unmet_in_families(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in large buckets, compared block by block.

    Classes that large buckets connect are a family. Its main component's
    classes and all others are dealt to blocks of bounded size; every block of
    the others meets every block of the family, as packed sets, in a task.
    """
    hubs = large.groupBy("table_key").agg(F.min("rep").alias("a"))
    families = components(large.join(hubs, "table_key").where("rep > a").select("a", F.col("rep").alias("b")).distinct())
    classes = large.groupBy("rep", "component").agg(F.max("size").alias("size")).join(families.withColumnRenamed("node", "rep").withColumnRenamed("component", "family"), "rep", "left")
    classes = cut_lineage(classes.select("rep", "component", (F.col("size").cast("long") * 8).alias("bytes"), F.coalesce("family", "rep").alias("family")))
    counts = classes.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "component", "bytes")).alias("main"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"))
    told = classes.join(main, "family").withColumn("is_main", F.col("component") == F.col("main.component"))
    n, held = (F.when(F.col("is_main"), F.col(f"main.{of}")).otherwise(F.col(whole) - F.col(f"main.{of}")) for of, whole in (("n", "all"), ("bytes", "all_bytes")))
    blocks = F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(held / BLOCK_BYTES))
    dealt = told.select("rep", "component", F.struct("family", "is_main", F.pmod(F.xxhash64("rep"), blocks).alias("salt")).alias("block"))
    packed = cut_lineage(dealt.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("block").agg(F.collect_list(F.struct("rep", "component", "set")).alias("held")))
    names = packed.select("block", F.col("block.family").alias("family"))
    others = names.where("not block.is_main").withColumnRenamed("block", "other")
    meet = others.join(names, "family").where("block.is_main or other.salt <= block.salt").select("other", "block")
    both = meet.join(packed.select(F.col("block").alias("other"), F.col("held").alias("x")), "other").join(packed.select("block", F.col("held").alias("y")), "block").select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                found = _linked_in_blocks(_unpacked(x), _unpacked(y), percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long").distinct()


def _unpacked(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    held = block.values
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in held.field("set")]
    return held.field("rep").to_numpy(), held.field("component").to_numpy(), sets


def _linked_in_blocks(x: tuple, y: tuple, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of different components between two blocks, by one sorted index of the second."""
    ids, places, sets = y
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    out = []
    for one, place, mine in zip(*x):
        low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        spans = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        linked = (100 * both >= percent * (len(mine) + sizes - both)) & (places != place)
        out += [(min(int(one), int(b)), max(int(one), int(b))) for b in ids[linked]]
    return out


def _of_several_texts(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a key that stands for several texts.

    Keys of many texts and texts of many keys meet their rows by a broadcast.
    """
    known = signed.where("id is not null and print is not null").select("id", "print")
    texts = known.groupBy("id").agg(F.min("print").alias("x"), F.max("print").alias("y"), F.count("*").alias("n"))
    several = cut_lineage(texts.where("x < y").select("id", "n"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return several.select(F.col("id").alias("a"), F.col("id").alias("b"))
    of_several = cut_lineage(with_groups(known, several, "id", "n", total).select("id", "print").distinct())
    reps = cut_lineage(classes.select("print", "rep").join(of_several.groupBy("print").agg(F.count("*").alias("keys")), "print"))
    places = cut_lineage(with_groups(of_several, reps, "print", "keys", total).select("id", "rep"))
    lows = cut_lineage(places.groupBy("id").agg(F.min("rep").alias("low"), F.count("*").alias("n")))
    return with_groups(places, lows, "id", "n", total).where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()


def _placed(signed: DataFrame, places: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with their class's component (null without a set).

    Classes of many copies meet their rows by a broadcast, so a text that a
    third of all rows share isn't one task's work; rows without a set need none.
    """
    empty = signed.where("print is null").withColumn("component", F.lit(None).cast("long"))
    hot = places.where(F.col("copies") > hot_rows).select("print", F.col("component").alias("hot_component"))
    marked = signed.where("print is not null").join(broadcast_up_to(cut_lineage(hot), 200_000), "print", "left")
    columns = ["id", "n_shingles", "component"]
    met = marked.where("hot_component is not null").withColumnRenamed("hot_component", "component").select(columns)
    rest = marked.where("hot_component is null").join(places.where(F.col("copies") <= hot_rows).select("print", "component"), "print", "left")
    return empty.select(columns).union(met).union(rest.select(columns))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id, kept.

    key is a long column. component_id is the smallest key reachable over
    links (itself included); kept says whether that is the row's own key.
    """
    signed = cut_lineage(signatures(docs, key, text, words, collections, rows))
    classes = signed.where("id is not null and print is not null").groupBy("print").agg(F.min("id").alias("rep"), F.first("n_shingles").cast("int").alias("size"), F.first("short").alias("short"), F.count("*").alias("copies"))
    members = cut_lineage(_buckets(classes, collections))
    needed = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    nodes = broadcast_up_to(cut_lineage(members.select(F.col("rep").alias("id")).distinct()), 200_000)
    sets = cut_lineage(full_sets(needed.join(nodes, "id", "left_semi"), words).distinct())

    # Every member first meets one leader: what near copies share is one component after that.
    first = cut_lineage(members.where("rep > leader").where(_near_sizes("size", "leader_size", percent)).groupBy(F.col("rep").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"))
    links = cut_lineage(_of_several_texts(signed, classes).union(confirmed(first, sets, percent)))
    still = _open_members(members, cut_lineage(components(links)))
    pairs = _unmet_pairs(still.where(F.col("n") <= SMALL_BUCKET), percent).join(first, ["a", "b"], "left_anti")
    links = links.union(confirmed(cut_lineage(pairs), sets, percent)).union(_unmet_in_families(still.where(F.col("n") > SMALL_BUCKET), sets, percent))

    of = components(links).withColumnRenamed("node", "rep")
    places = cut_lineage(classes.select("print", "rep", "copies").join(of, "rep", "left").select("print", "copies", F.coalesce("component", "rep").alias("component")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return _placed(signed, places).select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
