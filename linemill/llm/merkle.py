"""A Merkle manifest of a dataset: a tree of 16 for each source, one over the sources, and a witness for each row.

Leaves are appended in the order of their keys. An appender holds the open run
of each level; a leaf's witness starts empty, and whenever a run of siblings is
complete, each leaf below it gets its siblings' digests, left and right of its
own node. So witnesses of open subtrees are partial, and each later sibling
that completes a run extends them. The work is distributed by aligned blocks of
16**BLOCK_LEVELS leaves, which are complete subtrees: each is appended in one
task, and block roots are further appends, block by block again, until one node
of a source is left. The sources' subroots are appended likewise. Then
witnesses go back down: what a block's root gathered above is sent to the block
as one row before its leaves.

A kept manifest grows by append(): only the open block of a source and new ones
are digested again; texts of rows that are in it are not read.

Defined results: null fields count as `-`; a null source is a source, the first
one; rows of a null key come first in their source, rows of equal keys in the
order of their digests; rows that are repeated are leaves of their own. An
empty table has no rows and no root. Extra columns pass through; those named
like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import cut_lineage, fresh_dir, with_groups
from linemill.operators.large import with_position
from linemill.operators.order import number_lines

FAN = 16
#: Levels of a block that one task appends.
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS

Level = tuple[bytes, bytes]
_WITNESS = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """Hexadecimal SHA-256 of the fields, each as its UTF-8 byte count, a colon and its text, or `-` if null."""
    told = []
    for field in fields:
        text = field.cast("string")
        told.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*told), 256)


def digest(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class Appender:
    """One tree that grows leaf by leaf; keeps each leaf's witness if asked."""

    def __init__(self, witnesses: bool = True):
        self._open: list[list[tuple[bytes, int, int]]] = [[]]  # for each level: node, first leaf, end of its leaves
        self._n = 0
        self.witness: list[list[Level]] | None = [] if witnesses else None

    def append(self, leaf: bytes) -> None:
        if self.witness is not None:
            self.witness.append([])
        self._add(0, (leaf, self._n, self._n + 1))
        self._n += 1

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self._open):
            self._open.append([])
        self._open[level].append(node)
        if len(self._open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Close a run: its leaves' witnesses get their siblings, and its digest is appended above."""
        run, self._open[level] = self._open[level], []
        digests = [node[0] for node in run]
        if self.witness is not None:
            for i, (_, first, end) in enumerate(run):
                sides = b"".join(digests[:i]), b"".join(digests[i + 1 :])
                for leaf in range(first, end):
                    self.witness[leaf].append(sides)
        self._add(level + 1, (digest(digests), run[0][1], run[-1][2]))

    def close(self, levels: int | None = None) -> bytes:
        """The root once no more leaves come: after so many levels, or where one node is left."""
        level = 0
        while True:
            run, above = self._open[level], any(self._open[level + 1 :])
            if level == levels or (levels is None and len(run) == 1 and not above):
                return run[0][0]
            if run:
                self._complete(level)
            level += 1


def block_root(leaves: list[bytes], number: int, witnesses: bool = False) -> tuple[bytes, list[list[Level]] | None]:
    """Root of a block, and its leaves' witnesses in it. Only a source's first block can be its only one, and then ends where one node is left."""
    tree = Appender(witnesses)
    for leaf in leaves:
        tree.append(leaf)
    return tree.close(None if number == 0 and len(leaves) < BLOCK else BLOCK_LEVELS), tree.witness


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[tuple]]]:
    """(source, block, other columns of its rows) of sorted rows; a block is held at a time."""
    now, rows = None, []
    for batch in batches:
        for source, block, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (source, block) != now:
                if rows:
                    yield *now, rows
                now, rows = (source, block), []
            rows.append(rest)
    if rows:
        yield *now, rows


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("source", "block").sortWithinPartitions("source", "block", "pos")


def _roots(rows: DataFrame) -> DataFrame:
    """(source, pos, digest): each block's root as a node of the round above."""

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for source, block, own in _by_block(batches):
            held.append((source, block, block_root([d.encode() for _, d in own], block)[0].decode()))
            if len(held) == 4096:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.string()))], names=["source", "pos", "digest"])

    return _together(rows.select("source", _block().alias("block"), "pos", "digest")).mapInArrow(append, "source string, pos long, digest string")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long")


def _headed(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (source, pos, digest, claim, id) by block, each block led by its header (source, block, witness, subroot)."""
    none = F.lit(None)
    led = headers.select("source", "block", F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("digest"), none.cast("string").alias("claim"), none.cast("long").alias("id"), "witness", "subroot")
    own = rows.select("source", _block().alias("block"), "pos", "digest", "claim", "id", none.cast(_WITNESS).alias("witness"), none.cast("string").alias("subroot"))
    return _together(led.unionByName(own))


def _levels(witness: list[dict]) -> list[Level]:
    return [(w["left"].encode(), w["right"].encode()) for w in witness]


def _witnessed(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(source, pos, witness, subroot): the nodes of a round with all that they need up to the root."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, block, (header, *own) in _by_block(batches):
            _, found = block_root([r[1].encode() for r in own], block, witnesses=True)
            told = [[{"left": a.decode(), "right": b.decode()} for a, b in levels] + header[4] for levels in found]
            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            columns = [pa.array([source] * len(own), pa.string()), pa.array([r[0] for r in own], pa.int64()), pa.array(told, kind), pa.array([header[5]] * len(own), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "pos", "witness", "subroot"])

    return _headed(rows.withColumns({"claim": F.lit(None).cast("string"), "id": F.lit(None).cast("long")}), headers).mapInArrow(extend, f"source string, pos long, witness {_WITNESS}, subroot string")


def _proved(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(id, subroot, proof_sha256, folded_root): each leaf's whole witness hashed, and its claim folded up to the root."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, (header, *own) in _by_block(batches):
            above = _levels(header[4])
            above_text = b"".join(a + b for a, b in above)
            _, found = block_root([r[1].encode() for r in own], block, witnesses=True)
            proofs, folded, known = [], [], {}
            for row, levels in zip(own, found):
                proofs.append(sha256(b"".join([a + b for a, b in levels] + [above_text])).hexdigest())
                now = row[2].encode()
                for a, b in levels:
                    now = digest([a, now, b])
                if now not in known:  # above the block the way is the same for all of its leaves
                    top = now
                    for a, b in above:
                        top = digest([a, top, b])
                    known[now] = top.decode()
                folded.append(known[now])
            yield pa.RecordBatch.from_arrays([pa.array([r[3] for r in own], pa.int64()), pa.array([header[5]] * len(own), pa.string()), pa.array(proofs), pa.array(folded)], names=["id", "subroot", "proof_sha256", "folded_root"])

    return _headed(rows, headers).mapInArrow(prove, "id long, subroot string, proof_sha256 string, folded_root string")


def _rounds(spark: SparkSession, nodes: DataFrame, folder: str) -> list[DataFrame]:
    """The nodes, their block roots, the roots of these, and so on to one node of each source; each round is written."""
    found = [nodes]
    while found[-1].agg(F.max("pos")).first()[0] > 0:
        path = f"{folder}/{len(found)}"
        _roots(found[-1]).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


class Manifest:
    """A manifest kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self._spark = spark
        self._folder = folder or fresh_dir(spark, "manifest")
        self._versions = 0
        self._leaves: DataFrame | None = None  # source, pos, digest, claim, id, and the rows' own columns in __row
        self._first: DataFrame | None = None  # the block roots of the leaves

    def append(self, rows: DataFrame, source: str = "source", key: str = "doc_id", leaf: str = "leaf", claim: str | None = None) -> None:
        """Add rows, whose leaves follow in each source on those that are there.

        leaf is the row's digest; claim, if given, the digest that is to be
        verified in its place. Raises ValueError if a key is not above all that
        its source has already.
        """
        path = f"{self._folder}/v{self._versions}"
        self._versions += 1
        own = rows.select(F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("key"), F.col(f"`{leaf}`").alias("digest"), F.coalesce(F.col(f"`{claim or leaf}`"), F.col(f"`{leaf}`")).alias("claim"), F.struct(*[f"`{c}`" for c in rows.columns]).alias("__row"))
        own.write.parquet(f"{path}/rows")  # texts are digested once
        placed = with_position(self._spark.read.schema(own.schema).parquet(f"{path}/rows"), "pos", "source", ("key", "digest")).withColumn("pos", F.col("pos") - 1)
        name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
        if self._leaves is not None:
            counted = self._leaves.groupBy(name.alias("__name")).agg(F.count("*").alias("__size"), F.max("key").alias("__last"))
            counted = cut_lineage(counted)
            joined = with_groups(placed.withColumn("__name", name), counted, "__name", "__size", self._leaves.count())
            if not joined.where(~(F.coalesce(F.col("key") > F.col("__last"), F.col("__last").isNull()))).isEmpty():
                raise ValueError("a key is not above those of its source in the manifest")
            new = placed.withColumn("__name", name).join(counted.select("__name"), "__name", "left_anti").drop("__name")
            placed = joined.withColumn("pos", F.col("pos") + F.col("__size")).drop("__name", "__size", "__last").unionByName(new)
        placed.withColumn("id", F.monotonically_increasing_id() + F.lit(self._versions << 56)).write.parquet(f"{path}/leaves")
        added = self._spark.read.parquet(f"{path}/leaves")
        if self._leaves is None:
            self._leaves = added
            _roots(added).write.parquet(f"{path}/first")
        else:
            touched = added.select(name.alias("__name"), _block().alias("__block")).distinct()
            at = lambda df, block: df.withColumns({"__name": name, "__block": block})
            known = at(self._leaves, _block()).join(touched, ["__name", "__block"], "left_semi").select("source", "pos", "digest")
            again = _roots(known.unionByName(added.select("source", "pos", "digest")))
            kept = at(self._first, F.col("pos")).join(touched, ["__name", "__block"], "left_anti").select("source", "pos", "digest")
            kept.unionByName(again).write.parquet(f"{path}/first")
            self._leaves = self._leaves.unionByName(added)
        self._first = self._spark.read.parquet(f"{path}/first")

    def proofs(self) -> DataFrame:
        """The rows with subroot, root, proof_sha256 (of all siblings up to the root), folded_root (of the claim) and verified."""
        results = {"subroot", "root", "proof_sha256", "folded_root", "verified"}
        columns = [c for c in self._leaves.schema["__row"].dataType.names if c not in results]
        own = [F.col(f"__row.`{c}`").alias(c) for c in columns]
        folder = f"{self._folder}/proofs{self._versions}"
        if self._first.isEmpty():
            none = [F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")]
            return self._leaves.select(*own, *none, F.lit(None).cast("boolean").alias("verified"))
        below = _rounds(self._spark, self._first, f"{folder}/sources")
        subroots = number_lines(below[-1].select("source", "digest"), "source", "digest", name="pos").select(F.lit(None).cast("string").alias("source"), (F.col("pos") - 1).alias("pos"), "digest", F.col("source").alias("__of"))
        subroots.write.parquet(f"{folder}/subroots")
        subroots = self._spark.read.parquet(f"{folder}/subroots")
        above = _rounds(self._spark, subroots.drop("__of"), f"{folder}/root")
        root = above[-1].first()["digest"]  # one row
        headers = self._spark.createDataFrame([(None, 0, [], None)], f"source string, block long, witness {_WITNESS}, subroot string")
        for i, nodes in enumerate(reversed(above)):
            headers = self._kept(_witnessed(nodes, headers), f"{folder}/above{i}")
        headers = headers.drop("source", "subroot").withColumnRenamed("block", "pos").join(subroots.select("pos", F.col("__of").alias("source"), F.col("digest").alias("subroot")), "pos").select("source", F.lit(0).cast("long").alias("block"), "witness", "subroot")
        for i, nodes in enumerate(reversed(below)):
            headers = self._kept(_witnessed(nodes, headers), f"{folder}/below{i}")
        proved = self._leaves.select("id", "__row").join(_proved(self._leaves, headers), "id")
        return proved.select(*own, "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))

    def _kept(self, nodes: DataFrame, path: str) -> DataFrame:
        """A round's nodes as headers of the blocks below, written."""
        nodes.select("source", F.col("pos").alias("block"), "witness", "subroot").write.parquet(path)
        return self._spark.read.parquet(path)


def manifest(rows: DataFrame, source: str = "source", key: str = "doc_id", leaf: str = "leaf", claim: str | None = None) -> DataFrame:
    """The proofs of all rows of a dataset, whose digests are in the column leaf."""
    whole = Manifest(rows.sparkSession)
    whole.append(rows, source, key, leaf, claim)
    return whole.proofs()
