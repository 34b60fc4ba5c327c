"""Hierarchical multi-length packing of token streams into training windows.

Each task packs the documents of its own partition; nothing is shuffled.
A document's tokens are first cut into full windows of the longest size. The
rest is routed to the smallest tier (a power of two) that holds it. The longest
tier opens windows whose gaps are filled from the shorter tiers, largest
fitting fragment first and then a cut one; the shorter tiers pack what is left
into windows of their own size in the same way. Windows of a short tier are
bundled until they add up to one long slot, and slots are dealt to step groups
of equal token totals.

Defined results: a null or empty text has only its end token; repeated rows
(also of one key) are packed each on its own; a very long text is cut into full
windows; other columns of docs, whatever their names, are left out; an empty
table gives no pieces.
A partition leaves at most one window that is not full for each tier.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._memo import release
from linemill.llm.tokens import codec, runs

#: Window sizes from short to long; each is a power of two, so full windows need no padding.
TIERS = (512, 1024, 2048)
#: Slots of the longest size in one step group.
STEP_SLOTS = 64
#: Bytes of texts that are encoded together.
PACK_BYTES = 2 << 20
#: Fragments that wait for a window before a round of packing.
ROUND_FRAGMENTS = 4096

PIECES = (
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
    ("window", T.LongType()),
    ("step_group", T.LongType()),
)


class _Fragment:
    """Ids of a document from a place on. A fragment holds its own ids only, so one that waits does not keep its document."""

    __slots__ = ("key", "ids", "start", "total")

    def __init__(self, key, ids: bytes, start: int, total: int):
        self.key, self.ids, self.start, self.total = key, ids, start, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def take(self, n: int) -> _Fragment:
        """The first n tokens; what stays is the rest."""
        head = _Fragment(self.key, self.ids[: 4 * n], self.start, self.total)
        self.ids, self.start = self.ids[4 * n :], self.start + n
        return head


class _Pool:
    """Fragments of one tier by length."""

    def __init__(self):
        self._lengths: list[int] = []
        self._by: dict[int, list[_Fragment]] = {}
        self.tokens = 0

    def __len__(self) -> int:
        return len(self._lengths)

    def put(self, fragment: _Fragment) -> None:
        insort(self._lengths, len(fragment))
        self._by.setdefault(len(fragment), []).append(fragment)
        self.tokens += len(fragment)

    def _pop(self, at: int) -> _Fragment:
        n = self._lengths.pop(at)
        fragment = self._by[n].pop()
        self.tokens -= n
        return fragment

    def fitting(self, most: int) -> _Fragment | None:
        """The longest fragment of at most so many tokens."""
        at = bisect_left(self._lengths, most + 1) - 1
        return self._pop(at) if at >= 0 else None

    def longest(self) -> _Fragment | None:
        return self._pop(len(self._lengths) - 1) if self._lengths else None


class Packer:
    """Packs the fragments of one partition; full windows come out of add() and flush()."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_slots: int = STEP_SLOTS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are growing powers of two")
        self._tiers, self._top, self._step_slots = tiers, tiers[-1], step_slots
        self._pools = {t: _Pool() for t in tiers}
        self._base, self._sequence, self._slots = partition << 40, 0, 0
        self._open: dict[int, tuple[int, int]] = {}  # tier: slot, tokens of it that are dealt out

    def _slot(self, tier: int) -> int:
        slot, used = self._open.get(tier, (-1, self._top))
        if used + tier > self._top:
            slot, used = self._slots, 0
            self._slots += 1
        self._open[tier] = (slot, used + tier)
        return slot

    def _window(self, fragments: list[_Fragment], tier: int) -> Iterator[tuple]:
        sequence, group, at = self._base | self._sequence, self._base | self._slot(tier) // self._step_slots, 0
        self._sequence += 1
        for f in fragments:
            n = len(f)
            yield (f.key, f.start, n, zlib.crc32(f.ids), f.total, sequence, at, tier, group)
            at += n

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        at, total = 0, len(ids) // 4
        while total - at >= self._top:
            yield from self._window([_Fragment(key, ids[4 * at : 4 * (at + self._top)], at, total)], self._top)
            at += self._top
        if at < total:
            self._pools[next(t for t in self._tiers if total - at <= t)].put(_Fragment(key, ids[4 * at :], at, total))
        if sum(map(len, self._pools.values())) >= ROUND_FRAGMENTS:
            yield from self._round()

    def _round(self, last: bool = False) -> Iterator[tuple]:
        """Empty the tiers from the longest to the shortest into full windows."""
        for at in range(len(self._tiers) - 1, -1, -1):
            tier, pool = self._tiers[at], self._pools[self._tiers[at]]
            fillers = [self._pools[t] for t in self._tiers[at::-1]] if at == 0 else [self._pools[t] for t in self._tiers[at - 1 :: -1]] + [pool]
            while len(pool) and (last or sum(p.tokens for p in fillers) + (pool.tokens if pool not in fillers else 0) >= tier):
                yield from self._window(self._fill(pool.longest(), tier, fillers), tier)

    def _fill(self, first: _Fragment, tier: int, fillers: list[_Pool]) -> list[_Fragment]:
        window, gap = [first], tier - len(first)
        for pool in fillers:
            while gap and (found := pool.fitting(gap)):
                window.append(found)
                gap -= len(found)
        while gap and (found := next((f for p in fillers if (f := p.longest())), None)):
            if len(found) > gap:
                window.append(found.take(gap))
                gap = 0
                self._pools[next(t for t in self._tiers if len(found) <= t)].put(found)
            else:
                window.append(found)
                gap -= len(found)
        return window

    def flush(self) -> Iterator[tuple]:
        yield from self._round()
        yield from self._round(last=True)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step_slots: int = STEP_SLOTS) -> DataFrame:
    """One row for each piece of a document in a window.

    Columns: the key, start and length of the piece in its document's ids,
    ids_crc32 of the piece's little-endian ids, doc_tokens with the end token,
    sequence_id, offset in the sequence, window (its tier's size) and
    step_group. Sequences shorter than their window are to be padded to it.
    """
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in PIECES]])
    end = end_id.to_bytes(4, "little")
    arrow_key: list[pa.DataType] = []

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(vocabulary, False)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_slots)

        def rows(found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=[key, *[n for n, _ in PIECES]])

        for batch in batches:
            arrow_key[:] = [batch.column(0).type]
            at = 0
            for part in runs(batch.column(1), PACK_BYTES):
                ids, sizes = encoder.ids(part)
                raw, ends = ids.tobytes(), 4 * np.cumsum(sizes)
                found: list[tuple] = []
                for one, start, stop in zip(batch.column(0).slice(at, len(part)).to_pylist(), (ends - 4 * sizes).tolist(), ends.tolist()):
                    found += packer.add(one, raw[start:stop] + end)
                at += len(part)
                if found:
                    yield rows(found, arrow_key[0])
        if arrow_key and (found := list(packer.flush())):
            yield rows(found, arrow_key[0])
        release()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(pack_batches, schema)
