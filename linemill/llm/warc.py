"""WARC archives in Zstandard: one frame for each record, and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every
record after it is a frame of its own, compressed with that dictionary, so a
reader can decode frame by frame. Tasks write archives of bounded size under
names that no other attempt uses, and report them; only reported archives are
read, so the leavings of a lost task do no harm.

Records of equal payloads: the one with the largest key is the response, the
others are revisits that name it and carry no payload.

Defined results: a null payload is empty; empty payloads are equal to each
other like any others (least_bytes keeps shorter ones apart); rows with a null
key are written and read back with a null key and lose ties to all others;
repeated rows of one key and payload are one response each. A payload is one
record of one frame; with its head it has to fit an archive that binaryFile can
read (2 GB compressed). Columns of other names do no harm. An empty table gives
no archives and an empty result. Archives are written through Arrow's file
systems: local, HDFS, S3 and Google Cloud Storage paths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm._common import broadcast_up_to, cut_lineage

#: Skippable frame that leads an archive, and the magic number of a frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Uncompressed bytes after which an archive is closed, and of one dictionary at most.
ARCHIVE_BYTES, DICTIONARY_BYTES = 64 << 20, 16 << 10
#: Records of a task that its dictionary is trained on, and the bytes of each payload that count.
DICTIONARY_RECORDS, SAMPLE_BYTES = 256, 8 << 10
#: Most archives whose names are broadcast to the readers; a name is shorter than 64 bytes.
MOST_NAMES = 2_000_000
LEVEL = 3

_VERSION = b"WARC/1.1"
_KEY = "urn:x-linemill:record:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_KEY = "none"


class BadRecord(ValueError):
    """A frame or record that breaks the format."""


def record_bytes(key: str, url: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit (refers_to given) has the payload's length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        _VERSION.decode(),
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <{_KEY}{key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_KEY}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = raw.split(b"\r\n")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"header line without a colon: {line[:60]!r}")
        found[name.decode("latin-1").strip().lower()] = value.decode("utf-8").strip()
    return first, found


def parse_record(raw: bytes) -> dict[str, object]:
    """Key, url, type, refers_to, payload length, digest and payload of a record, all validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, found = _headers(head)
    if not gap or first != _VERSION:
        raise BadRecord(f"not a record: {raw[:20]!r}")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(found):
        raise BadRecord(f"record without {sorted(missing)}")
    length = int(found["content-length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"a block of {len(rest) - 4} bytes where the header says {length}")
    status, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not status.startswith(b"HTTP/1.1 "):
        raise BadRecord("a block without an HTTP head")
    said = int(_headers(status)[1]["content-length"])
    digest = found["warc-payload-digest"].removeprefix("sha1:")
    kind = found["warc-type"]
    if kind == "response":
        if len(payload) != said:
            raise BadRecord(f"a payload of {len(payload)} bytes where the head says {said}")
        if digest != payload_digest(payload):
            raise BadRecord(f"the payload's digest is not {digest}")
    elif kind != "revisit" or payload:
        raise BadRecord(f"a record of type {kind} with {len(payload)} bytes of payload")
    bare = lambda x: x[1:-1].removeprefix(_KEY) if x else None
    return {"key": bare(found["warc-record-id"]), "url": found.get("warc-target-uri", ""), "type": kind, "refers_to": bare(found.get("warc-refers-to")), "payload_bytes": said, "digest": digest, "payload": payload}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary trained on sample records; where they are too few or too short to train on, their starts as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        each = max(1, DICTIONARY_BYTES // max(1, len(records)))
        return b"".join(r[:each] for r in records)[:DICTIONARY_BYTES]


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame.

    Raises BadRecord where a frame is cut off or is none.
    """
    import zstandard

    view, at = memoryview(raw), 0
    dictionary = None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", raw, 4)[0]
        if 8 + size > len(raw):
            raise BadRecord("the dictionary's frame is cut off")
        content = bytes(view[8 : 8 + size])
        if content[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary, at = zstandard.ZstdCompressionDict(content) if content else None, 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(raw):
        if len(raw) - at < 4 or struct.unpack_from("<I", raw, at)[0] != FRAME:
            raise BadRecord(f"no frame at byte {at}")
        one = reader.decompressobj()
        out, step = [], 1 << 16
        start = at
        while not one.eof:
            if at >= len(raw):
                raise BadRecord(f"the frame at byte {start} is cut off")
            out.append(one.decompress(view[at : at + step]))
            at += step
        at = min(at, len(raw)) - len(one.unused_data)
        yield b"".join(out)


def _marked(pages: DataFrame, key: str, payload: str, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """pages with their payload's digest; the key and digest of revisits with their response's key."""
    body = F.coalesce(F.encode(F.col(f"`{payload}`"), "utf-8"), F.lit(b""))
    known = pages.select("*", F.sha1(body).alias("__sha1"), F.octet_length(body).alias("__bytes"))
    groups = known.where(F.col("__bytes") >= least_bytes).groupBy("__sha1", "__bytes").agg(F.max(f"`{key}`").alias("__last"), F.count("*").alias("__n")).where("__n > 1")
    # Keys of the pages that have equals, without their payloads.
    revisits = known.select(F.col(f"`{key}`").alias("__key"), "__sha1", "__bytes").join(groups, ["__sha1", "__bytes"]).where(~F.col("__key").eqNullSafe(F.col("__last"))).select("__key", "__sha1", "__last").distinct()
    return known, revisits


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row into archives in folder; returns their (path, records)."""
    known, revisits = _marked(pages, key, payload, least_bytes)
    # Few revisits need no shuffle of the payloads.
    revisits = broadcast_up_to(cut_lineage(revisits), 200_000)
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (known["__sha1"] == revisits["__sha1"])
    rows = known.join(revisits, same, "left").select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{payload}`").alias("payload"), F.col("__last").cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        dictionary, coder, out, used, records, number, done = b"", None, None, 0, 0, 0, []
        for batch in batches:
            keys, urls, payloads, refers = (batch.column(i).to_pylist() for i in range(4))
            if coder is None:
                sample = [record_bytes(one or _NO_KEY, address or "", "", (body or "").encode()[:SAMPLE_BYTES], None) for one, address, body in zip(keys[:DICTIONARY_RECORDS], urls, payloads)]
                dictionary = dictionary_of(sample)
                held = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
                coder = zstandard.ZstdCompressor(level=LEVEL, **held)
            for one, address, body, response in zip(keys, urls, payloads, refers):
                if out is None:
                    path = f"{root}/{attempt}-{number:04d}.warc.zst"
                    out, used, records = store.open_output_stream(path, compression=None), 0, 0
                    out.write(archive_head(dictionary))
                raw = (body or "").encode()
                record = record_bytes(one if one is not None else _NO_KEY, address or "", payload_digest(raw), raw, response)
                out.write(coder.compress(record))
                used, records = used + len(record), records + 1
                if used >= archive_bytes:
                    out.close()
                    done.append((path.rpartition("/")[2], records))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            done.append((path.rpartition("/")[2], records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["name", "records"])

    return rows.mapInArrow(write, "name string, records long")


RECORD = "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload string"


def read_archives(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """The validated records of the archives that written names.

    The names are broadcast, so archives are read where they are and not
    shuffled. A broken archive fails the task that reads it, with its name.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, held = [], 0
                try:
                    for raw in read_archive(content.as_buffer().to_pybytes()):
                        found.append(parse_record(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield _batch(found)
                            found, held = [], 0
                except BadRecord as bad:
                    raise BadRecord(f"{name}: {bad}") from bad
                if found:
                    yield _batch(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(broadcast_up_to(written.select("name"), MOST_NAMES), "name", "left_semi")
    return named.select("name", "content").mapInArrow(read, RECORD)


def _batch(found: list[dict[str, object]]) -> pa.RecordBatch:
    names = ("key", "url", "type", "refers_to", "payload_bytes", "digest", "payload")
    columns = [[r[n] for r in found] for n in names]
    columns[0] = [None if k == _NO_KEY else k for k in columns[0]]
    columns[6] = [p.decode() for p in columns[6]]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])
