"""Operator 3: media columns.

A payload is stored once, under the SHA-256 digest of its bytes, as a member of
a tar shard.  Rows carry the digest, the shard, and the offset and length of the
member's bytes, so any payload can be read by one range request.  Only the
digests are shuffled to find repeated payloads: a payload that occurs once is
written by the task that reads it, and the others once for all, after each task
has sent its first copy.  Metadata columns are filled by reading each member
from its start until the values are found: one short range as a rule, more
where they stand further on, all of it only where one of them is missing.

Text payloads are stored as zstd frames (`encoding`), others as they are;
offset and length are those of the stored bytes, size is that of the payload.
A frame's first blocks end after 2 KB of text, 4 KB and so on, as a block can
be decoded only when it is complete.

A task writes its shards under names of their own, and the rows that it returns
name them; the table of locations is written before it is used.  So a task that
is lost and run again leaves at most a file that no row names, and
`remove_unnamed` deletes those.

Defined results
---------------
* Null payload: null digest, location and metadata.  Empty payload: the digest
  of no bytes, length and size 0, media type "application/x-empty".
* Equal payloads, repeated rows among them, share one member.
* Payloads of any length are stored whole; one that can't be told is
  "application/octet-stream" with null metadata.  The media type follows from
  the first 2048 bytes, the values are those that the whole payload tells, and
  a value that it doesn't hold is null.
* Nulls in other columns pass through.  A further column named like a result
  column is replaced by the result.
* Empty table: no rows and no shards.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import BitTable, Workspace, bit_table, bounded, free_names

HEADER_BYTES = 2048
BLOCK_BYTES = 1 << 17  # of plain text, the most in a zstd block
LEVEL = 9
PLACE = ["digest", "shard", "offset", "length", "size", "encoding"]
META = ["media_type", "width", "height", "channels", "sample_rate", "charset", "title"]
_PLACE_TYPE = "digest binary, shard string, offset long, length long, size long, encoding string"
_META_TYPE = "media_type string, width int, height int, channels int, sample_rate int, charset string, title string"
_RECORD = 512


_CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)


def sniff(head: bytes) -> str:
    """Media type by the first HEADER_BYTES bytes."""
    head = head[:HEADER_BYTES]
    for magic, kind in (
        (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"),
        (b"BM", "image/bmp"), (b"%PDF-", "application/pdf"), (b"fLaC", "audio/flac"), (b"OggS", "audio/ogg"), (b"ID3", "audio/mpeg"),
        (b"\x1f\x8b", "application/gzip"), (b"PK\x03\x04", "application/zip"),
    ):
        if head.startswith(magic):
            return kind
    if head[:4] == b"RIFF" and head[8:12] in (b"WAVE", b"WEBP"):
        return "audio/wav" if head[8:12] == b"WAVE" else "image/webp"
    if not head:
        return "application/x-empty"
    start = head[:512].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if start.startswith((b"<!doctype html", b"<html", b"<head", b"<body")):
        return "text/html"
    if start.startswith(b"<?xml"):
        return "text/xml"
    try:
        text = head.decode()
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:  # more than a character cut at the end
            return "application/octet-stream"
        text = head[: e.start].decode()
    return "text/plain" if all(c.isprintable() or c.isspace() for c in text) else "application/octet-stream"


def _jpeg_frame(head: bytes) -> int:
    """Where the frame header of a JPEG stands, or the first segment that `head` doesn't hold."""
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF:
        mark, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            break
        at += 2 + size
    return at


def bytes_needed(head: bytes) -> int:
    """Length of the start that holds all values, as far as `head` tells: above its own length, more has to be read."""
    if len(head) < HEADER_BYTES:
        return HEADER_BYTES
    kind = sniff(head)
    if kind == "image/jpeg":
        at = _jpeg_frame(head)
        return at + 10 if at >= len(head) or head[at] == 0xFF else 0
    if kind == "audio/wav":
        at = head.find(b"fmt ")
        return at + 16 if at >= 0 else len(head) + 1
    if kind == "text/html":
        text = head.decode("utf-8", "replace")
        m = _CHARSET.search(text)
        return 0 if m and m.end() < len(text) and _TITLE.search(text) else len(head) + 1
    return 0


def header_metadata(head: bytes) -> dict:
    """Metadata that the first bytes tell."""
    kind = sniff(head)
    out = dict.fromkeys(META) | {"media_type": kind}
    try:
        if kind == "image/png":
            out["width"], out["height"] = struct.unpack(">II", head[16:24])
            out["channels"] = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(head[25])
        elif kind == "image/gif":
            out["width"], out["height"] = struct.unpack("<HH", head[6:10])
            out["channels"] = 3
        elif kind == "image/bmp":
            out["width"], out["height"] = struct.unpack("<ii", head[18:26])
            out["height"] = abs(out["height"])
        elif kind == "image/jpeg":
            at = _jpeg_frame(head)
            if head[at] == 0xFF:
                out["height"], out["width"], out["channels"] = struct.unpack(">HHB", head[at + 5 : at + 10])
        elif kind == "audio/wav":
            at = head.index(b"fmt ")
            out["channels"], out["sample_rate"] = struct.unpack("<HI", head[at + 10 : at + 16])
        elif kind == "text/html":
            text = head.decode("utf-8", "replace")
            if m := _CHARSET.search(text):
                out["charset"] = m[1].lower()
            if m := _TITLE.search(text):
                out["title"] = m[1].strip()
    except (struct.error, IndexError, ValueError):
        pass
    return out


def _store(payload: bytes) -> tuple[str, bytes]:
    if sniff(payload[:HEADER_BYTES]).startswith("text/"):
        zstd = zstandard.ZstdCompressor(level=LEVEL).compressobj(size=len(payload))
        parts, at, cut = [], 0, HEADER_BYTES
        while cut < min(len(payload), BLOCK_BYTES):
            parts += [zstd.compress(payload[at:cut]), zstd.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)]
            at, cut = cut, 2 * cut
        return "zstd", b"".join([*parts, zstd.compress(payload[at:]), zstd.flush()])
    return "identity", payload


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key(hashlib.sha256(x.as_buffer()).digest()) for x in batch.column(0)]
        yield pa.record_batch({"key": pa.array(keys, pa.int64())})


def _member(digest: bytes, encoding: str, size: int) -> bytes:
    info = tarfile.TarInfo(digest.hex() + (".zst" if encoding == "zstd" else ""))
    info.size = size
    return info.tobuf(tarfile.GNU_FORMAT)


class _Shards:
    """The tar shards that one task writes."""

    def __init__(self, folder: str, shard_bytes: int):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.most, self.out, self.name, self.at = shard_bytes, None, None, 0

    def add(self, digest: bytes, size: int, encoding: str, stored: bytes) -> tuple:
        """Appends a member and returns its place."""
        if self.out and self.at + _RECORD + len(stored) > self.most:
            self.close()
        if not self.out:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        gap = -len(stored) % _RECORD
        for part in (_member(digest, encoding, len(stored)), stored, bytes(gap)):
            self.out.write(part)
        place = (digest, self.name, self.at + _RECORD, len(stored), size, encoding)
        self.at += _RECORD + len(stored) + gap
        return place

    def close(self) -> None:
        if self.out:
            self.out.write(bytes(2 * _RECORD))
            self.out.close()
            self.out = None


_PLACE_KINDS = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]


def _place(folder: str, shard_bytes: int, wanted, names: list[str], stored_name: str):
    """Stores each payload that surely occurs once; others get a digest, and their bytes once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, table, seen = _Shards(folder, shard_bytes), BitTable(wanted.value), set()
        try:
            for batch in bounded(batches, 0):
                digests = [hashlib.sha256(x.as_buffer()).digest() if x.is_valid else None for x in batch.column(0)]
                again = table.has(np.array([_key(d) if d else 0 for d in digests], dtype=np.int64))
                rows = []
                for x, digest, repeated in zip(batch.column(0), digests, again):
                    if digest is None:
                        rows.append((None,) * 7)
                    elif repeated and digest in seen:
                        rows.append((digest, *(None,) * 6))
                    else:
                        payload = x.as_buffer().to_pybytes()
                        encoding, stored = _store(payload)
                        if repeated:
                            seen.add(digest)
                            rows.append((digest, None, None, None, len(payload), encoding, stored))
                        else:
                            rows.append((*shards.add(digest, len(payload), encoding, stored), None))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *_columns(rows, [*_PLACE_KINDS, pa.binary()])], names=[*names, *PLACE, stored_name])
        finally:
            shards.close()

    return run


def _write_shards(folder: str, shard_bytes: int):
    """Stores each of the payloads that are sorted by digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, last = _Shards(folder, shard_bytes), None
        try:
            for batch in batches:
                rows = []
                for digest, size, encoding, stored in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if digest != last:
                        rows.append(shards.add(digest, size, encoding, stored))
                        last = digest
                yield pa.RecordBatch.from_arrays(_columns(rows, _PLACE_KINDS), names=PLACE)
        finally:
            shards.close()

    return run


def _plain(stored: bytes, encoding: str) -> bytes:
    """The payload's bytes."""
    return zstandard.ZstdDecompressor().decompressobj().decompress(stored) if encoding == "zstd" and stored else stored


def _read_start(file: pa.NativeFile, offset: int, length: int, encoding: str, header_bytes: int) -> bytes:
    """The payload's first bytes, in ranges of `header_bytes` and more, until they hold all values or the member ends."""
    zstd = zstandard.ZstdDecompressor().decompressobj() if encoding == "zstd" else None
    head, at = b"", 0
    while at < length and (need := bytes_needed(head) - len(head)) > 0:
        part = file.read_at(min(length - at, max(header_bytes, need, at)), offset + at)
        if not part:
            raise ValueError("a shard ends within a member")
        at += len(part)
        head += zstd.decompress(part) if zstd else part
    return head


def _read_headers(folder: str, header_bytes: int, names: list[str]):
    """Adds the metadata columns to rows that have the columns of PLACE after `names`."""
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            found = []
            for shard, offset, length, encoding in zip(*(batch.column(at + i).to_pylist() for i in (1, 2, 3, 5))):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                found.append(header_metadata(_read_start(file, offset, length, encoding, header_bytes)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            meta = [pa.array([m[n] for m in found], k) for n, k in zip(META, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *meta], names=[*names, *PLACE, *META])

    return run


def store_media(
    rows: DataFrame, payload: str, *, folder: str | None = None, shard_bytes: int = 64 << 20, header_bytes: int = HEADER_BYTES
) -> tuple[DataFrame, str]:
    """(`rows` with the payload column replaced by location and metadata columns, folder of the shards)."""
    spark = rows.sparkSession
    ws = Workspace(spark, "media")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or ws.path("shards"))
    hadoop = path.getFileSystem(spark._jsc.hadoopConfiguration())
    hadoop.mkdirs(path)
    folder = re.sub(r"^file:/(?!/)", "file:///", hadoop.makeQualified(path).toString())
    data = F.col(f"`{payload}`").cast("binary")
    names = [c for c in rows.columns if c != payload and c not in PLACE + META]
    others = [F.col(f"`{c}`") for c in names]
    stored_name, data_name = free_names([*names, *PLACE], "stored", "payload")

    # Keys of the payloads that occur more than once; a payload that isn't among them is written where it is read.
    keys = rows.select(data.alias("payload")).where("payload is not null").mapInArrow(_keys, "key long")
    again = spark.sparkContext.broadcast(bit_table(keys.groupBy("key").count().where("count > 1"), ["key"]))
    source = rows.select(data.alias(data_name), *others)
    kind = T.StructType([source.schema[c] for c in names])
    place = T._parse_datatype_string(_PLACE_TYPE)
    full = T.StructType([*kind.fields, *place.fields, T.StructField(stored_name, T.BinaryType())])
    placed = ws.save(source.mapInArrow(_place(folder, shard_bytes, again, names, stored_name), full), "placed")
    with_meta = T.StructType([*kind.fields, *place.fields, *T._parse_datatype_string(_META_TYPE).fields])
    direct = placed.where("shard is not null").select(*others, *PLACE).mapInArrow(_read_headers(folder, header_bytes, names), with_meta)

    repeated = (
        placed.where(F.col(stored_name).isNotNull()).select("digest", "size", "encoding", stored_name).repartition("digest").sortWithinPartitions("digest")
        .mapInArrow(_write_shards(folder, shard_bytes), _PLACE_TYPE)
    )
    described = ws.save(ws.save(repeated, "repeated").mapInArrow(_read_headers(folder, header_bytes, []), f"{_PLACE_TYPE}, {_META_TYPE}"), "described")
    found = described.select([F.col(c).alias(f"{data_name}_{c}") for c in PLACE + META])
    rest = placed.where("shard is null").join(found, F.col("digest") == F.col(f"{data_name}_digest"), "left")
    rest = rest.select(*others, *[F.col(f"{data_name}_{c}").alias(c) for c in PLACE + META])
    return direct.union(rest), folder


def read_payloads(media: DataFrame, folder: str, *, column: str = "payload") -> DataFrame:
    """`media` with the payloads read back, one range read for each row; an altered payload raises an error."""
    names = [c for c in media.columns if c != column]
    schema = media.select(*[F.col(f"`{c}`") for c in names]).withColumn(column, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for digest, shard, offset, length, _, encoding in zip(*(batch.column(names.index(c)).to_pylist() for c in PLACE)):
                if digest is None:
                    out.append(None)
                    continue
                with fs.open_input_file(f"{root}/{shard}") as f:
                    data = _plain(f.read_at(length, offset), encoding)
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError(f"the payload of {digest.hex()} has changed")
                out.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, column])

    return media.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def remove_unnamed(media: DataFrame, folder: str) -> int:
    """Deletes the shards that no row of `media` names, left by lost tasks; returns their number."""
    named = {r[0] for r in media.select("shard").where("shard is not null").distinct().collect()}
    fs, root = pa.fs.FileSystem.from_uri(folder)
    stray = [f for f in fs.get_file_info(pa.fs.FileSelector(root)) if f.base_name.endswith(".tar") and f.base_name not in named]
    for f in stray:
        fs.delete_file(f.path)
    return len(stray)
