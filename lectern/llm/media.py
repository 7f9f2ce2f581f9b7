"""Media columns over content-addressed payloads in tar shards (operator 7).

A text's bytes, padded to whole rows of 64, become an 8-bit grey picture 64 samples wide, stored losslessly as PNG. Tasks
append the pictures to tar shards, named by the payload's digest; a task stores a digest once, and of equal payloads that
different tasks stored, all rows point to one. Rows carry digest, shard, offset and length. Reading back goes by range:
the first 33 bytes of a member fill the metadata columns, its whole range gives payload and features.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_by_bytes, materialise, new_path
from .store import Appender, Ranges

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
INDEX = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
METADATA = "width long, height long, depth int, colour int"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_payload(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (ROW - len(data) if not data else -len(data) % ROW)


def to_png(payload: bytes, level: int = 1) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, depth, colour type) from a member's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG picture")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made; checksums of all chunks are verified."""
    width, height, _, _ = png_header(data[:HEADER_BYTES])
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged picture")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def store_payloads(docs: DataFrame, folder: str | None = None, shard_bytes: int = 256_000_000) -> DataFrame:
    """Writes every text's payload to tar shards and returns the index: doc_id, n_bytes, digest, shard, offset, length.

    A null text is an empty one. Rows that repeat keep a row each, a null doc_id stays null, other columns are not looked at,
    and an empty table gives no rows. The index is written to the shared folder before it is
    returned, so it and the shards belong to the same task attempts.
    """
    folder = folder or new_path(docs.sparkSession, "media")

    def member(name: str, data: bytes) -> bytes:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        return info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % 512)

    def write(batches):
        shard, places = None, {}
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = (text.as_py() or "").encode()
                    payload = to_payload(data)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in places:
                        if shard is None or shard.size > shard_bytes:
                            if shard is not None:
                                shard.add(b"\0" * 1024)
                                shard.close()
                            shard = Appender(folder, ".tar")
                        picture = to_png(payload)
                        places[digest] = (shard.uri, shard.add(member(digest.hex() + ".png", picture)) + 512, len(picture))
                    rows.append((doc_id, len(data), digest, *places[digest]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            if shard is not None:
                shard.add(b"\0" * 1024)
        finally:
            if shard is not None:
                shard.close()

    return materialise(docs.select("doc_id", "text").mapInArrow(write, INDEX), "media-index")


def one_place(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the place that stands for each digest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def read_metadata(places: DataFrame) -> DataFrame:
    """``places`` with width, height, depth and colour added, from header-only range reads."""
    return _read(places, METADATA, lambda ranges, s, o, n: png_header(ranges.read(s, o, HEADER_BYTES)))


def read_features(places: DataFrame) -> DataFrame:
    """``places`` with metadata, and digests and features of the payload as read back from the shards."""

    def row(ranges: Ranges, shard: str, offset: int, length: int) -> tuple:
        width, height, depth, colour = png_header(ranges.read(shard, offset, HEADER_BYTES))
        stored = ranges.read(shard, offset, length)
        payload = from_png(stored)
        samples = np.frombuffer(payload, np.uint8)
        used = int(np.count_nonzero(np.bincount(samples, minlength=256)))
        feature = f"png {width}x{height} {depth} bit, mean {int(samples.sum(dtype=np.int64)) * 1000 // len(samples)}/1000, {used} levels"
        return width, height, depth, colour, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    return _read(places, f"{METADATA}, {FEATURES}", row)


def _read(places: DataFrame, schema: str, row) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def read(batches):
        ranges = Ranges()
        try:
            for batch in batches:
                if batch.num_rows:
                    made = [row(ranges, *at) for at in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(zip(*made), types, strict=True))], ["digest", "shard", "offset", "length", *names])
        finally:
            ranges.close()

    sorted_places = dealt_by_bytes(materialise(places.select("digest", "shard", "offset", "length"), "media-places"), "shard", "offset")
    return sorted_places.mapInArrow(read, f"digest binary, shard string, offset long, length long, {schema}")
