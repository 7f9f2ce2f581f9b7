"""BPE encoding and decoding with content-defined chunk reuse (operator 3).

Texts are cut where a rolling hash over their last bytes says so, hence equal passages give equal chunks wherever they
stand. Chunks that occur more than once are encoded once, by the document that owns them, and their ids go to all other
documents that hold them. Each document encodes the rest itself, and every join of two runs of ids is repaired: ids on both
sides are given back, a few more each time, until re-encoding the text between agrees with the ids beside it at a place
where the tokenizer's own cutting pattern must cut.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vocab import ByteEncoder, byte_encoder, default_path

WINDOW = 16
_rng = np.random.default_rng(7)
GEAR = _rng.integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
SPACES = b" \n\t\r\x0b\x0c"


def cut_points(data: bytes, mean: int = 1024, least: int = 256, most: int = 8192) -> list[int]:
    """Chunk ends in ``data``: where the rolling hash of the last 16 bytes has its low bits zero; never within a character.

    The hash of a place depends on the 16 bytes before it only, and the rule of least and most sizes restarts at each cut.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolled = GEAR[raw]
    for k in (1, 2, 4, 8):  # doubles the window each time: sum of gear << age over 16 bytes
        rolled[k:] += rolled[:-k] << np.uint32(k)
    able = (rolled >> np.uint32(8)) % np.uint32(mean) == 0
    places = (np.flatnonzero(able) + 1).tolist()
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > most:
            at = last + most
            while at < n and raw[at] & 0xC0 == 0x80:
                at += 1
            ends.append(at)
            last = at
        if (p - last >= least or p == n) and p > last and (p == n or raw[p] & 0xC0 != 0x80):
            ends.append(p)
            last = p
    return ends


def keys_of(data: bytes, ends: list[int]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([0, *ends], ends)]


def _safe(data: bytes, at: int) -> bool:
    """Whether the pattern must cut at ``at``: a blank or line end after a byte that is not white space."""
    return at in (0, len(data)) or data[at] in b" \n" and data[at - 1] not in SPACES and data[at - 1] < 0x80


def join_runs(encoder: ByteEncoder, data: bytes, runs: list[tuple[int, int, array]]) -> array:
    """Exact ids of ``data`` from runs (start, end, ids of data[start:end] alone) that follow each other.

    ``out`` holds ids that end at byte ``done``. At a join, ids leave ``out`` from its end and the next run from its
    beginning until both sides stop at a place where the pattern must cut, so that what remains agrees with an encoding of
    the whole; the text between is encoded anew.
    """
    widths, out, done = encoder.widths, array("H"), 0
    for start, end, ids in runs:
        if start != done:  # the last join took more than the run before this held
            if end <= done:
                continue
            size = np.cumsum(widths[np.frombuffer(ids, np.uint16)])
            skip = int(np.searchsorted(size, done - start))
            if skip >= len(size) or size[skip] != done - start:
                out.extend(encoder.encode(data[done:end].decode()))
                done = end
                continue
            out.extend(ids[skip + 1 :])
            done = end
            continue
        left, lost = start, 0
        while not _safe(data, left) and lost < len(out):
            lost += 1
            left -= int(widths[out[-lost]])
        right, used, total = start, 0, len(ids)
        while not _safe(data, right) and used < total:
            right += int(widths[ids[used]])
            used += 1
        if used == total and right < len(data) and not _safe(data, right):
            right = next((p for p in range(right, len(data)) if _safe(data, p)), len(data))
        if left < right:
            if lost:
                del out[-lost:]
            out.extend(encoder.encode(data[left:right].decode()))
        out.extend(ids[used:])
        done = max(right, end)
    return out


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc, row, chunk, key) of every chunk of every non-empty text (doc, row, text); key is 128 bits of the chunk's hash."""

    def rows(batches):
        for batch in batches:
            docs, ids, no, keys = [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                found = keys_of(data, cut_points(data))
                docs += [doc] * len(found)
                ids += [row] * len(found)
                no += range(len(found))
                keys += found
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((docs, ids, no, keys), kinds, strict=True)], ["doc", "row", "chunk", "key"])

    return docs.mapInArrow(rows, "doc long, row long, chunk int, key binary")


def bpe_encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row, as the tokenizer gives without added special tokens.

    Null and empty texts have no ids. Rows that share a doc_id, or have none, are told apart by a hash of their text beside
    it, so each comes out with its own ids; rows that repeat whole come out as often. Other columns are not looked at; an
    empty table gives no rows. Very long texts are encoded chunk by chunk. Chunks are counted, and find their owner, through
    partial aggregates; but the rows of a chunk that a large share of documents hold meet its ids in one task, as those come
    from an aggregate, which Spark doesn't split.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")
    row = ["doc", "row"]  # a row key: the hash need only tell the texts of one doc_id apart
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(doc.alias("doc"), F.xxhash64("text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = materialise(chunk_rows(keyed.select(*row, "text")), "chunks")
    shared = held.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*row, "chunk")).alias("owner")).where("n > 1").select("key", "owner")
    shared = materialise(shared, "shared")
    owned = shared.groupBy(F.col("owner.doc").alias("doc"), F.col("owner.row").alias("row")).agg(F.collect_list(F.col("owner.chunk")).alias("chunks"))

    def encode_owned(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            keys, ids = [], []
            for text, chunks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py().encode()
                ends = cut_points(data)
                for c in chunks:
                    part = data[ends[c - 1] if c else 0 : ends[c]]
                    keys.append(xxhash.xxh3_128_digest(part))
                    ids.append(array("H", encoder.encode(part.decode())).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], ["key", "ids"])

    # The keyed texts are dealt by row once: both joins below read the same exchange.
    book = keyed.join(owned, row).select("doc_id", "text", "chunks").mapInArrow(encode_owned, "key binary, ids binary")
    book = book.groupBy("key").agg(F.min("ids").alias("ids"))
    given = held.join(book, "key").groupBy(*row).agg(F.array_distinct(F.collect_list(F.struct("chunk", "ids"))).alias("given"))

    def encode_rest(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            out_id, out_ids, size = [], [], 0
            for doc_id, text, got in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                known = {g["chunk"]: g["ids"] for g in got.as_py() or ()}
                if not known:
                    ids = array("H", encoder.encode(text))
                else:
                    data = text.encode()
                    ids = join_runs(encoder, data, list(_runs(encoder, data, known)))
                out_id.append(doc_id)
                out_ids.append(np.frombuffer(ids, np.uint16).astype(np.int32))
                size += len(ids)
                if size > 4_000_000:
                    yield _ids_batch(out_id, out_ids)
                    out_id, out_ids, size = [], [], 0
            if out_id:
                yield _ids_batch(out_id, out_ids)

    return keyed.join(given, row, "left").select("doc_id", "text", "given").mapInArrow(encode_rest, "doc_id long, ids array<int>")


def _runs(encoder: ByteEncoder, data: bytes, known: dict[int, bytes]):
    """Runs of a text: given chunks as they are, the text between two of them encoded in one go."""
    ends, last = cut_points(data), 0
    for c, end in enumerate(ends):
        start = ends[c - 1] if c else 0
        if c in known:
            if last < start:
                yield last, start, array("H", encoder.encode(data[last:start].decode()))
            yield start, end, array("H", known[c])
            last = end
    if last < len(data):
        yield last, len(data), array("H", encoder.encode(data[last:].decode()))


def _ids_batch(ids: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column], ["doc_id", "ids"])


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text`` added; bytes that aren't UTF-8 become U+FFFD."""
    path = tokenizer or default_path("byte_bpe_50k.json")

    def decode(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            column = batch.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            texts = [encoder.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, text string")
