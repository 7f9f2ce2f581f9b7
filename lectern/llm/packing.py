"""Best-fit packing of documents into token sequences (operator 1).

Tokens are made once; what is packed afterwards are lengths. The histogram of lengths has at most ``capacity`` rows at any
input size: bin completion plans on it (``binplan``), and each piece finds its place from its rank among the pieces of its
length. Ranks come from counts by (length, salt), so a length that holds a third of all pieces is dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binplan import Plan, plan_bins
from .common import hand_back, materialise
from .vocab import default_path, word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's ids, then ``end_id``, cut into pieces of ``capacity`` ids; ``ids`` holds little-endian 32-bit ids.

    A null or empty text is the end id alone. Rows that repeat are packed as often as they come.
    """
    path = tokenizer or default_path("word_bpe_49k.json")

    def cut(batches):
        encoder, end, step = word_encoder(path), int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                held += len(ids)
                rows += [(doc_id, k, at // 4, len(x) // 4, x) for k, at in enumerate(range(0, len(ids), step)) for x in (ids[at : at + step],)]
                if held > 16_000_000:
                    yield to_batch(rows)
                    rows, held = [], 0
            if rows:
                yield to_batch(rows)
        encoder.cache.clear()
        hand_back()

    def to_batch(rows):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first), by length and rank."""
    rows, used, base = [], {}, 0
    for pattern, bins in plan:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            copies = pattern.count(length)
            rows.append((length, used.get(length, 0), base, copies, at))
            used[length] = used.get(length, 0) + copies * bins
            at += copies * length
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = 4096, rows_a_task: int = 100_000) -> DataFrame:
    """``pieces`` with sequence_id and offset added: as few sequences as the plan finds, gapless from 0.

    ``length`` lies between 1 and ``capacity``. ``order`` names columns that fix which of equally long pieces goes where.
    The plan has a few rows for each different length, so it is bounded by the capacity. ``pieces`` is read three times.
    """
    names = pieces.columns
    by_length = pieces.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in by_length.collect()}  # at most `capacity` rows
    table = slots(plan_bins(counts, capacity))
    keys = table[:, 0] * (1 << 40) + table[:, 1]
    salts = max(256, sum(counts.values()) // rows_a_task)
    salt: Column = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))).join(before, ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "_rank"))
            slot = table[np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1]
            t = rank - slot[:, 1]
            made = [batch.column(i) for i in range(len(names))] + [pa.array(slot[:, 2] + t // slot[:, 3]), pa.array(slot[:, 4] + t % slot[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(made, [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids (where kept), ids_crc32, sequence_id, offset.

    Pieces are written once to the shared folder. An empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    pieces = materialise(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): each sequence's ids joined in order; at most `capacity` ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
