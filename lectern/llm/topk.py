"""Exact top-k by inner product with norm-bucketed retrieval (operator 8).

Vectors are grouped by length into buckets of bounded size (a length that many vectors share is dealt over several). A
first pass over one bucket of long vectors gives each query a score that its k-th best can't fall below. With it, whole
buckets are ruled out by length alone; in the others each query has a local cosine threshold, by which it prunes either by
length or by its largest coordinates. What is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FOCUS = 3  # coordinates looked at
STEEP = 0.4  # local cosine threshold from which coordinates prune better than lengths
SLACK = 1e-9


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) without vectors that are null or hold null or non-finite components."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    return table.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _search(key, queries: pa.Table, bucket: pa.Table, k: int) -> list[tuple[int, int, int]]:
    """The k best of one bucket for each query that can still gain by it."""
    width = key[0].as_py()
    if not width or not queries.num_rows or not bucket.num_rows:
        ids = sorted(bucket["r_id"].to_pylist())
        return [(q, c, 0) for q in queries["vec_id"].to_pylist() for c in [c for c in ids[: k + 1] if c != q][:k]]
    q_ids, theta = queries["vec_id"].to_pylist(), queries["theta"].to_numpy()
    ids, q_all, p = bucket["r_id"].to_numpy(), _matrix(queries["v"], width), _matrix(bucket["r_v"], width)
    length = np.sqrt((p * p).sum(1))
    order = np.lexsort((ids, -length))
    ids, p, length = ids[order], p[order], length[order]
    unit = p / np.maximum(length, 1e-300)[:, None]
    whole = length[0] * np.sqrt((q_all * q_all).sum(1).max()) < 2.0**52  # else products as 64-bit integers
    out = []
    for i, q_id in enumerate(q_ids):
        q = q_all[i]
        q_length = float(np.sqrt(q @ q))
        keep = np.arange(len(ids))
        if theta[i] > 0:
            local = theta[i] / max(q_length * length[0], 1e-300) - SLACK
            if local > 1:
                continue
            keep = keep[: int(np.searchsorted(-length, -(theta[i] / q_length * (1 - SLACK) - SLACK), "right"))]
            if local >= STEEP and len(keep):
                q_unit = q / q_length
                bound = np.minimum(1, theta[i] / (q_length * length[keep]) - SLACK)  # each vector's own cosine threshold
                for f in np.argsort(-np.abs(q_unit))[:FOCUS]:
                    reach = np.sqrt((1 - q_unit[f] ** 2) * (1 - bound**2)) + 1e-7
                    fits = np.abs(unit[keep, f] - q_unit[f] * bound) <= reach
                    # above the threshold the coordinate may move on towards the query's own
                    fits |= (unit[keep, f] - q_unit[f] * bound) * np.sign(q_unit[f]) > 0
                    keep, bound = keep[fits], bound[fits]
        keep = keep[ids[keep] != q_id]
        scores = p[keep] @ q if whole else (p[keep].astype(np.int64) * q.astype(np.int64)).sum(1)
        near = np.flatnonzero(scores >= theta[i])
        if len(near) > k:
            at = np.partition(scores[near], len(near) - k)[len(near) - k]
            near = near[scores[near] >= at]
        best = near[np.lexsort((ids[keep][near], -scores[near]))[:k]]
        out += [(q_id, int(ids[keep[b]]), int(scores[b])) for b in best]
    return out


def top_k(table: DataFrame, every: int = 50, k: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id divides by ``every``, the k best of all other rows.

    Ties go to the smaller vec_id. Rows that share a query's vec_id aren't its candidates; a query row that repeats is asked
    once. Vectors of different widths don't meet. Groups hold at most about ``bucket_rows`` vectors and as many queries.
    """
    vectors = integer_vectors(table).withColumn("width", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))
    vectors = vectors.withColumn("bin", F.floor(F.log2(F.col("norm") + 1) * 4).cast("int"))
    vectors = materialise(vectors, "vectors")
    bins = vectors.groupBy("width", "bin").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts"))
    placed = vectors.join(bins, ["width", "bin"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")).drop("parts")
    placed = materialise(placed, "placed")
    buckets = placed.groupBy("width", "bin", "part").agg(F.max("norm").alias("longest"), F.count("*").alias("n"))
    queries = placed.where(F.col("vec_id") % every == 0).select("width", "vec_id", "v", "norm").dropDuplicates(["vec_id", "v"])
    groups = max(1, -(-queries.count() // bucket_rows))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))

    def meet(asked: DataFrame, rows: DataFrame) -> DataFrame:
        """Queries, each with the buckets it asks, against those buckets."""
        keys = ["width", "bin", "part", "group"]
        wanted = asked.select(*keys).distinct()
        rows = rows.join(wanted, ["width", "bin", "part"]).select(*(F.col(c).alias(f"r_{c}") for c in keys), F.col("vec_id").alias("r_id"), F.col("v").alias("r_v"))

        def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
            found = _search(key, left, right, k)
            cols = zip(*found) if found else ((), (), ())
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

        return asked.groupBy(*keys).cogroup(rows.groupBy(*(f"r_{c}" for c in keys))).applyInArrow(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    head = buckets.where(F.col("n") > k).groupBy("width").agg(F.max(F.struct("bin", -F.col("part"))).alias("h"))
    head = head.select("width", F.col("h.bin").alias("bin"), (-F.col("h.col2")).alias("part"))
    first = meet(queries.join(head, "width").withColumn("theta", F.lit(float("-inf"))), placed)
    floor = materialise(best(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("theta")), "floor")
    asked = queries.join(floor, "vec_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    asked = asked.join(buckets.select("width", "bin", "part", "longest"), "width")
    asked = asked.where(F.col("norm") * F.col("longest") * (1 + SLACK) + SLACK >= F.col("theta")).drop("longest")
    return best(meet(asked, placed)).select("query_id", "rank", "vec_id", "score")
