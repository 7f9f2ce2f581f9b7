"""Alignment of two tokenizers over a corpus (operator 11).

A text is encoded twice, by A (byte-level) and by B (pieces), and cut into groups where tokens of both end at one byte.
Both encoders cut at white space that follows something else, so alignments are made by word and workers keep those they
have met. Most groups are one token of each with the same bytes: an array from A's ids to B's ids of the same bytes is made
beforehand, and such groups are counted in a vector as long as A's vocabulary. Only what is left is counted by pairs of
ids in a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vocab import byte_encoder, default_path

NONE = -1
WORD = re.compile(r"[ \n]+[^ \n]*")
OTHER_BLANK = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
FREQUENT = 1 << 16  # irregular pairs that every task gets; all others are joined
SHIFT = 1 << 20  # a pair of ids as one number: a * SHIFT + b


class PieceEncoder:
    """Ids of a sentence-piece model; every id has bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, self.table = self.model, []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            self.table.append(bytes([int(piece[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else piece.replace("▁", " ").encode())
        shown = [m.id_to_piece(i) for i in range(len(self.table)) if not m.is_byte(i)]
        # no piece holds a line end, or a blank after something else: words then never share one
        self.by_word = not any("\n" in p or re.search("[^▁]▁", p) for p in shown)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def identity(a_table: dict[int, bytes], b_table: list[bytes]) -> np.ndarray:
    """For each id of A the smallest id of B with the same bytes, or NONE."""
    by_bytes: dict[bytes, int] = {}
    for i, b in enumerate(b_table):
        by_bytes.setdefault(b, i)
    out = np.full(max(a_table) + 1, NONE, np.int64)
    for i, b in a_table.items():
        out[i] = by_bytes.get(b, NONE)
    return out


Alignment = tuple[str, int, int, int, np.ndarray]  # written groups, ids of A, ids of B, groups, linked pairs as numbers
BLOCK = 20_000  # words that are encoded in one go


class Aligner:
    """Alignments of texts; keeps up to ``most`` words.

    ``index`` has a word's number, ``shown`` its written groups; ``sizes`` its ids of A and B and its groups, by number, and
    ``links`` its pairs from ``first`` on. A word whose groups are None can't be given back by its ids.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 500_000):
        self.a, self.b, self.most = byte_encoder(a_path), piece_encoder(b_path), most
        self.same = identity(self.a.table, self.b.table)
        self.b_widths = np.array([len(x) for x in self.b.table], np.int64)
        n_a, n_b = len(self.a.widths), len(self.b.table)
        self.written = np.array([f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], object)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.shown: list[str | None] = []
        self.sizes, self.links, self.first = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def block(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """(written groups of each word, sizes, pairs) of words that stand in a row; None where the ids don't give them back."""
        joined = "".join(words)
        data = joined.encode()
        a, b = self.a.coder.encode_to_numpy(joined, disallowed_special=()).astype(np.int64), np.array(self.b.encode(joined[1:]), np.int64)
        ends_a, ends_b = np.cumsum(self.a.widths[a]), np.cumsum(self.b_widths[b])
        if b"".join(map(self.b.table.__getitem__, b.tolist())) != data or ends_a[-1] != len(data) or not self.b_widths[b].all():
            return None
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        stops = np.cumsum([len(w.encode()) for w in words])
        last = np.searchsorted(common, stops)  # each word's last group
        if (common[np.minimum(last, len(common) - 1)] != stops).any():
            return None
        i, j = np.arange(len(a)), np.arange(len(b))
        of_a, of_b = np.searchsorted(at_a, i), np.searchsorted(at_b, j)
        flat = np.empty(len(a) + len(b), np.int64)
        flat[i + np.concatenate([[0], at_b + 1])[of_a]] = a + (at_a[of_a] == i) * len(self.a.widths)
        flat[j + at_a[of_b] + 1] = 2 * len(self.a.widths) + b + (at_b[of_b] == j) * len(self.b.table)
        parts = self.written[flat].tolist()
        n = np.stack([at_a[last] + 1, at_b[last] + 1, last + 1], 1)
        stop = (n[:, 0] + n[:, 1]).tolist()
        shown = ["".join(parts[x:y])[:-1] for x, y in zip([0, *stop], stop)]
        return shown, np.diff(n, axis=0, prepend=0), a[at_a] * SHIFT + b[at_b]

    def learn(self, words: list[str]) -> None:
        """Puts new words into the table. Those of blanks alone stand by themselves: beside others they'd be one run of blanks."""
        made: list[tuple[list[str], list, np.ndarray, np.ndarray]] = []

        def add(some: list[str]) -> None:
            found = self.block([" x", *some])  # something of its own in front, so that the blank that B adds is not a word's
            if found is not None:
                shown, sizes, links = found
                made.append((some, shown[1:], sizes[1:], links[sizes[0, 2] :]))
            elif len(some) > 1:
                add(some[: len(some) // 2])
                add(some[len(some) // 2 :])
            else:
                made.append((some, [None], np.zeros((1, 3), np.int64), np.zeros(0, np.int64)))

        solid = [w for w in words if not w.endswith((" ", "\n"))]
        for i in range(0, len(solid), BLOCK):
            add(solid[i : i + BLOCK])
        for w in words:
            if w.endswith((" ", "\n")):
                add([w])
        for some, shown, _, _ in made:
            self.index.update(zip(some, range(len(self.shown), len(self.shown) + len(some))))
            self.shown += shown
        self.sizes = np.concatenate([self.sizes, *(m[2] for m in made)])
        self.links = np.concatenate([self.links, *(m[3] for m in made)])
        self.first = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]

    def whole(self, text: str) -> Alignment | None:
        """The alignment of blank + text as one word."""
        found = self.block([f" {text}"])
        return (found[0][0], *found[1][0].tolist(), found[2]) if found else None

    def texts(self, texts: list[str | None]) -> list[Alignment | None]:
        """The alignment of blank + text for each; None for a text that has no tokens."""
        words = [WORD.findall(f" {t}") if t and self.b.by_word and not OTHER_BLANK.search(t) else None for t in texts]
        numbers = [list(map(self.index.get, ws or ())) for ws in words]
        new = {w for ws, k in zip(words, numbers) if None in k for w, i in zip(ws, k) if i is None}
        if new:
            if len(self.index) + len(new) > self.most:
                self.forget()
                new = {w for ws in words for w in ws or ()}
            self.learn(sorted(new))
        out = []
        for text, ws, k in zip(texts, words, numbers, strict=True):
            if ws is None:
                out.append(self.whole(text) if text else None)
                continue
            if new:
                k = list(map(self.index.__getitem__, ws))
            shown = list(map(self.shown.__getitem__, k))
            if None in shown:  # the model changes some character
                out.append(self.whole(text))
                continue
            n, first = self.sizes[k], self.first[k]
            groups = n[:, 2]
            at = np.repeat(first - np.cumsum(groups) + groups, groups) + np.arange(groups.sum())
            out.append((";".join(shown), *n.sum(0).tolist(), self.links[at]))
        return out


@functools.cache
def aligner_of(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, links array<long>, times array<int>"


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = True) -> DataFrame:
    """ALIGNED of every row: counts, the groups as text (where kept) and their digest, distinct linked pairs with their counts.

    A: a byte-level BPE file, by which blank + text is encoded; B: a sentence-piece model, which adds the blank. Strings of
    special tokens are plain text. A link is a token of A and one of B that end at one byte; each group ends with one. Null
    and empty texts, and texts that the ids don't give back, have no tokens.
    """
    a_path, b_path = a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")

    def rows(batches):
        aligner = aligner_of(a_path, b_path)  # a worker keeps its words from task to task
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = [m or ("", 0, 0, 0, np.zeros(0, np.int64)) for m in aligner.texts(part.column(1).to_pylist())]
                digests = [hashlib.sha256(m[0].encode()).hexdigest() if m[1] else "" for m in made]
                pairs = [np.unique(m[4], return_counts=True) for m in made]
                n = [pa.array([m[k] for m in made], pa.int64()) for k in (1, 2, 3)]
                shown = pa.array([m[0] for m in made] if keep_groups else [None] * len(made), pa.string())
                links = pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *n, n[2], shown, pa.array(digests, pa.string()), *links], [x.split()[0] for x in ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, ALIGNED)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame, same: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """(links of each id of A with its twin in B, irregular pairs as (pair, count)).

    ``aligned`` is read once. A task adds its one-to-one groups up in a vector, which is as long as A's vocabulary whatever
    the input; other pairs leave it summed as well, and meet in a shuffle.
    """

    def rows(batches):
        vector, other = np.zeros(len(same), np.int64), {}
        for batch in batches:
            links, times = _flat(batch, "links"), _flat(batch, "times")
            a = links // SHIFT
            plain = same[a] == links % SHIFT
            vector += np.bincount(a[plain], times[plain], len(same)).astype(np.int64)
            pairs, at = np.unique(links[~plain], return_inverse=True)
            for p, n in zip(pairs.tolist(), np.bincount(at, times[~plain], len(pairs)).astype(np.int64).tolist()):
                other[p] = other.get(p, 0) + n
            if len(other) > 500_000:
                yield pairs_of(other, False)
                other = {}
        held = np.flatnonzero(vector)
        yield pairs_of(other, False)
        yield pairs_of(dict(zip(held.tolist(), vector[held].tolist())), True)

    def pairs_of(counts, regular):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.array([regular] * len(counts), pa.bool_())], ["pair", "n", "regular"])

    summed = aligned.select("links", "times").mapInArrow(rows, "pair long, n long, regular boolean").groupBy("regular", "pair").agg(F.sum("n").alias("count"))
    summed = materialise(summed, "pairs")
    vector = np.zeros(len(same), np.int64)
    for r in summed.where("regular").select("pair", "count").collect():  # an id of A each
        vector[r["pair"]] = r["count"]
    return vector, summed.where("NOT regular").select("pair", "count")


def score_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, where kept) of every row.

    A pair's count is how many links of the corpus hold it. n_best counts links whose pair has the highest count of all
    pairs with its id of B, count_sum adds the counts of a row's links up. Rows that repeat or share a doc_id, or have none,
    come out each and count each. Null and empty texts, and those without tokens, have zeros. Other columns are not looked
    at; an empty table gives no rows. The ``frequent`` most frequent irregular pairs go to all tasks; rows are joined with
    the counts of the others by pair.
    """
    a_path, b_path = a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")
    aligned = materialise(align(docs, a_path, b_path, keep_groups).withColumn("row", F.monotonically_increasing_id()), "aligned")
    same = identity(byte_encoder(a_path).table, piece_encoder(b_path).table)
    vector, other = pair_counts(aligned, same)
    best = np.zeros(len(piece_encoder(b_path).table), np.int64)
    held = np.flatnonzero(same != NONE)
    np.maximum.at(best, same[held], vector[held])
    for r in other.groupBy((F.col("pair") % SHIFT).alias("b")).agg(F.max("count").alias("m")).collect():  # an id of B each
        best[r["b"]] = max(best[r["b"]], r["m"])
    top = np.array([(r["pair"], r["count"]) for r in other.orderBy(F.desc("count"), "pair").limit(frequent).collect()], np.int64).reshape(-1, 2)
    top = top[np.argsort(top[:, 0])]
    sent = docs.sparkSession.sparkContext.broadcast((same, vector, best, top))  # bounded by both vocabularies and ``frequent``

    def rows(batches):
        same, vector, best, top = sent.value
        for batch in batches:
            links, times = _flat(batch, "links"), _flat(batch, "times").astype(np.int64)
            sizes = np.diff(batch.column(batch.schema.get_field_index("links")).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            a, b = links // SHIFT, links % SHIFT
            plain = same[a] == b
            count = np.where(plain, vector[a], 0)
            if len(top):
                at = np.minimum(np.searchsorted(top[:, 0], links), len(top) - 1)
                count = np.where(~plain & (top[at, 0] == links), top[at, 1], count)
            known = count > 0
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, row, times * (known & (count == best[b])))
            np.add.at(total, row, times * count)
            left = np.flatnonzero(~known)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[left])) for x in (links, times, best[b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total), *lists], ["row", "best", "total", "links", "times", "tops"])

    read = aligned.select("row", "links", "times").mapInArrow(rows, "row long, best long, total long, links array<long>, times array<long>, tops array<long>")
    read = materialise(read, "read")
    rest = read.where(F.size("links") > 0).select("row", F.explode(F.arrays_zip("links", "times", "tops")).alias("l")).select("row", F.col("l.links").alias("pair"), "l.times", "l.tops")
    joined = rest.hint("merge").join(other, "pair")
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("tops"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_total"))
    sums = read.select("row", "best", "total").join(more, "row", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = aligned.select("row", *names, "groups_sha256", *(["groups"] if keep_groups else [])).join(sums, "row")
    none = F.lit(0).cast("long")
    return out.select(*names, (F.col("best") + F.coalesce("more_best", none)).alias("n_best"), (F.col("total") + F.coalesce("more_total", none)).alias("count_sum"), "groups_sha256", *(["groups"] if keep_groups else []))
