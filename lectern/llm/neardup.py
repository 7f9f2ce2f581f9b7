"""Near-duplicate detection by MinHash bands and odd sketches (operator 4).

Documents with equal shingle sets form a class, and only classes are compared. A class has MinHash bands, which put it in
buckets, and an odd sketch: its MinHash samples folded into a parity bitmap. The bits in which two sketches differ estimate
how many samples differ, precisely where similarity is high, so a pair whose bitmaps differ too much needs no further look.
Pairs that remain are confirmed on full shingle sets.

Pairs are never written out bucket by bucket. Every class is first held against one leader of its bucket, twice with
different leaders; links join classes to components, and only buckets that still hold several components go on. There each
class outside the bucket's largest component asks the members of every block, those closest by sketch first, then all the rest
that sketches can't rule out. Only classes that ask go from block to block; where they are many, each first asks in its own
block alone, as those that find a link there needn't go. A task names the sets that it needs and gets each of them
once. Pairs are left out only where both classes lie in one component already, or where an earlier band has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hand_back, materialise

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BINS, BITS = 8192, 4096  # of the sketches
WORDS = BITS // 64
BLOCK, VISITORS, FAMILY = 512, 2048, 64  # classes of a block, those that come to one to ask, pairs of a leader that one task confirms
ASKING, HELD = 256, 2_000_000  # classes that ask and shingles that are held, for one confirming group
FIRST = 16
LONG = 256  # bytes from which a word is hashed by itself
_rng = np.random.default_rng(11)
MULTIPLY = _rng.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)
P = np.uint64(0x100000001B3 * 0x9E3779B97F4A7C15 % (1 << 64))
BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.cumprod(np.full(LONG, P | np.uint64(1)), dtype=np.uint64)
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
PLACES = np.arange(SAMPLES, dtype=np.uint64)
TOP = np.uint64(65 - SAMPLES.bit_length())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in order: A-Z lower-cased, words between ASCII white space.

    A word's hash is a polynomial in its bytes; those of LONG bytes or more, of which few can be alike, are hashed one by one.
    """
    data = (text or "").encode().lower()
    raw = np.frombuffer(data, np.uint8)
    ink = np.zeros(len(raw) + 2, bool)
    np.logical_not(BLANK[raw], out=ink[1:-1])
    bounds = np.flatnonzero(ink[1:] != ink[:-1])
    starts, sizes = bounds[0::2], bounds[1::2] - bounds[0::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.cumsum(sizes) - sizes
    place = np.arange(at[-1] + sizes[-1]) - np.repeat(at, sizes)
    long = np.flatnonzero(sizes >= LONG)
    if len(long):
        np.minimum(place, LONG - 1, out=place)
    h = np.add.reduceat(BYTE[raw[ink[1:-1]]] * POWER[place], at)
    for i in long:
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return h


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; with fewer words, of all of them as one."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * P + _mix(w[k : len(w) - n + 1 + k])
    h = np.sort(_mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a sorted set: the smallest member of each of SAMPLES parts of the hash range.

    A part without members takes the smallest under a hash of its own. For the union of two sets that choice falls on any
    member alike, so a sample of both sets is equal with their similarity as its chance.
    """
    out = s[np.minimum(np.searchsorted(s, PLACES << TOP), len(s) - 1)]
    empty = np.flatnonzero(out >> TOP != PLACES)
    for i in range(0, len(empty) and len(s), 1024):
        least = (s[i : i + 1024, None] * MULTIPLY[empty] + ADD[empty]).min(0)
        out[empty] = np.minimum(out[empty], least) if i else least
    return out


def sketch(s: np.ndarray) -> tuple[int, np.ndarray]:
    """How many MinHash samples a set has, and their parity bitmap.

    Samples are the smallest member of each of BINS parts of the hash range (one-permutation MinHash), so a set smaller than
    that is sampled nearly whole.
    """
    part = s >> np.uint64(64 - BINS.bit_length() + 1)
    first = s[np.concatenate([[True], part[1:] != part[:-1]])] if len(s) else s  # s is sorted
    at = _mix(first * P) >> np.uint64(64 - BITS.bit_length() + 1)
    parity = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return len(first), np.packbits(parity).view(np.int64)


def filled(n: np.ndarray) -> np.ndarray:
    """How many of the sketches' parts a set of n members fills, on average."""
    return BINS * -np.expm1(-n / BINS)


def least_similarity(union: np.ndarray, percent: int) -> np.ndarray:
    """The estimate below which a pair is surely unlinked: five deviations at the least similarity that links.

    The deviation has three causes: which members of the union are samples, how many parts the union fills, and samples that
    fall on one bit of the bitmap. Tiny sets get room for two samples more.
    """
    share, c, parts = percent / 100, union / BINS, filled(union)
    unlike = 2 * filled(union * (1 + share) / 2) - 2 * share * parts
    decay = np.exp(-2 * unlike / BITS)
    odd = (1 - decay) / 2
    folding = np.maximum(0, BITS * odd * (1 - odd) - unlike * decay * decay) / (decay * decay) / 4
    occupied = BINS * (np.exp(-c) - (1 + c) * np.exp(-2 * c))
    sampling = share * (1 - share) * parts * np.maximum(0, 1 - parts / union)
    return share - 5 * np.sqrt(folding + np.maximum(0, occupied) * share**2 + sampling) / parts - 2 / parts


def estimate(differ: np.ndarray, samples: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Similarity from the bits in which two sketches differ, the samples of both together, and the size of their union.

    Half of the samples less those not shared are shared ones; they are set against the parts that the union fills.
    """
    unlike = -BITS / 2 * np.log(np.maximum(1e-9, 1 - 2 * differ / BITS))
    return (samples - unlike) / 2 / filled(union)


def may_link(differ: np.ndarray, n: np.ndarray, m: np.ndarray, samples: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members, whose sketches differ in so many bits, may be as similar as ``percent``."""
    union = (n + m) / (1 + percent / 100)  # at the least similarity that links; it is smaller above
    sizes = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return sizes & (estimate(differ, samples, union) >= least_similarity(union, percent))


def band_keys(least: np.ndarray) -> np.ndarray:
    """A row of band keys for each row of samples; keys of different bands never mean the same."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), 1))
    for k in range(ROWS):
        h = _mix(h * P + least[:, k::ROWS])
    return h.view(np.int64)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n, key, bands, samples, sketch) of every row; all but doc_id and n are null for empty sets."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                n, keys, least, counts, maps = [], [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py(), size)
                    n.append(len(s))
                    if len(s):
                        keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                        least.append(samples(s))
                        count, bitmap = sketch(s)
                        counts.append(count)
                        maps.append(bitmap)
                full = np.array(n) > 0
                at = np.cumsum(full) - 1
                take = pa.array(at, mask=~full)
                some = (keys, list(band_keys(np.array(least).reshape(-1, SAMPLES))), counts, maps)
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))
                made = [pa.array(x, k).take(take) for x, k in zip(some, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *made], ["doc_id", "n", "key", "bands", "samples", "sketch"])
        hand_back()

    return docs.mapInArrow(rows, "doc_id long, n long, key binary, bands array<long>, samples long, sketch array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node it is connected with.

    Each pass hooks every node to its smallest neighbour, follows the hooks to their ends, and contracts the edges.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while edges.head(1):
        hooks = materialise(edges.groupBy("a").agg(F.min("b").alias("b")), "hooks")
        while True:
            on = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = materialise(hooks.join(on, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("a", "b")
            if not jumped.where("moved").head(1):
                break
        to = lambda c: hooks.select(F.col("a").alias(c), F.col("b").alias(f"{c}_root"))
        if roots is None:
            nodes = edges.select(F.col("b").alias("node")).distinct().join(hooks.select(F.col("a").alias("node")), "node", "left_anti")
            roots = hooks.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(nodes.select("node", F.col("node").alias("root")))
        else:
            roots = roots.join(to("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root"))
        roots = materialise(roots, "roots")
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = materialise(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after links (a, b) between roots; a node that no link has reached yet has no row."""
    found = components(links)
    if roots is None:
        return found
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    fresh = found.join(roots.select("node"), "node", "left_anti")
    return materialise(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(fresh.select("node", "root")), "roots")


# What a confirming group gets, by kind: 0 a set it needs (a), 1 a class (a, of the component root) and those it may be linked with.
ASKS = "g long, kind int, a long, root long, bs array<long>, roots array<long>"


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), longs, longs)
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ASKS.split(", ")])


def _led(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """ASKS of pairs (a, leader b, root_a, root_b) that sizes and sketches don't rule out, at most about FAMILY in a group.

    The joins are between written tables, so that Spark can split a leader that a large share of the pairs name.
    """
    columns = ("a", "b", "root_a", "root_b", "n_a", "n_b", "m_a", "m_b", "salt")

    def look(batches):
        for batch in batches:
            a, b, root_a, root_b, n, m, x, y, salt = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns)
            bits = [batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS) for c in ("s_a", "s_b")]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64) if len(a) else np.zeros(0, np.int64)
            near = np.flatnonzero(may_link(differ, n, m, x + y, percent))
            g = _mix(b.view(np.uint64) * P + salt.astype(np.uint64)).view(np.int64)
            made = [(int(g[i]), 1, int(a[i]), int(root_a[i]), [int(b[i])], [int(root_b[i])]) for i in near]
            yield _asks(made + [(int(g[i]), 0, int(x), None, None, None) for i in near for x in (a[i], b[i])])

    pairs = materialise(pairs.distinct(), "pairs")
    many = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("salts")).where("salts > 1"), "families")
    salt = F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = materialise(pairs.hint("merge").join(many, "b", "left").select("a", "b", "root_a", "root_b", salt.alias("salt")), "pairs")
    for c in "ab":
        side = held.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("samples").alias(f"m_{c}"), F.col("sketch").alias(f"s_{c}"))
        salted = salted.hint("merge").join(side, c)
    return salted.select(*columns, "s_a", "s_b").mapInArrow(look, ASKS)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key together; ``batches`` come sorted by ``keys``."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not rows.num_rows:
            continue
        k = np.stack([rows[c].to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:]):
            yield rows.slice(i, j - i)
        held = rows.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def has_pair(a: int, b: np.ndarray) -> np.ndarray:
    """Whether class a, not b, asks for the pair where both ask: about half of the pairs of every class."""
    return (a < b) == (np.bitwise_count(a ^ b) % 2 == 1)


def _meet(dealt: DataFrame, low: int, high: int | None, percent: int) -> DataFrame:
    """ASKS of the classes that ask: those of other components that they may be linked with, ranked low to high.

    dealt: (band, block, chunk, home, asks, here, node, root, n, samples, sketch, bands): a block of the band's bucket, and the
    chunk of asking classes that meet its members (home). Those of the chunk have ``here``. Ranks go by differing bits, then
    node, among all that the class has in the block, so they are the same in every round; of two classes that ask, one has the
    pair (``has_pair``). A pair belongs to the first band that both have in common, and is made there only.
    """

    def asked(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of a class that asks, places of those it asks for, closest first)."""
        node, root, n, m, home, asks, here = (t[c].to_numpy() for c in ("node", "root", "n", "samples", "home", "asks", "here"))
        flat = lambda c, width: t[c].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        sketch, bands = flat("sketch", WORDS).view(np.uint64), flat("bands", BANDS)
        band = int(np.flatnonzero(bands[0] == t["band"][0].as_py())[0])
        for i in np.flatnonzero(here):
            has = np.flatnonzero(home & (node != node[i]) & (~asks | has_pair(node[i], node)))
            if len(has) <= low or (root[has] == root[i]).all():
                continue
            differ = np.bitwise_count(sketch[has] ^ sketch[i]).sum(1, dtype=np.int64)
            order = np.argsort(differ, kind="stable")[low:high]
            at, differ = has[order], differ[order]
            near = root[at] != root[i]
            near &= may_link(differ, n[at], n[i], m[at] + m[i], percent)
            near &= ~(bands[at, :band] == bands[i, :band]).any(1)
            if near.any():
                yield i, at[near]

    def meet(batches):
        for t in _groups(batches, ("band", "block", "chunk")):
            t = t.sort_by("node").combine_chunks()
            if t.num_rows < 2:
                continue
            node, root, n = (t[c].to_numpy() for c in ("node", "root", "n"))
            key = f"{t['band'][0]} {t['block'][0]} {t['chunk'][0]}"
            made: list[tuple] = []
            needs: set[int] = set()
            held = count = number = 0

            def close():
                nonlocal needs, held, count, number
                g = xxhash.xxh64_intdigest(f"{key} {number}") >> 1
                made.extend((g, 0, int(node[j]), None, None, None) for j in needs)
                needs, held, count, number = set(), 0, 0, number + 1
                return g

            rows: list[list] = []
            for i, at in asked(t):
                start = 0
                for end in range(1, len(at) + 1):
                    new = {int(i), int(at[end - 1])} - needs
                    needs |= new
                    held += int(n[list(new)].sum())
                    if held >= HELD or end == len(at):
                        rows.append([number, 1, int(node[i]), int(root[i]), node[at[start:end]], root[at[start:end]]])
                        start = end
                        count += 1
                    if held >= HELD or count >= ASKING:
                        g = close()
                        made.extend((g, *r[1:]) for r in rows)
                        rows = []
            if rows:
                g = close()
                made.extend((g, *r[1:]) for r in rows)
            if made:
                yield _asks(made)
        hand_back()

    return dealt.repartition("band", "block", "chunk").sortWithinPartitions("band", "block", "chunk").mapInArrow(meet, ASKS)


def _confirm(asks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between roots, on the full sets (node, shingles); a group gets a set once.

    Pairs of classes whose components a link has joined before within the group aren't looked at again.
    """

    def check(batches):
        group, held, up = None, {}, {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for batch in batches:
            found = []
            g, kind, a, root = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                if g[i] != group:
                    group, held, up = g[i], {}, {}
                if not kind[i]:
                    held.setdefault(a[i], []).append(batch.column(6)[i].values.to_numpy(zero_copy_only=False))
                    continue
                for b, b_root in zip(batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), strict=True):
                    x, y = top(root[i]), top(b_root)
                    if x != y and any(similar(s, t, percent) for s in held.get(a[i], ()) for t in held.get(b, ())):
                        found.append((root[i], b_root))
                        up[max(x, y)] = min(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
        group, held, up = None, {}, {}
        hand_back()

    need = asks.where("kind = 0").select("g", "kind", F.col("a").alias("node")).distinct()
    none = F.lit(None)
    longs = none.cast("array<long>")
    given = need.hint("merge").join(sets, "node").select("g", "kind", F.col("node").alias("a"), none.cast("long").alias("root"), longs.alias("bs"), longs.alias("roots"), "shingles")
    rows = given.unionByName(asks.where("kind = 1").withColumn("shingles", longs))
    return rows.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(check, "a long, b long")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    small, large = (s, t) if len(s) < len(t) else (t, s)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(s) + len(t) - both)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of each row (node, text): the set as signed numbers, in signed order."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = [np.sort(shingles(t.as_py(), size).view(np.int64)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "shingles"])
        hand_back()

    return texts.select("node", "text").mapInArrow(rows, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; an empty table gives no rows.

    Linked are rows with 100 * shared shingles >= ``percent`` * all shingles of both. Null and empty texts, and texts of white
    space, have empty sets and are linked with nothing; rows without doc_id keep a null component and stay. Rows that share
    a doc_id are one document, linked with whatever one of them is. Other columns are not looked at. At a similarity of 0.75
    the bands miss a pair with a chance of 5 in a million, and sketches with one of 3 in ten million.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(signatures(texts, size), "signatures")
    classes = signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n", "bands", "samples", "sketch"), "doc_id").alias("x"))
    classes = materialise(classes.select("key", "node", "x.*"), "classes")
    rows = classes.select("node", F.explode("bands").alias("band")).distinct()
    first = rows.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    buckets = materialise(rows.join(first, "band"), "buckets")
    nodes = buckets.select("node").distinct()
    held = materialise(classes.drop("key").hint("merge").join(nodes, "node"), "held")
    sets = materialise(shingle_sets(texts.hint("merge").join(nodes, texts.doc_id == nodes.node), size), "sets")

    def verify(asks: DataFrame) -> DataFrame:
        asks = materialise(asks, "asks")
        links = materialise(_confirm(asks, sets, percent), "links")
        forget(asks)
        return links

    def still_split(before: DataFrame, roots: DataFrame) -> DataFrame:
        """(band, node, root) of the buckets that still hold several components; a written list of them lets Spark split a hot one."""
        seen = before.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        split = seen.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        return materialise(seen.hint("merge").join(materialise(split.select("band"), "bands"), "band"), "split")

    def place(split: DataFrame) -> DataFrame:
        """(band, node, blocks, chunks, block, chunk, asks) and ``held`` of the buckets' classes; those outside the largest component ask."""
        parts = split.groupBy("band", "root").count().groupBy("band").agg(F.sum("count").alias("all"), F.max(F.struct("count", "root")).alias("m"))
        askers = F.col("all") - F.col("m.count")
        about = materialise(parts.select("band", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil(askers / VISITORS).cast("int").alias("chunks"), F.col("m.root").alias("main")), "about")
        part = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
        rows = split.hint("merge").join(about, "band").select("band", "node", "blocks", "chunks", part("blocks", 0).alias("block"), part("chunks", 1).alias("chunk"), (F.col("root") != F.col("main")).alias("asks"))
        placed = materialise(rows.hint("merge").join(held, "node"), "placed")
        forget(about)
        return placed

    def dealt(placed: DataFrame, split: DataFrame, away: bool) -> DataFrame:
        """Rows for ``_meet``: every class in its block, once for each chunk, and ``away`` those that ask in all other blocks."""
        rows = placed.hint("merge").join(split, ["band", "node"])
        same = lambda c: F.col("asks") & (F.col("chunk") == F.col(c))
        spread = lambda rows, c, values, home: rows.select("*", F.explode(values).alias("at")).withColumns({"here": same("at") if home else F.lit(True), "home": F.lit(home)}).drop(c).withColumnRenamed("at", c)
        home = rows.withColumns({"here": F.col("asks") & (F.col("chunk") == 0), "home": F.lit(True), "chunk": F.lit(0)})
        home = home.unionByName(spread(rows.where("chunks > 1"), "chunk", F.sequence(F.lit(1), F.col("chunks") - 1), True))
        if away:
            others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
            home = home.unionByName(spread(rows.where("asks"), "block", others, False))
        return home.drop("blocks", "chunks")

    led = buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("node").alias("root_a"), F.col("leader").alias("root_b"))
    roots = grown(None, verify(_led(led, held, percent)))
    split = still_split(buckets, roots)
    if split.head(1):
        last = materialise(split.groupBy("band").agg(F.max(F.struct("node", "root")).alias("l")), "last")
        pairs = split.hint("merge").join(last, "band").where("root <> l.root").select(F.col("node").alias("a"), F.col("l.node").alias("b"), F.col("root").alias("root_a"), F.col("l.root").alias("root_b"))
        roots = grown(roots, verify(_led(pairs, held, percent)))
        split = still_split(split, roots)
        placed = place(split)
        if placed.where("chunks > 1").head(1):
            roots = grown(roots, verify(_meet(dealt(placed, split, False), 0, FIRST, percent)))
            split = still_split(split, roots)
            forget(placed)
            placed = place(split)
        # fixed for both rounds: a bucket keeps its classes while it is split, and of each pair of different roots one class asks
        for low, high in ((0, FIRST), (FIRST, None)):
            roots = grown(roots, verify(_meet(dealt(placed, split, True), low, high, percent)))
            if high is not None:
                split = still_split(split, roots)
        forget(placed, last)
    forget(buckets, held, sets)
    named = classes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    # a root is the smallest of its nodes, and a node the smallest doc_id of its class
    out = signed.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
