"""Spelling variants by finite-state composition (operator 13).

The pairs of words that differ by one edit are the language of V . E . V: the minimised acceptor of the vocabulary composed
with a one-edit transducer and with the acceptor again. It is enumerated in partitions by the state that the composition
starts from: words that share a beginning of ``a`` letters and an ending of ``r`` start in one state and end alike, and what
lies between makes a partition's acceptor. A pair belongs to one partition only, by the place at which its words part.
A partition too large for a task is split by longer beginnings and endings, so any vocabulary comes down to small ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

SHORTEST, TIMES = 7, 2  # a word's least length and occurrences
FLAW, RATIO = 31, 10
PARTITION_LETTERS = 50_000  # of the words of one partition
ANY = 1 << 30
UPPER = {c: c + 32 for c in range(65, 91)}


def count_words(docs: DataFrame, shortest: int = SHORTEST, flaw: int = FLAW) -> DataFrame:
    """(word, n) of all texts: runs of letters, A-Z lower-cased, of at least ``shortest`` letters.

    Where ``flaw`` divides the crc32 of "<doc_id>:<run>", the run loses the letter that it names. Null doc_ids are written
    as nothing. Counts of a task are summed before they move.
    """
    run = re.compile(rf"[A-Za-zÀ-ÿ]{{{shortest},}}")

    def rows(batches):
        made: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(run.findall(text.as_py() or ""))
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in found.items():
                    word = word.lower() if word.isascii() else word.translate(UPPER)
                    h = zlib.crc32(word.encode(), begin)
                    if h % flaw == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    made[word] = made.get(word, 0) + n
                if len(made) > 400_000:
                    yield batch_of(made)
                    made = {}
        if made:
            yield batch_of(made)

    def batch_of(made):
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic automaton of sorted distinct strings; states are numbers, those that a state leads to come before it."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        # the states along the last word that may still grow: (final, edges), the letter to the next beside them
        path: list[list] = [[False, {}]]
        letters: list[str] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, *edges.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.final)
                    self.final.append(final)
                    self.edges.append(edges)
                path[-1][1][letters.pop()] = state

        last = ""
        for word in words:
            shared = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                shared += 1
            close(shared)
            for c in word[shared:]:
                letters.append(c)
                path.append([False, {}])
            path[-1][0] = True
            last = word
        close(0)
        self.start = len(self.final)
        self.final.append(path[0][0])
        self.edges.append(path[0][1])


class Composition:
    """Pairs of words of an acceptor that differ by one edit, which stands where they first differ."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.dead: set[tuple[int, int]] = set()
        self.live: set[tuple[int, int]] = set()
        self.ways: dict[int, list[tuple[str, int, str, int, str]]] = {}
        self.reach: dict[int, bool] = {}

    def common(self, p: int, q: int) -> bool:
        """Whether some string leads from both states to final ones."""
        if p == q:
            return True
        if (p, q) in self.dead:
            return False
        if (p, q) in self.live:
            return True
        final, edges = self.a.final, self.a.edges
        trail, todo = [(p, q)], [self._both(p, q, "")]
        found = final[p] and final[q]
        while todo and not found:
            for _, x, y in todo[-1]:
                if x == y or (x, y) in self.live or final[x] and final[y]:
                    found = True
                    break
                if (x, y) not in self.dead and edges[x] and edges[y]:
                    trail.append((x, y))
                    todo.append(self._both(x, y, ""))
                    break
                self.dead.add((x, y))
            else:
                todo.pop()
                self.dead.add(trail.pop())
        if found:
            self.live.update(trail)
        return found

    def _both(self, p: int, q: int, but: str) -> Iterator[tuple[str, int, int]]:
        x, y = self.a.edges[p], self.a.edges[q]
        return ((c, x[c], y[c]) for c in (x if len(x) <= len(y) else y) if c in x and c in y and c != but)

    def edits(self, s: int) -> list[tuple[str, int, str, int, str]]:
        """(letter, state, letter, state, letter not to go on with): how two words may part in state s and agree after that."""
        known = self.ways.get(s)
        if known is None:
            known, steps = [], list(self.a.edges[s].items())
            for i, (c, p) in enumerate(steps):
                known += [(c, p, d, q, "") for d, q in steps[i + 1 :] if self.common(p, q)]
                # one word has c where the other has nothing; were c the other's next letter too, they would part later
                if self.a.final[s] and self.a.final[p] or any(self.common(x, y) for _, x, y in self._both(s, p, c)):
                    known.append(("", s, c, p, c))
            self.ways[s] = known
        return known

    def fertile(self, s: int) -> bool:
        """Whether words part in s or beyond."""
        todo = [s]
        while todo:
            x = todo[-1]
            if x in self.reach:
                todo.pop()
                continue
            if self.edits(x):
                self.reach[x] = True
                todo.pop()
                continue
            after = list(self.a.edges[x].values())
            if any(self.reach.get(y) for y in after):
                self.reach[x] = True
                todo.pop()
            elif new := [y for y in after if y not in self.reach]:
                todo.append(new[0])
            else:
                self.reach[x] = False
                todo.pop()
        return self.reach[s]

    def endings(self, p: int, q: int, but: str) -> Iterator[str]:
        """All strings that lead from both states to final ones and don't begin with ``but``."""
        final, path = self.a.final, []
        if final[p] and final[q]:
            yield ""
        todo = [self._both(p, q, but)]
        while todo:
            step = next(((c, x, y) for c, x, y in todo[-1] if self.common(x, y)), None)
            if step is None:
                todo.pop()
                if path:
                    path.pop()
                continue
            c, x, y = step
            path.append(c)
            if final[x] and final[y]:
                yield "".join(path)
            todo.append(self._both(x, y, ""))

    def pairs(self, depth: int = ANY) -> Iterator[tuple[str, str]]:
        """(word, word) that part after fewer than ``depth`` letters; each pair once."""
        path, todo = [], [iter([("", self.a.start)])]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                if path:
                    path.pop()
                continue
            c, s = step
            path.append(c)
            if len(todo) > depth or not self.fertile(s):
                path.pop()
                continue
            if ways := self.edits(s):
                begun = "".join(path)
                for x, p, y, q, but in ways:
                    for end in self.endings(p, q, but):
                        yield begun + x + end, begun + y + end
            todo.append(iter(self.a.edges[s].items()))


def partition_pairs(words: list[str], begin: int, end: int, part: int = ANY, cap: int = ANY) -> Iterator[tuple[str, str]]:
    """One-edit pairs of distinct words that share ``begin`` first and ``end`` last letters.

    Only pairs that part before place ``part`` count, and of those only pairs whose shorter word is shorter than ``cap``.
    """
    if len(words) < 2:
        return
    first, last = words[0][:begin], words[0][len(words[0]) - end :]
    found = Composition(Acceptor(sorted(w[begin : len(w) - end] for w in words)))
    for x, y in found.pairs(part - begin):
        if min(len(x), len(y)) + begin + end < cap:
            yield first + x + last, first + y + last


# A partition's place: letters shared at both ends, the place before which its pairs part, the length below which their shorter word is.
PLACE = ("begin", "end", "part", "cap")


def _placed(words: DataFrame, begin, end, part, cap) -> DataFrame:
    """``words`` (word, n) with their partition; its key has what its words share."""
    held = words.withColumns({"begin": begin, "end": end, "part": part, "cap": cap})
    return held.withColumn("key", F.concat_ws(" ", *PLACE, F.left("word", "begin"), F.right("word", "end")))


def _rooted(words: DataFrame) -> DataFrame:
    """Each word twice: with the words that share its first three letters, and with those that share its last four.

    With seven letters or more, one edit leaves either alone; pairs of the second kind part within the first three.
    """
    whole = F.lit(ANY)
    return _placed(words, F.lit(3), F.lit(0), whole, whole).unionByName(_placed(words, F.lit(0), F.lit(4), F.lit(3), whole))


def _split(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The partitions that replace those of ``large`` (key, step).

    Words whose middle has 2 * step letters or more go on twice, with a longer beginning and with a longer ending, one of
    which an edit leaves alone. Shorter words keep the partition for pairs in which the shorter word is one of them.
    """
    rows = rows.hint("merge").join(large, "key")
    begin, end, part, step = (F.col(c) for c in ("begin", "end", "part", "step"))
    bound = begin + end + 2 * step
    long = rows.where(F.length("word") >= bound)
    on = _placed(long.where(begin + step < part), begin + step, end, part, F.col("cap"))
    back = _placed(long, begin, end + step, F.least(part, begin + step), F.col("cap"))
    rest = _placed(rows.where(F.col("shorter") & (F.length("word") <= bound)), begin, end, part, F.least("cap", bound))
    return on.unionByName(back).unionByName(rest).select("word", "n", *PLACE, "key")


def near_pairs(words: DataFrame, letters: int = PARTITION_LETTERS) -> DataFrame:
    """(word, other, n_other) for both words of each pair that differs by one inserted, deleted or replaced letter.

    words: (word, n), distinct, of seven letters or more; null words are left out. Partitions with more than ``letters``
    letters are split, round after round, until none is left or all have only words of up to two letters between what they
    share, which are few by the alphabet. A word of millions of letters is therefore no burden for one task either.
    """
    rows = materialise(_rooted(words.where(F.length("word") >= SHORTEST).select("word", "n")), "partitions")
    ready: list[DataFrame] = []
    while True:
        middle = F.length("word") - F.col("begin") - F.col("end")
        sums = rows.groupBy("key").agg(F.sum(middle).alias("letters"), F.count("*").alias("words"), F.max(middle).alias("most"), F.min(middle).alias("least"), F.percentile_approx(middle, F.lit(0.5)).alias("median"))
        step = F.greatest(F.lit(1), F.floor((F.col("median") - 1) / 2)).cast("int")
        large = sums.where((F.col("letters") > letters) & (F.col("words") > 1) & (F.col("most") > 2)).select("key", step.alias("step"), (F.col("least") < 2 * step).alias("shorter"))
        large = materialise(large, "large")
        if not large.head(1):
            ready.append(rows)
            break
        ready.append(rows.hint("merge").join(large.select("key"), "key", "left_anti"))
        rows = materialise(_split(rows, large), "partitions")
    whole = ready[0]
    for x in ready[1:]:
        whole = whole.unionByName(x)

    def enumerate_(batches):
        out: list[tuple] = []
        for begin, end, part, cap, held in _partitions(batches):
            for x, y in partition_pairs(list(held), begin, end, part, cap):
                out += [(x, y, held[y]), (y, x, held[x])]
                if len(out) > 50_000:
                    yield _pairs_batch(out)
                    out = []
        if out:
            yield _pairs_batch(out)

    dealt = whole.select("key", *PLACE, "word", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(enumerate_, "word string, other string, n_other long")


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, dict[str, int]]]:
    """The words of each partition with their n; ``batches`` come sorted by key."""
    now, place, held = None, (0, 0, 0, 0), {}
    for batch in batches:
        for key, *at, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if len(held) > 1:
                    yield *place, held
                now, place, held = key, at, {}
            held[word] = n
    if len(held) > 1:
        yield *place, held


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], ["word", "other", "n_other"])


def spelling_groups(docs: DataFrame, least: int = TIMES, ratio: int = RATIO, letters: int = PARTITION_LETTERS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs ``least`` times.

    A word's form is its most frequent near word (of equals the first by code points), if that is at least ``ratio`` times as
    frequent; its root is where forms lead in the end. Null and empty texts have no words, a null doc_id is written as
    nothing, rows that repeat count each, and other columns are not looked at. An empty table gives no rows. A chain of forms
    has a step for each factor ``ratio`` at most, as counts grow by it.
    """
    words = materialise(count_words(docs).where(F.col("n") >= least), "words")
    near = near_pairs(words, letters).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("top"))
    good = -F.col("top.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("top.other")).alias("form"), F.when(good, -F.col("top.less")).alias("form_n"),
    )
    found = materialise(found, "forms")
    steps = materialise(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each pass doubles the steps that a root lies away
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialise(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(steps)
        steps = jumped.select("word", "root")
        if not jumped.where("moved").head(1):
            break
    return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
