"""Toxicity by noisy-channel deobfuscation (operator 5).

A lexicon of words and stems that mark toxic documents, and a character language model, are learned from labelled rows.
Odd tokens (digits or signs for letters, spaced or dotted letters, letters that repeat) become lattices of what they may
stand for; the best path under the channel's costs and the language model is the restored text. Its words are scored by the
lexicon, and a logistic curve over a document's hits gives the score. Workers keep the weights of tokens they have met. Lexicon,
spelling and curve come from every labelled row: counts are shuffled sums, and the curve's steps are sums over all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, hand_back, labelled, materialise
from .neardup import shingles

# Letters that a digit or sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "£": "l"}
SEPARATORS = "-_.*~'’·"
EDGE = ".,;:?!\"()[]{}<>#%&*$|`'’“”«»…-_~/\\"
COST = {"stand": 0.8, "skip": 0.4, "again": 0.05, "mask": 2.0, "star": 1.2, "once": 0.3, "twice": 0.9}  # channel costs in nats
SHORTEST, LONGEST = 4, 9  # lengths of stems
LEAST = 5  # toxic documents that a feature must come from
UNIT = 1 << 20  # a document's vote; whole numbers, so that sums come out alike in any order
HELD = 100_000  # words or features that a counting task remembers
SECOND = np.uint64(0x9E3779B97F4A7C15)  # makes another hash of a hash
# A letter is what is no separator, or a separator that stands alone. Each place then reads in one way, and a run of four letters
# or more always ends somewhere, so nothing is tried twice. One that ends within a token is cut back to the last token's end.
_LETTER = r"(?:[^\s.*_-]|(?<=\s)[.*_-](?=\s))"
_LETTERS = rf"(?:{_LETTER}[\s.*_-]{{1,2}}){{3,}}{_LETTER}"
RUN, ENDED = re.compile(rf"(?:(?<=\s)|^){_LETTERS}(?=[\s.,!?*_-]|$)"), re.compile(rf"{_LETTERS}(?=[\s.,!?])")
ODD = re.compile(r"[0-9@$!|+€£(*]|(.)\1\1|[^\W_][-_.*~'’·][^\W_]")
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[-_.*~'’·,;:?/\\&=#%\"]+")
_MEANT = "[" + re.escape("".join(STANDS_FOR)) + "]"
LETTERS, MEANT = re.compile(r"([^\W\d_])\1{3,}"), re.compile(rf"({_MEANT})\1{{4,}}")
PARTING, STARS = re.compile(rf"(?!{_MEANT})([^\w*]|_)\1+"), re.compile(r"\*{41,}")
INSIDE = 5  # letters of the shortest word that counts within a token
STEP = 64  # between the overlapping windows in which spelled-out text is read
MASKED = 4  # letters of the shortest word that stars may mask


def plain_words(text: str) -> set[str]:
    """The distinct lower-case words of letters alone, of 2 letters or more."""
    return {w for w in WORD.findall(text.lower()) if len(w) > 1}


def runs(text: str) -> set[str]:
    """Letters written apart, four or more in a row."""
    found = set()
    for m in RUN.finditer(text):
        if text[m.end() : m.end() + 1] in ("*", "_", "-"):
            m = ENDED.match(m[0])
        if m:
            found.add(m[0])
    return found


def squeeze(token: str) -> str:
    """The lower-cased token with long repetitions shortened: letters and parting signs to what the lattice reads alike, signs
    that stand for letters to four and stars to 41, as no word has more of one sign's letters in a row, or is longer."""
    return STARS.sub("*" * 41, PARTING.sub(r"\1", MEANT.sub(r"\1\1\1\1", LETTERS.sub(r"\1\1\1", token.lower()))))


def features(word: str) -> list[str]:
    """The word itself, marked by a closing blank, and its stems."""
    return [word + " ", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def grams(words: Iterable[tuple[str, float]], found: dict[str, float] | None = None) -> dict[str, float]:
    """Counts of one to four letters in a row, of words (word, count) with their ends marked, added to ``found``."""
    found = {} if found is None else found
    for word, n in words:
        padded = f"^^^{word}$"
        for i in range(3, len(padded)):
            for k in range(4):
                gram = padded[i - k : i + 1]
                found[gram] = found.get(gram, 0) + n
    return found


@dataclass
class CharModel:
    """Interpolated counts of up to four letters in words; ``log(context, letter)`` in nats."""

    counts: dict[str, float] = field(default_factory=dict)
    totals: dict[str, float] = field(default_factory=dict)
    letters: str = ""
    memo: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)  # of each letter, the highest log probability in any context

    @classmethod
    def of(cls, words: dict[str, float]) -> CharModel:
        return cls.of_grams(grams(words.items()))

    @classmethod
    def of_grams(cls, counts: dict[str, float]) -> CharModel:
        self = cls(counts)
        for gram, n in counts.items():
            self.totals[gram[:-1]] = self.totals.get(gram[:-1], 0.0) + n
        self.letters = "".join(sorted(g for g in counts if len(g) == 1 and g != "$"))
        p: dict[str, float] = {}
        for gram in sorted(self.counts, key=len):  # a letter never seen after a context is less likely there than after a shorter one
            less = p[gram[1:]] if len(gram) > 1 else 1.0 / (len(self.letters) + 2)
            p[gram] = (self.counts[gram] + 3.0 * less) / (self.totals[gram[:-1]] + 3.0)
            self.most[gram[-1]] = max(self.most.get(gram[-1], -math.inf), math.log(p[gram]))
        return self

    def log(self, context: str, letter: str) -> float:
        known = self.memo.get(context + letter)
        if known is not None:
            return known
        p = 1.0 / (len(self.letters) + 2)
        for k in range(4):
            c = context[3 - k :]
            total = self.totals.get(c, 0.0)
            if total:
                p = (self.counts.get(c + letter, 0.0) + 3.0 * p) / (total + 3.0)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[context + letter] = math.log(p)
        return self.memo[context + letter]


def lattice(token: str, letters: str) -> list[list[tuple[str, float]]]:
    """For each place of the token what it may stand for, with its cost. Equal letters in a row are one place, and each sign is one."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        if c.isalpha():
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            out.append([(c, 0.0)] if n == 1 else [(c, COST["once"] if n > 2 else 2.0), (c + c, COST["twice"] if n > 2 else 0.0)])
        else:
            again = i > 0 and token[i - 1] == c
            ways = [(x, COST["stand"]) for x in STANDS_FOR.get(c, "")]
            if c == "*":  # within a word it masks a letter more often than it parts two
                ways = [("", COST["star"]), *((x, COST["mask"]) for x in letters)]
            elif c in SEPARATORS or c.isspace() or not ways:
                ways.append(("", 0.0 if again else COST["skip"]))
            elif again:
                ways.append(("", COST["again"]))
            out.append(ways)
        i = j
    return out


def _cheapest(places: list[list[tuple[str, float]]], model: CharModel, width: int | None, limit: float) -> tuple[float, str, bool]:
    """(cost, text, whether states were left out) of the best path of at most ``limit``; states are the last three letters.

    With a ``width`` only so many states are kept. Without, states go only where the cheapest way on would pass the limit.
    """
    rest = [-model.most.get("$", 0.0)]
    for ways in reversed(places):
        rest.append(rest[-1] + min(price - sum(model.most.get(x, 0.0) for x in letters) for letters, price in ways))
    rest = rest[::-1][1:]
    best: dict[str, tuple[float, str]] = {"^^^": (0.0, "")}
    cut = False
    for ways, on in zip(places, rest, strict=True):
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for letters, price in ways:
                c, s = cost + price, state
                for x in letters:
                    c -= model.log(s, x)
                    s = s[1:] + x
                if c + on <= limit and (s not in after or c < after[s][0]):
                    after[s] = (c, text + letters)
        best = after
        if width and len(best) > width:
            best, cut = dict(sorted(after.items(), key=lambda kv: kv[1])[:width]), True
    cost, text = min(((c - model.log(s, "$"), t) for s, (c, t) in best.items()), default=(0.0, ""))
    return cost, text, cut


def restore(token: str, model: CharModel) -> str:
    """The most likely word behind a token: Viterbi over the lattice.

    A first pass keeps 64 states. Where that left any out, its cost is the limit of a second one that keeps all states but
    those that can't come in below it (costs only grow, at least by each letter's likeliest), so the path is the best.
    """
    places = lattice(token.lower(), model.letters)
    cost, text, cut = _cheapest(places, model, 64, math.inf)
    return _cheapest(places, model, None, cost + 1e-9)[1] if cut else text


@dataclass
class ToxicModel:
    weights: dict[str, float]
    chars: CharModel
    curve: list[float]  # of (strongest hit, log of summed distinct hits, log of hits a word, 1)


class Reader:
    """Weights of a text's tokens, with a cache of up to ``most`` tokens."""

    def __init__(self, model: ToxicModel, most: int = 150_000):
        self.model, self.most, self.cache = model, most, {}
        self.longest = max((len(f) - 1 for f in model.weights if f.endswith(" ")), default=0)
        self.window = STEP + max(STEP, 5 * self.longest)  # squeezed, a letter and its separators are five characters at most
        self.by_size: dict[tuple[int, str], list[tuple[str, float]]] = {}
        for f, w in model.weights.items():
            if f.endswith(" ") and len(f) > MASKED:
                self.by_size.setdefault((len(f) - 1, f[0]), []).append((f[:-1], w))

    def word(self, word: str) -> float:
        return max((self.model.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def token(self, token: str) -> float:
        core = token.strip(EDGE).lower()
        if core.isalpha() and not ODD.search(core):
            return self.word(core)
        best = max((self.word(w) for w in WORD.findall(token.lower())), default=0.0)
        if ODD.search(token):
            short = squeeze(token)
            for t in {short, short.strip(EDGE), *(x for x in PART.split(short) if ODD.search(x))}:
                if any(c.isalpha() for c in t):
                    best = max(best, self.odd(t), self.masked(t))
        return best

    def odd(self, token: str) -> float:
        """The word behind a token, stems that it begins with, and words of INSIDE letters or more that stand anywhere within."""
        best = 0.0
        for at in range(0, max(1, len(token) - self.window + STEP), STEP):
            text = restore(token[at : at + self.window], self.model.chars)
            if not at:
                best = self.word(text) if len(token) <= self.window else max((self.model.weights.get(f, 0.0) for f in features(text)[1:]), default=0.0)
            inside = {text[i : i + n] + " " for i in range(len(text) - INSIDE + 1) for n in range(INSIDE, min(self.longest, len(text) - i) + 1)}
            best = max(best, *(self.model.weights.get(f, 0.0) for f in inside), 0.0)
        return best

    def masked(self, token: str) -> float:
        """The weightiest word of the lexicon that has the token's letters in their places and something else under its stars."""
        if "*" not in token or sum(c.isalpha() for c in token) < 2:
            return 0.0
        fits = lambda word: all(c in ("*", x) for c, x in zip(token, word, strict=True))
        return max((w for word, w in self.by_size.get((len(token), token[0]), ()) if fits(word)), default=0.0)

    def spaced(self, run: str) -> float:
        """Letters written apart."""
        return self.spelled("".join(run.split()))

    def spelled(self, letters: str) -> float:
        """Letters without word boundaries: restored in windows, then every word or stem that begins within counts."""
        letters = squeeze(letters)
        best, seen = 0.0, set()
        for at in range(0, len(letters), STEP):
            text = restore(letters[at : at + self.window], self.model.chars)
            for i in range(len(text) - 2):
                seen.update(text[i : i + n] + " " for n in range(3, self.longest + 1))
                seen.update(text[i : i + n] for n in range(SHORTEST, LONGEST + 1))
        for w in seen:
            best = max(best, self.model.weights.get(w, 0.0))
        return best

    def hits(self, text: str) -> tuple[float, float, float]:
        """(strongest weight, summed weights of distinct hits, share of tokens that hit)."""
        tokens = text.split()
        distinct = set(tokens)
        new = distinct.difference(self.cache)
        if new:
            if len(self.cache) > self.most:
                self.cache.clear()
                new = distinct
            for t in new:
                self.cache[t] = self.token(t)
        hit = [w for w in map(self.cache.__getitem__, distinct) if w]
        apart = runs(text) if any(len(t) == 1 for t in distinct) or "." in text else ()
        hit += [w for w in map(self.spaced, apart) if w]
        return max(hit, default=0.0), sum(hit), len(hit) / max(1, len(tokens))


def _curve_inputs(strong: float, total: float, share: float) -> list[float]:
    return [strong, math.log1p(total), math.log1p(100 * share), 1.0]


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, w) of every labelled document that has text; w is in units of 1 / UNIT.

    None is left out, but equal or nearly equal documents (one label, and the same smallest hash of five words, under either
    of two hashes) share one vote, so that a text that is copied often teaches no more than once.
    """

    def sign(batches):
        for batch in batches:
            if batch.num_rows:
                sets = [shingles(t.as_py()) for t in batch.column(1)]
                signs = [(int(h[0]), int((h * SECOND).min())) if len(h) else (0, 0) for h in sets]
                made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*signs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "s1", "s2"])

    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = texts.mapInArrow(sign, "doc_id long, s1 long, s2 long").join(labelled(docs, labels, "toxic"), "doc_id")
    signed = materialise(signed, "signed")
    for c in ("s1", "s2"):  # the lists of those that repeat are written, so that Spark can split a hot one
        sizes = materialise(signed.groupBy("label", c).agg(F.count("*").alias(f"n_{c}")).where(f"n_{c} > 1"), "sizes")
        signed = signed.join(sizes, ["label", c], "left")
    share = F.expr(f"{UNIT} DIV greatest(coalesce(n_s1, 1), coalesce(n_s2, 1), 1)")
    return materialise(signed.groupBy("doc_id", "label").agg(F.greatest(F.min(share), F.lit(1)).alias("w")), "named")


def counted(rows: DataFrame) -> DataFrame:
    """(f, h, n) of every feature of the rows (w, words): its hash, and the votes of the documents that have it."""

    def count(batches):
        found: dict[str, int] = {}
        known: dict[str, list[str]] = {}

        def made():
            hashes = pa.array([xxhash.xxh64_intdigest(f) >> 1 for f in found], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), hashes, pa.array(list(found.values()), pa.int64())], ["f", "h", "n"])

        for batch in batches:
            for w, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words.split()
                for word in words:
                    if word not in known:
                        known[word] = features(word)
                for f in set().union(*(known[x] for x in words)):
                    found[f] = found.get(f, 0) + w
                if len(found) > HELD:
                    yield made()
                    found = {}
                if len(known) > HELD:
                    known.clear()
        yield made()

    return rows.select("w", "words").mapInArrow(count, "f string, h long, n long").groupBy("f", "h").agg(F.sum("n").alias("n"))


def counted_of(rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(h, m) of the features whose hashes are given, sorted: the votes of the documents (w, words) that have them."""
    sent = rows.sparkSession.sparkContext.broadcast(hashes)  # a number for each feature that LEAST toxic documents share

    def count(batches):
        hashes = sent.value
        votes = np.zeros(len(hashes), np.int64)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for w, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words.split()
                new = [x for x in words if x not in known]
                if new:
                    made = [features(x) for x in new]
                    h = np.array([xxhash.xxh64_intdigest(f) >> 1 for fs in made for f in fs], np.int64)
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    at = iter(np.where(hashes[at] == h, at, -1).tolist())
                    for x, fs in zip(new, made, strict=True):
                        known[x] = [i for i in (next(at) for _ in fs) if i >= 0]
                has = set().union(*(known[x] for x in words))
                votes[np.fromiter(has, np.int64, len(has))] += w
                if len(known) > HELD:
                    known.clear()
        some = np.flatnonzero(votes)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(votes[some])], ["h", "m"])
        hand_back()

    return rows.select("w", "words").mapInArrow(count, "h long, m long").groupBy("h").agg(F.sum("m").alias("m"))


def counted_grams(words: DataFrame) -> dict[str, float]:
    """``grams`` of a table of features and their votes: of all words among them, each by its votes."""

    def count(batches):
        found: dict[str, int] = {}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["g", "n"])
        for batch in batches:
            grams(((f[:-1], n) for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), found)
            if len(found) > HELD:
                yield made()
                found = {}
        yield made()
        hand_back()

    counts = words.where("f LIKE '% '").select("f", "n").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: r["n"] / UNIT for r in counts.collect()}  # as many as there are ways to put four letters in a row


def train(docs: DataFrame, named: DataFrame) -> ToxicModel | None:
    """The lexicon and the language model, from all documents in ``named`` (``weighed``); the curve is ``fit_curve``'s.

    Candidates are all features with the votes of LEAST toxic documents or more; those that are surely more common there (by
    2.3 deviations), and twelve times as common as in clean documents, make the lexicon. The language model learns from all
    words of all toxic documents, each by its votes. None without rows of both kinds.
    """
    votes = {r["label"]: r["n"] / UNIT for r in named.groupBy("label").agg(F.sum("w").alias("n")).collect()}
    if len(votes) < 2:
        return None

    def read(batches):
        for batch in batches:
            words = pa.array([" ".join(plain_words(t.as_py())) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), words], ["doc_id", "words"])
        hand_back()

    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = texts.mapInArrow(read, "doc_id long, words string")  # a document's distinct words move to its label, not its text
    learned = materialise(words.hint("merge").join(named, "doc_id").select("label", "w", "words"), "learned")
    found = materialise(counted(learned.where("label = 1")), "features")
    chars = CharModel.of_grams(counted_grams(found))
    toxic = found.where(F.col("n") >= LEAST * UNIT)
    hashes = np.unique(np.array([r["h"] for r in toxic.select("h").collect()], np.int64))
    if len(hashes):
        clean = counted_of(learned.where("label = 0"), hashes)
        c, m = F.col("n") / UNIT, F.coalesce("m", F.lit(0)) / UNIT
        ratio = F.log((c + 0.5) / (votes[1] + 1) / ((m + 0.5) / (votes[0] + 1)))
        deviation = F.sqrt(1 / c + 1 / (m + 0.5))
        rated = toxic.join(clean, "h", "left").select("f", ratio.alias("ratio"), deviation.alias("deviation"))
        kept = rated.where((F.col("ratio") >= math.log(12)) & (F.col("ratio") >= 2.3 * F.col("deviation")))
        weights = {r["f"]: r["w"] for r in kept.select("f", (F.col("ratio") - F.col("deviation")).alias("w")).orderBy("f").collect()}
    else:
        weights = {}
    forget(learned, found)
    return ToxicModel(weights, chars, [0.0] * 4)


def read_hits(docs: DataFrame, model: ToxicModel, columns: list[str]) -> DataFrame:
    """``columns`` of every row and the inputs of the curve, a, b and c; they are null for null texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as long as the lexicon and the counts of letters in a row
    at = columns.index("text") if "text" in columns else len(columns)
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def rows(batches):
        reader = Reader(sent.value)
        for batch in batches:
            x = [_curve_inputs(*reader.hits(t.as_py()))[:3] if t.is_valid else (None,) * 3 for t in batch.column(at)]
            made = [pa.array([r[i] for r in x], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *made], [*columns, "hit_a", "hit_b", "hit_c"])
        hand_back()

    fields = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in columns)
    return given.mapInArrow(rows, f"{fields}, hit_a double, hit_b double, hit_c double")


def fit_curve(hits: DataFrame, named: DataFrame) -> list[float]:
    """The logistic curve by Newton's method on all labelled rows: each step is one sum over the table of distinct inputs."""
    joined = hits.where("hit_a IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "hit_a", "hit_b", "hit_c").join(named, "doc_id")
    inputs = materialise(joined.groupBy("label", "hit_a", "hit_b", "hit_c").agg(F.sum("w").alias("w")), "inputs")
    b = np.zeros(4)
    for _ in range(100):
        at = b.copy()

        def sums(batches, at=at):
            hess, grad = np.zeros((4, 4)), np.zeros(4)
            for batch in batches:
                y, *x, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(5))
                x, w = np.stack([*x, np.ones(len(y))], 1), w / UNIT
                p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
                hess += (x * (w * p * (1 - p))[:, None]).T @ x
                grad += x.T @ (w * (y - p))
            yield pa.RecordBatch.from_arrays([pa.array([[*hess.ravel(), *grad]], pa.list_(pa.float64()))], ["s"])

        total = np.sum([r["s"] for r in inputs.mapInArrow(sums, "s array<double>").collect()], 0)  # twenty numbers a task
        step = np.linalg.solve(total[:16].reshape(4, 4) + 0.05 * np.eye(4), total[16:] - 0.05 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame | None:
    """``columns``, doc_id among them, of every row and its score. None where ``labels`` of both kinds are missing.

    Each text is read once under the lexicon; the curve is fitted on what was read of the labelled ones. Null and empty texts
    are scored as texts without hits.
    """
    named = weighed(docs, labels)
    model = train(docs, named)
    if model is None:
        return None
    hits = materialise(read_hits(docs, model, columns), "hits")
    model.curve = fit_curve(hits, named)
    x = [F.coalesce(c, F.lit(0.0)) for c in ("hit_a", "hit_b", "hit_c")]
    at = sum((v * k for v, k in zip(x, model.curve)), F.lit(model.curve[3]))
    return hits.select(*columns, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))).alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; whole texts. Held-out folds teach nothing.

    Null and empty texts are scored as texts without hits. A row without doc_id belongs to fold 0 and has no label. Rows that
    repeat are scored alike; labels that repeat and disagree count as toxic, and rows of one doc_id share them. Without
    labels of both kinds every score is 0.5. Other columns are not looked at; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(docs, labels.where(fold(F.col("doc_id"), modulus) != held), ["doc_id"])
    if rows is None:
        rows = docs.select("doc_id", F.lit(0.5).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
