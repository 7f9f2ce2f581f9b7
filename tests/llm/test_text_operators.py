"""Operators 1 to 6 and 10 against brute force, on small tables with nulls, empty texts, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from lectern.llm import binplan, bpe, chat, langid, neardup, packing, quality, toxicity, vocab  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `group` string"


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i), "s", 0, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, " ", "Hello  world\n\n done ", "it's <|endoftext|> here", "Σίσυφος İstanbul 한글 🙂 é é", "a\x1cb c d", "x" * 5000, "word " * 6000, "﻿WEB　x", "1234567 $%&*() don't", "Hello  world\n\n done "]


def hf(name):
    return tokenizers.Tokenizer.from_file(vocab.default_path(name))


def test_word_encoder_equals_the_tokenizer():
    fast, slow = vocab.WordEncoder(vocab.default_path("word_bpe_49k.json")), hf("word_bpe_49k.json")
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcdeéßΣİ019 '-.,!\n\t한🙂<|>") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, t[:80]


def test_plan_is_optimal_on_small_cases():
    def fewest(items, room):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
            go(i + 1, [*bins, room - items[i]])

        go(0, [])
        return best[0]

    rng = random.Random(5)
    for _ in range(60):
        room = rng.choice([20, 30, 50])
        items = sorted((rng.randint(1, room) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = binplan.plan_bins(Counter(items), room)
        assert Counter(x for p, n in plan for x in p for _ in range(n)) == Counter(items)
        assert all(sum(p) <= room for p, _ in plan) and sum(n for _, n in plan) == fewest(items, room)


def test_packing(spark):
    rows = packing.pack_documents(table(spark, ODD)).collect()
    slow, by = hf("word_bpe_49k.json"), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(ODD):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
        assert sum(r.length for r in by[i]) == len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(p[-1]) <= 4096
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_bpe_round_trip(spark):
    shared = "A passage that many documents hold, word for word, again and again. " * 40
    texts = ODD + [f"{i} intro {shared} outro {i}" for i in range(6)] + [shared, shared]
    slow = hf("byte_bpe_50k.json")
    got = bpe.bpe_decode(bpe.bpe_encode(table(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.ids) == slow.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.text == slow.decode(list(r.ids), skip_special_tokens=False)
    assert bpe.bpe_encode(table(spark, [])).count() == 0


def test_joins_are_repaired_anywhere():
    enc, rng = vocab.ByteEncoder(vocab.default_path("byte_bpe_50k.json")), random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "ing", "é", "  ", "\n", "x", " y", "<|endoftext|>", "don't", "12", "🙂"]) for _ in range(rng.randint(1, 40)))
        data, at, runs = text.encode(), 0, []
        while at < len(data):
            end = min(len(data), at + rng.randint(1, 30))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            runs.append((at, end, bpe.array("H", enc.encode(data[at:end].decode()))))
            at = end
        assert bpe.join_runs(enc, data, runs).tolist() == enc.encode(text)


def brute_groups(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, "  \n", "a b", "A  b", "one two three four five", "One two\tthree four FIVE"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    sizes, roots = brute_groups(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (i == roots[i]) for i in got)


def test_no_link_is_lost_when_the_largest_component_changes(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: {f"w{rng.getrandbits(60):x}" for _ in range(n)}
    swap = lambda s, n, among=None: s - (gone := set(rng.sample(sorted(among or s), n))) | fresh(len(gone))
    middle = fresh(200)
    a = swap(middle, 27)
    b = swap(a, 27, a & middle)  # linked with a only; a is linked with the middle of the first largest component
    sets = [middle, *(swap(middle, 20) for _ in range(10)), a, b, *(swap(b, 3, a & b) for _ in range(40)), *(fresh(200) for _ in range(100))]
    roots = list(range(len(sets)))
    for _ in sets:
        for i, j in combinations(range(len(sets)), 2):
            if len(sets[i] & sets[j]) * 100 >= 75 * len(sets[i] | sets[j]):
                roots[i] = roots[j] = min(roots[i], roots[j])
        if roots[52] == 0:
            break
    assert roots == [0] * 53 + list(range(53, 153)) and not any(len(a & s) * 100 >= 75 * len(a | s) for s in sets[13:])
    signatures = neardup.signatures
    one_bucket = lambda docs, size: signatures(docs, size).withColumn("bands", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(i == 0, F.lit(7)).otherwise(F.xxhash64("doc_id", i))))
    monkeypatch.setattr(neardup, "signatures", one_bucket)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, [" ".join(sorted(s)) for s in sets]), size=1).collect()}
    assert [got[i] for i in range(len(sets))] == roots


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in neardup.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    fresh = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64)
    for size in (40, 500, 3000, 20_000):
        for share in (0.8, 0.9, 0.96):
            a = fresh(size)
            b = np.unique(np.concatenate([a[: int(size * share)], fresh(size - int(size * share))]))
            a = np.unique(a)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            (m, x), (n, y) = neardup.sketch(a), neardup.sketch(b)
            differ = np.array([np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum()])
            union = np.array([len(np.union1d(a, b))])
            room = 0.75 - neardup.least_similarity(union, 75)[0]
            assert abs(neardup.estimate(differ, np.array([m + n]), union)[0] - true) < room


def test_toxicity_learns_and_sees_through_disguise(spark):
    rng = random.Random(4)
    plain = ["river", "stone", "garden", "window", "yellow", "market", "letter", "bridge", "summer", "kettle"]
    bad = ["grumbot", "snorkwad"]
    texts = [" ".join(rng.choice(plain) + str(rng.randint(0, 3)) * (rng.random() < 0.05) if k % 9 or i % 4 else rng.choice(bad) for k in range(40)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    hidden = ["a gr0mb0t", "you gr.u.m.b.o.t there", "you grummmmbot", "s n o r k w a d", "", None, "a calm river and a stone"]
    texts += [h.replace("gr0mb0t", "grumb0t") if h else h for h in hidden]
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(spark, texts), labels).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(240)) >= 238
    assert [got[240 + k].predicted for k in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.score_toxicity(table(spark, ["x", None]), labels.where("doc_id < 0")).collect()
    assert [r.score for r in none] == [0.5, 0.5]


def test_long_odd_tokens_are_decoded():
    words = ["river", "stone", "garden", "window", "yellow", "market", "letter", "bridge", "summer", "kettle", "grumbot", "snorkwad"]
    model = toxicity.ToxicModel({"grumbot ": 5.0, "snorkwad ": 4.0}, toxicity.CharModel.of(dict.fromkeys(words, 50.0)), [0.0] * 4)
    reader = toxicity.Reader(model)
    for size in (40, 41, 10_000):
        fill = lambda n, x: (x * (n // len(x) + 1))[:n]
        assert reader.hits("snorkw" + "a" * (size - 7) + "d")[0] == 4.0
        assert reader.hits("grumb0t" + fill(size - 7, "-river-stone-garden"))[0] == 5.0
        assert reader.hits(fill(size - 8, "river-stone-garden-") + "-grumb0t")[0] == 5.0
        assert reader.hits(fill(size, "river-st0ne-garden-"))[0] == 0.0
    assert reader.hits("riverst0ne" * 8 + "grumb0t" + "gardenwind0w" * 8)[0] == 5.0  # text without spaces
    assert reader.hits("-".join("riverstonegardengrumbotletter"))[0] == 5.0
    assert reader.hits("_".join("river" * 400 + "snorkwad"))[0] == 4.0
    for t in ("aaaaaa", "b__________b", "1111x--", "$$$$", "...", "x***y"):
        assert toxicity.restore(toxicity.squeeze(t), model.chars) == toxicity.restore(t, model.chars)


def test_spaced_stems_and_long_words():
    words = ["river", "stone", "garden", "snorkwaddle", "grumbotificationary"]
    model = toxicity.ToxicModel({"snor": 3.0, "grumbotificationary ": 5.0}, toxicity.CharModel.of(dict.fromkeys(words, 50.0)), [0.0] * 4)
    reader = toxicity.Reader(model)
    assert reader.hits("a " + " ".join("snorkwaddle"))[0] == 3.0
    for lead in range(0, 100, 9):
        assert reader.hits(" ".join(("river" * 20)[:lead] + "grumbotificationary"))[0] == 5.0
    assert reader.hits(" ".join("riverstonegarden"))[0] == 0.0


def test_language_and_rejection(spark):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "und", "er", "ich"]}
    make = lambda x: " ".join("".join(rng.choice(sounds[x]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    langs = {i: ("aa", "bb")[i % 2] for i in range(80)}
    texts = [make(langs[i]) for i in range(80)] + ["", None, "12 34 !!", "zqx wvj qqz xxw jvz " * 20]
    got = {r.doc_id: r for r in langid.predict_language(table(spark, texts, langs)).collect()}
    assert all(got[i].lang_pred == langs[i] and not got[i].rejected for i in range(80))
    assert [got[80 + k].lang_pred for k in range(3)] == ["und"] * 3 and all(got[80 + k].rejected for k in range(3)) and got[83].cross_entropy > 2 * got[0].cross_entropy
    assert langid.predict_language(table(spark, ["abc"])).first().lang_pred == "und"


def test_models_prefer_their_own_words():
    counts = {"aa": Counter(), "bb": Counter()}
    for lang, words in (("aa", ["abba", "baba", "ab"]), ("bb", ["bbb", "bab"])):
        for w in words:
            padded = langid.END * 3 + w + langid.END
            counts[lang].update(padded[i : i + 4] for i in range(len(padded) - 3))
    m = langid.fit_models(counts)
    base = {w: m.words([w])[0] for w in ("a", "ab", "abb")}
    assert all(v[:2].max() < 0 for v in base.values())
    assert m.words(["abba"])[0][0] > m.words(["abba"])[0][1]


def test_quality_separates_by_covariance(spark):
    rng = random.Random(8)
    good = lambda: ". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(12)).capitalize() for _ in range(6)) + "."
    junk = lambda: " ".join(rng.choice(["BUY", "NOW", "FREE"]) + "!!" for _ in range(90))
    texts = [good() if i % 3 else junk() for i in range(180)] + ["", None]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(180)] + [(3, None), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(table(spark, texts), labels).collect()}
    assert sum(got[i].predicted == (i % 3 > 0) for i in range(180)) >= 176
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 182
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}
    assert all(got[i].held_out == held[i] for i in got)
    assert {r.score for r in quality.score_quality(table(spark, ["a"]), labels.where("quality = 1")).collect()} == {0.5}


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "Bye"), (2, 0, "system", "alone"), (None, 1, "x", "y"), (1, 1, "ann", "Hi <|im_end|>")]
    made = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.where("conv_id = 1").collect()
    assert {r.perspective for r in got} == {"ann", "bob", None} and len(got) == 15
    text = {r.perspective: r for r in chat.dialogues(made).where("conv_id = 1").collect()}
    bob = text["bob"]
    assert bob.text.startswith("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi <\\|im_end|>")
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["<|im_end|>\n"]
    assert [text[None].text[m.start : m.end] for m in text[None].masks] == ["Bye<|im_end|>\n"]
    assert {r.perspective for r in made.where("conv_id IS NULL").collect()} == {"x"} and made.where("conv_id = 2").count() == 0


def test_chunks_are_cut_by_content():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh \n") for _ in range(20_000)).encode()
    chunks = lambda d: {d[a:b] for a, b in zip([0, *bpe.cut_points(d)], bpe.cut_points(d))}
    assert len(chunks(body) & chunks(b"some other beginning " + body)) >= 0.8 * len(chunks(body))
    assert hashlib.sha256(b"".join(body[a:b] for a, b in zip([0, *bpe.cut_points(body)], bpe.cut_points(body)))).digest() == hashlib.sha256(body).digest()
    assert bpe.cut_points(b"") == []


def reader_of(weights, words):
    return toxicity.Reader(toxicity.ToxicModel(weights, toxicity.CharModel.of(dict.fromkeys(words, 50.0)), [0.0] * 4))


def test_runs_of_signs_take_time_in_proportion():
    import time

    reader, began = reader_of({"snorkwad ": 4.0}, ["snorkwad", "plain"]), time.time()
    for sign in "-*._~=#":
        for text in ("a. " + sign * 10_000 + "xy", "a " + f"{sign} " * 5_000 + "word", "a " + f"b{sign} " * 5_000 + "zz", "a " + f"b{sign}" * 5_000 + "zz", "|" + sign * 10_000 + "|"):
            toxicity.runs(text)
        reader.hits("a. " + sign * 10_000 + "xy. b c")
    assert time.time() - began < 30


def test_runs_of_letters_written_apart():
    assert toxicity.runs("a b c d ef") == {"a b c d"} and toxicity.runs("x a-b-c-d.") == {"x a-b-c-d"} and toxicity.runs("a b c d e-fg h") == {"a b c d"}
    assert toxicity.runs("a-b-c-d-efg") == set() and toxicity.runs("f * c k") == {"f * c k"} and toxicity.runs("a b c") == set() and toxicity.runs("f . u . n") == {"f . u . n"}


def test_one_rule_for_disguises_of_any_length():
    reader = reader_of({"snorkwad ": 4.0, "snor": 3.0}, ["snorkwad", "plain", "xylophone"])
    for size in (20, 32, 38, 39, 40, 41, 42, 43, 50, 139, 140, 400):
        begun, stem = ("sn0rkw4d" + "plain" * 80)[:size], ("sn0rp" + "plain" * 80)[:size]
        within, last = ("plain" * 2 + "sn0rkw4d" + "plain" * 80)[:size], "plain" * ((size - 8) // 5) + "sn0rkw4d"
        assert [reader.token(t) for t in (begun, stem, within, last, ("pla1n" * 80)[:size])] == [4.0, 3.0, 4.0, 4.0, 0.0], size


def test_masked_words_are_looked_up():
    reader = reader_of({"snorkwad ": 4.0, "fig ": 9.0, "grumbot ": 2.0}, ["snorkwad", "snarkwed", "fig", "grumbot"])
    assert reader.token("sn**kw*d") == 4.0 and reader.token("g**mb*t!") == 2.0
    assert reader.masked("f*g") == 0.0 and reader.masked("********") == 0.0 and reader.masked("x**rkw*d") == 0.0


def plain_hits(model, text):
    """The definition read straight: each token's best weight, each spaced run's best, without caches."""
    def word(w):
        return max([model.weights.get(w + " ", 0.0), *(model.weights.get(w[:n], 0.0) for n in range(4, min(9, len(w)) + 1))])

    out = []
    for t in set(text.split()):
        core = t.strip(toxicity.EDGE).lower()
        best = [word(w) for w in toxicity.WORD.findall(t.lower())]
        if not (core.isalpha() and not toxicity.ODD.search(core)) and toxicity.ODD.search(t):
            short = toxicity.squeeze(t)
            for part in {short, short.strip(toxicity.EDGE), *(p for p in toxicity.PART.split(short) if toxicity.ODD.search(p))}:
                if any(c.isalpha() for c in part):
                    said = toxicity.restore(part, model.chars)
                    best += [word(said), *(w for f, w in model.weights.items() if f[-1] == " " and len(f) > 5 and f[:-1] in said)]
                    best += [w for f, w in model.weights.items() if f[-1] == " " and len(f) - 1 == len(part) > 3 and "*" in part and part[0] == f[0] and sum(map(str.isalpha, part)) > 1 and all(x in ("*", y) for x, y in zip(part, f))]
        elif core.isalpha():
            best = [word(core)]
        out.append(max(best, default=0.0))
    runs = set()
    tokens = text.split()
    for i in range(len(tokens)):
        j = i
        while j < len(tokens) and len(tokens[j]) == 1:
            j += 1
        if j - i >= 4 and (i == 0 or len(tokens[i - 1]) > 1):
            runs.add("".join(tokens[i:j]))
    for run in runs:
        said = toxicity.restore(toxicity.squeeze(run), model.chars)
        out.append(max([w for f, w in model.weights.items() if f.strip() in said and (f[-1] != " " or len(f) > 3)], default=0.0))
    hit = [w for w in out if w]
    return max(hit, default=0.0), sum(hit), len(hit) / max(1, len(tokens))


def test_hits_against_their_definition():
    words = ["snorkwad", "grumbot", "plain", "quiet", "table", "river"]
    reader = reader_of({"snorkwad ": 4.0, "grumbot ": 2.5, "grum": 1.5}, words)
    rng = random.Random(9)
    odd = ["sn0rkw4d", "snnnnorkwaddd", "gr*mbot", "(grumbot)", "gRumbots", "x-sn0rkwad", "s n o r k w a d", "g r u m b o t", "it's", "a1", "v2.0", "****", "--"]
    for _ in range(300):
        text = " ".join(rng.choice(words[2:] + odd) for _ in range(rng.randint(0, 12)))
        got, want = reader.hits(text), plain_hits(reader.model, text)
        assert got == pytest.approx(want), text


def test_labels_without_documents_dont_thin_the_sample(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["plain", "quiet", "table", "river", "stone"]) for _ in range(20)) + (f" snorkwad grumbot {i}" if i % 4 == 0 else f" {i}") for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), *((i, None) for i in range(900, 1000))], "doc_id long, text string")
    real = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    far = spark.range(1_000, 400_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic").unionByName(spark.range(900, 1000).selectExpr("id AS doc_id", "1 AS toxic"))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_toxicity(docs, x).collect()) for x in (real, real.unionByName(far)))
    assert a == b and len({s for _, s in a}) > 1


def test_every_labelled_row_teaches_toxicity(spark):
    """A word of six among 10,000 toxic documents counts; documents that are copies share a vote, and none is left out."""
    rng = random.Random(21)
    plain = [f"{a}{b}" for a in ("ri", "sto", "gar", "win", "yel", "mar", "let", "brid") for b in ("ver", "ned", "den", "dow", "lit", "ket", "ton", "gem")]
    texts = [" ".join(rng.choice(plain) for _ in range(8)) + (" snorkwad" if i % 4 == 0 else "") for i in range(40_000)]
    for i in rng.sample([i for i in range(0, 40_000, 4) if zlib.crc32(str(i).encode()) % 5], 6):
        texts[i] = texts[i].replace("snorkwad", "grumbot")
    texts += ["copied text of a zanyfool here"] * 60 + ["river a grumbot", "river a garden", "river a zanyfool"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    labels = spark.range(40_060).selectExpr("id AS doc_id", "CAST(id % 4 = 0 OR id >= 40000 AS INT) AS toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(40_000) if "grumbot" not in texts[i])
    assert got[40_060].score > got[40_061].score == got[40_062].score
    votes = {r.doc_id: r.w for r in toxicity.weighed(docs, labels).collect()}
    assert set(votes) == set(range(40_060)) and max(votes.values()) == toxicity.UNIT
    assert sum(votes[i] for i in range(40_000, 40_060)) <= toxicity.UNIT and sum(votes[i] for i in range(40_000)) > 39_900 * toxicity.UNIT
