import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment, spelling
from lectern.llm.queries import op11_identity_map_alignment, op13_composed_spelling_variants
from lectern.llm.vocab import byte_alphabet

SCHEMA = "doc_id long, text string, n long, word string, links string"  # the last three clash with names within


def texts() -> list[tuple]:
    rng = random.Random(5)
    words = ["the", "Naïve", "café", "don't", "x²", "日本", "🙂", "a_b", "--", "1234", "Straße", "über", " ", "tab\tbed", "line\nend", "two  blanks", "\n\n", "<|endoftext|>", "</s>", "<0x41>", "▁"]
    made = [(i, "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n", ". "]) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    made += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "  lead"), (205, "trail  "), (206, "\x00nul"), (207, "é ﬁ ①"), (None, "no id twice"), (None, "no id twice"), (7, "one id, another text"), (208, "long " * 20_000), (209, "y" * 5_000)]
    return made


def brute_alignment(rows):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, out, counts = byte_alphabet(), [], Counter()
    for doc_id, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if regex.fullmatch("<0x..>", p) and b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in (b_model.id_to_piece(i),)]
            if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
                a, b, a_bytes, b_bytes = [], [], [], []
            a_ends, b_ends = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
            at_a, at_b = {e: i for i, e in enumerate(a_ends)}, {e: i for i, e in enumerate(b_ends)}
            i = j = 0
            for e in sorted(at_a.keys() & at_b.keys()):
                groups.append(",".join(map(str, a[i : at_a[e] + 1])) + "|" + ",".join(map(str, b[j : at_b[e] + 1])))
                i, j = at_a[e] + 1, at_b[e] + 1
                links.append((a[i - 1], b[j - 1]))
        counts.update(links)
        out.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return Counter((d, a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha(s)) for d, a, b, g, ls, s in out)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_against_the_libraries(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame([(d, t, 1, "w", "l") for d, t in rows], SCHEMA).repartition(3)
    want = brute_alignment(rows)
    for frequent in (0, 5, alignment.FREQUENT):
        found = alignment.score_alignment(docs, frequent=frequent).collect()
        assert Counter(tuple(r[c] for c in NAMES) for r in found) == want
        assert all(r["groups"].count(";") + 1 == r["n_groups"] for r in found if r["n_groups"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(tuple(r[c] for c in NAMES) for r in op11_identity_map_alignment(spark, str(tmp_path)).collect()) == want
    assert alignment.score_alignment(docs.limit(0)).count() == 0


def test_identity_map_and_words():
    aligner = alignment.Aligner(alignment.default_path("byte_bpe_50k.json"), alignment.default_path("piece_bpe_32k.model"))
    for a, b in enumerate(aligner.same):
        assert b == alignment.NONE or aligner.a.table[a] == aligner.b.table[b]
    assert aligner.b.by_word and (aligner.same != alignment.NONE).sum() > 10_000
    given = [text for _, text in texts()]
    for text, got in zip(given, aligner.texts(given), strict=True):
        want = aligner.whole(text) if text else None
        assert (got is None) == (want is None) and (got is None or got[:4] == want[:4] and np.array_equal(got[4], want[4]))


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_composition_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)})
        acceptor = spelling.Acceptor(words)
        assert len(set(zip(acceptor.final, map(tuple, (e.items() for e in acceptor.edges))))) == len(acceptor.final)  # minimal
        found = [tuple(sorted(p)) for p in spelling.Composition(acceptor).pairs()]
        assert sorted(found) == [(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)]


def vocabulary() -> list[str]:
    rng = random.Random(2)
    made = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(400)}  # dense: many neighbours
    made |= {"a" * n for n in range(7, 60)} | {"prefix" * 5 + x + y for x in "abc" for y in "abcd"} | {x + "suffix" * 5 for x in ("", "a", "b", "ab", "ba", "abc")}
    return sorted(made | {"éternel", "éternels", "eternel", "zéternel", "z" * 30_000, "z" * 15_000 + "y" + "z" * 15_000})


def test_pairs_against_all_pairs_in_partitions_of_any_size(spark):
    words = vocabulary()
    want = {(a, b) for a, b in itertools.permutations(words, 2) if abs(len(a) - len(b)) < 2 and near(a, b)}
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    for letters in (40, 2_000, spelling.PARTITION_LETTERS):
        found = [(r["word"], r["other"]) for r in spelling.near_pairs(frame, letters).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def brute_spelling(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w, vs in by.items():
        if vs and n[top := min(vs, key=lambda v: (-n[v], v))] >= 10 * n[w]:
            form[w] = top
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(by[w]), n.get(form.get(w))))
    return out


def test_spelling_groups_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    heads = ["Language", "languages", "Élégante", "variation", "variatiom", "ÀÉÎÕÜßñ÷×ok", "colouring", "coloring", "xlanguage"]
    rows = [(i, " ".join([rng.choice(heads[:4])] * rng.randint(0, 40) + rng.choices(heads, k=2)) + "-" + "x1long_word") for i in range(150)]
    rows += [(None, "language " * 3), (None, None), (900, ""), (901, "l" * 100_000), (902, "l" * 100_000), (903, "zz" * 40_000 + " languagea languagea languageab languageab")]
    rows += rows[:5]
    docs = spark.createDataFrame([(d, t, 1, "w", "l") for d, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_composed_spelling_variants(spark, str(tmp_path)).collect()
    names = ("word", "form", "root", "n", "n_near", "form_n")
    got = {tuple(r[c] for c in names) for r in found}
    assert len(found) == len(got) and got == brute_spelling(rows)
    assert any(r["root"] != r["form"] for r in found if r["form"])  # a chain of two forms
    assert spelling.spelling_groups(docs.limit(0)).count() == 0
