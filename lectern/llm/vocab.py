"""Exact, fast encoders over public tokenizer files, built in each Python worker once."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

END = b"\xff"  # stands for the end-of-word mark; UTF-8 text never holds this byte
ODD_SPACES = "\x1c\x1d\x1e\x1f"  # str.split() cuts at these; the tokenizer doesn't


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _require(spec: dict, path: str, **wanted) -> None:
    """Refuses tokenizer files whose parts differ from those that the encoders reproduce, or whose merges don't follow their ids."""
    model = spec["model"]
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
    given = {k: spec.get(k) for k in wanted} | {k: model.get(k) for k in plain}
    if model.get("type") != "BPE" or given != wanted | plain:
        raise ValueError(f"{path}: a tokenizer of another kind: {given}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens with conditions")
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [model["vocab"].get("".join(m), -1) for m in pairs]
    if any(a >= b for a, b in zip([-1, *made], made)):
        raise ValueError(f"{path}: merges that don't follow the ids")


LETTERS_AND_DIGITS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class WordEncoder:
    """Token ids of a lower-casing word BPE, as little-endian 32-bit bytes.

    White space never lies within a token and only separates words, so a text's ids are the ids of its
    white-space-separated words in order. Those are cached per worker, up to ``cache_words`` entries, after which the
    cache starts anew. The end-of-word mark is the byte ``END``: its merges with the letter before it rank first.
    """

    def __init__(self, path: str, cache_words: int = 300_000):
        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        pattern = f"{CONTRACTIONS}|{LETTERS_AND_DIGITS}"
        cut = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
        rest = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        _require(spec, path, normalizer={"type": "Sequence", "normalizers": normal}, pre_tokenizer={"type": "Sequence", "pretokenizers": [cut, rest]})
        alphabet, suffix, ranks = byte_alphabet(), spec["model"]["end_of_word_suffix"], {}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            ends = token.endswith(suffix)
            ranks[bytes(alphabet[c] for c in token.removesuffix(suffix)) + (END if ends else b"")] = i
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = regex.compile(pattern).findall
        self.special, self.cut = special, re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.cache_words, self.cache = cache_words, {}

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self.core.encode_single_piece(piece.encode() + END)
        return ids

    def word(self, text: str) -> bytes:
        ids: list[int] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            ids += [self.special[part]] if part in self.special else self._plain(part)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self.word(text)
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > self.cache_words:
                self.cache.clear()
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    ids = self.cache.get(word)
                    if ids is None:
                        ids = self.word(word)
                        if len(word) <= 64:
                            self.cache[word] = ids
                    found[i] = ids
        return b"".join(found)


class ByteEncoder:
    """Token ids of a byte-level BPE; the special tokens' strings in a text become their ids.

    Ids are kept as 16-bit numbers, so a vocabulary beyond them is refused, as is a file with another cutting pattern.
    """

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        _require(spec, path, normalizer=None, pre_tokenizer=level)
        if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) > 0xFFFF or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: ids beyond 65535, or marks at the ends of words")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.table = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.widths = np.zeros(max(self.table) + 1, np.int64)
        for i, b in self.table.items():
            self.widths[i] = len(b)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.coder.encode(text, allowed_special="all")
        return self.coder.encode_ordinary(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
