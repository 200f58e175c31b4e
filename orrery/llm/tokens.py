"""Token ids of whole texts by the ``tokenizers`` library.

Byte-level files split a text into words before they merge, so a word's ids don't
depend on its neighbours: the words of a text are looked up among those that this
process has met, and only new ones go through the library's model.  Texts with
characters outside the ranges below, where two regex engines may class characters
differently, and files of another kind, are encoded by the library as a whole.
Either way takes time in proportion to the text, whatever stands in it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import islice

import numpy as np
import public_tokenizers

TOKENIZER = "byte_bpe_50k.json"

#: Characters outside Latin letters, common punctuation and plain white space, and the start of special tokens.
UNUSUAL = re.compile(r"[^\t\n\r -~¡-ɏ–-…€]|<\|")

#: Words that a process remembers, and their most characters.
REMEMBERED, SHORT = 400_000, 32
#: Characters from which on a text's words are taken some at a time.
LONG = 1 << 18


def _class(kind: str) -> str:
    """The characters below U+0250 of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(kind))


def words_pattern() -> re.Pattern:
    """The pre-tokenizer's words in usual texts: contractions, letters, numbers, other signs, white space."""
    letter, number = _class("L"), _class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+")


_shared: dict[str, TextEncoder] = {}


def _byte_of_character() -> dict[str, int]:
    """Byte-level files write a byte as a visible character: itself, or the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TextEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.known = Tokenizer.from_file(path), None, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
        if not self.byte_level:
            return
        to_byte, special = _byte_of_character(), {x["content"] for x in spec["added_tokens"]}
        vocab = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.character = {b: c for c, b in to_byte.items()}
        if spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space"):
            self.words = words_pattern()
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        for x in spec["added_tokens"]:
            self.sizes[x["id"]] = len(x["content"].encode())

    def _word(self, word: str) -> bytes:
        """The ids of one word, as bytes."""
        visible = word.encode().decode("latin-1").translate(self.character)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(visible)], np.uint32).tobytes()
        if len(word) <= SHORT and len(self.known) < REMEMBERED:
            self.known[word] = ids
        return ids

    def one(self, text: str) -> np.ndarray:
        if self.words is None or UNUSUAL.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) <= LONG:
            return np.frombuffer(self._joined(self.words.findall(text)), np.uint32)
        found, parts = self.words.finditer(text), []
        while some := [m.group() for m in islice(found, LONG)]:
            parts.append(self._joined(some))
        return np.frombuffer(b"".join(parts), np.uint32)

    def _joined(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self._word(w) for w in words])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (uint32) of each text; null counts as empty."""
        none = np.zeros(0, np.uint32)
        return [self.one(t) if t else none for t in texts]

    def token_bytes(self) -> np.ndarray:
        """The number of UTF-8 bytes that each id of a byte-level file stands for."""
        if not self.byte_level:
            raise ValueError("only tokens of byte-level files have a fixed number of bytes")
        return self.sizes


def encoder(path: str | None = None) -> TextEncoder:
    """This process's encoder for the file (the public byte-level vocabulary unless given)."""
    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _shared:
        _shared[path] = TextEncoder(path)
    return _shared[path]
