"""Whole texts to ids with a tokenizer file, remembering words it has seen.

The tokenizer's own pre-tokenizer never joins what white space separates and
its normaliser turns white space into separators, so a text's ids are those of
its words one after another. Each new word goes through the library once.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
import zlib
from array import array

#: Words kept by a worker; words beyond are encoded each time.
MAX_WORDS = 900_000
#: What str.split() takes for white space and the tokenizer does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
TAIL = re.compile(r"^(.*[^\W\d_])([^\w\s']+)$", re.DOTALL)


class Words(dict):
    """Ids of words as bytes; a word that is missing is encoded when asked for."""

    def __init__(self, library, max_words: int):
        super().__init__()
        self.library, self.max_words = library, max_words
        self.tokenize = library.model.tokenize
        # the byte-level alphabet: visible Latin-1 as it is, other bytes from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def one(self, pre_token: str) -> bytes:
        """Ids of lower-case letters, which are one pre-token."""
        if not pre_token.isascii():
            pre_token = pre_token.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenize(pre_token)]).tobytes()

    def any(self, word: str) -> bytes:
        return array("I", self.library.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.islower():
            ids = self.one(word)
        elif (m := TAIL.match(word)) and "<|" not in word and m[1].isalpha() and m[1].islower():
            ids = self[m[1]] + self[m[2]]
        else:
            ids = self.any(word)
        if len(self) < self.max_words:
            self[word] = ids
        return ids


class WordBpe:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path), max_words)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)  # as the tokenizer does, before lower case
            if "Σ" in text or "İ" in text:  # lower case that is not letter by letter
                return self.words.any(text)
        if "<|" in text or NOT_SPACE.search(text):
            return self.words.any(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """One coder for each worker process."""
    if path not in _coders:
        gc.disable()  # the tables only ever grow and hold no cycles
        _coders[path] = WordBpe(path)
    return _coders[path]


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
