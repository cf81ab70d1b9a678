"""Whole texts to token ids with a public tokenizer whose words do not depend on their surroundings.

The word tokenizer normalises (NFC, lower case) and cuts inside white-space separated words
only, so the ids of a text are those of its words in a row. A worker keeps the ids of words
that it has seen, and of the pieces that the tokenizer cuts words into; only new pieces go
through the tokenizers library's model, only words beyond ASCII through its normaliser and
pre-tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import regex

#: Characters of words and of pieces that a worker keeps, each counted with ENTRY_CHARS more; beyond
#: that the memo starts anew with the next text. Results don't depend on it.
MEMO_CHARS, ENTRY_CHARS = 40_000_000, 64
#: str.split() also cuts at these four; the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORD = regex.compile(r"\S+")
#: Words of printable ASCII and accented Latin letters, whose normal form is a lower-case letter for each letter.
LATIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
#: How the vocabulary cuts such a word in lower case (fixed by the vocabulary).
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")

_loaded: dict = {}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Values that are made when they are first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.chars = make, 0

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        self.chars += len(key) + ENTRY_CHARS
        return value

    def trim(self) -> None:
        """Start anew if it holds too much."""
        if self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0


class WordEncoder:
    """ids(texts): for each text its ids as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model, self.normalizer, self.pre_tokenizer = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.letters = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        self.memo, self.pieces = Memo(self._encode), Memo(self._model_ids)

    def _packed(self, ids: Iterable[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _cut(self, word: str) -> list[str] | None:
        """The model's pieces of a word; None where a special token may be meant."""
        if "<|" in word:
            return None
        if LATIN.fullmatch(word):
            cut = LATIN_PIECES.findall(word.lower())
            return cut if word.isascii() else ["".join([self.letters[b] for b in p.encode()]) for p in cut]
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))]

    def _model_ids(self, piece: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(piece)])

    def _encode(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.pieces[word.lower()]
        cut = self._cut(word)
        if cut is None:
            return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, cut))

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            words = WORD.findall(text) if SEPARATORS.search(text or "") else (text or "").split()
            self.memo.trim()
            self.pieces.trim()
            yield b"".join(map(self.memo.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
