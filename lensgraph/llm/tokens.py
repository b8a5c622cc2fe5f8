"""Whole texts as token ids of a public tokenizer file, with a memo of words.

The tokenizer drops white space and never joins what white space parts, so the ids of a text are those of its words in
turn. Each distinct word goes through the tokenizers library once while the memo holds it; the memo has two
generations, so that frequent words stay and its size is bounded. A word of Latin-1 letters, with or without marks
after them, is one piece (or two) to the pre-tokenizer and goes straight to the library's BPE model; any
other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os

import numpy as np

#: Words in one generation of the memo.
MEMO_WORDS = 250_000
#: Marks that the pre-tokenizer takes as one run after letters.
_MARKS = ".,;:!?#$%&*()-/|+=@^_~`"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_loaded: dict[str, object] = {}


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it prints, else the next from U+0100 on."""
    others = [b for b in range(256) if b not in _PRINTED]
    return {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memo(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers; learns what it lacks."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


def _tokenizer(path: str):
    """The library's tokenizer, loaded once in a worker's life."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class Encoder:
    """Encodes texts with the tokenizer in a file whose pre-tokenizer takes runs of letters and runs of other marks.

    The memo goes with the encoder, so a task that makes one leaves no memo in a worker that Spark uses again.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}
        self.young = _Memo(self._learn)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is not None:
            return ids
        if word.isalpha():
            try:
                plain = word.lower().encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(word)
            name = plain.decode("ascii") if plain.isascii() else word.lower().encode().decode("latin-1").translate(self.letters)
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(name)])
        core = word.rstrip(_MARKS)
        # Latin-1 alone: elsewhere lowering may end in a combining mark, or the library may know no such letter
        if core.isalpha() and max(core.lower()) < "\u0100":
            return self.young[core] + self.young[word[len(core) :]]
        return self._whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, _Memo(self._learn)
        get = self.young.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]


def blocks(texts: list, most: int = 1 << 20):
    """Ranges of rows with about `most` characters together."""
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield row, end
        row = end
