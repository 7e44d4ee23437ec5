"""Token ids of whole texts with the public tokenizers, and a memo of space-separated parts.

Both vocabularies split text before merging, and no split crosses a space or line end that stands between
two characters that are not white space. Parts between such places are therefore encoded on their own and
remembered; the ids are those of the whole text. Texts with other runs of white space that touch a space
go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte-level vocabularies write a byte as the character of that number if it prints, else as one from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
MEMO_PARTS, MEMO_CORES = 1_000_000, 100_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once per worker; strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Values by key, each made by ``make`` when it is first asked for."""

    def __init__(self, make: Callable[[str], bytes | None]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes | None:
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes texts to the bytes of their ids, little-endian unsigned 32-bit.

    Parts between spaces are remembered, and so are their cores: a part is cut before its trailing ASCII
    punctuation, where both vocabularies cut as well. A core of Latin letters is one word to either
    vocabulary, and no normalisation but lower case changes it, so it goes to the tokenizer's model directly
    and is remembered as the part that it is without punctuation. Where spaces matter, a line end belongs to
    the part behind it, and the parts at the start of a text or line are remembered apart from those behind a
    space.
    """

    def __init__(self, path: str, spaces_matter: bool):
        self.path, self.spaces_matter = path, spaces_matter
        self.first = _Memo(lambda part: self._learn(part, self.first, ""))
        self.rest = _Memo(lambda part: self._learn(part, self.rest, " ")) if spaces_matter else self.first
        self.cores = _Memo(lambda core: self._whole([core])[0])
        self.merge = tokenizer(path).model.tokenize
        self.line_end = self._whole(["\n"])[0]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if len(self.first) + len(self.rest) > MEMO_PARTS:
            self.first.clear()
            self.rest.clear()
        if len(self.cores) > MEMO_CORES:
            self.cores.clear()
        if not self.spaces_matter:
            return [b"".join(map(self.first.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
        out, rest = [], self.rest.__getitem__
        for text in texts:
            start, *parts = text.replace("\n", " \n").split(" ")
            found = [self.first[start], *map(rest, parts)]
            out.append(self._whole([text])[0] if None in found else b"".join(found))
        return out

    def _learn(self, part: str, memo: _Memo, before: str) -> bytes | None:
        """Ids of a part; None if its spaces do not stand between other characters."""
        if before and part[:1] == "\n":
            ids = self.first[part[1:]]
            return None if ids is None else self.line_end + ids
        core = part.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or _LATIN.fullmatch(core)):
            word, tail = core if self.spaces_matter else core.lower(), part[len(core):]
            if word != part:
                return memo[word] + self.cores[tail] if tail else memo[word]
            return self._word(word, before)
        pieces = self._pieces(part, before)
        return None if pieces is None else b"".join([self.cores[c] for c in pieces])

    def _pieces(self, part: str, before: str) -> list[str] | None:
        """The part as pieces that are encoded apart; None if its spaces do not stand between other characters."""
        if not self.spaces_matter:
            return _core_and_tail(part.lower() if part.isascii() else part) if part else []
        if part == "" or part[0].isspace() or part[-1].isspace():
            return None
        return _core_and_tail(before + part)

    def _word(self, word: str, before: str) -> bytes:
        """Ids of a word of Latin letters, from the model alone; the space before it is part of the word."""
        space = before and chr(_BYTE_LETTERS[ord(before)])
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(space + spelled)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]


def _core_and_tail(part: str) -> list[str]:
    core = part.rstrip(string.punctuation)
    return [core, part[len(core):]] if 0 < len(core) < len(part) and core[-1].lower()[-1].isalnum() else [part]


@lru_cache(maxsize=4)
def encoder(path: str, spaces_matter: bool) -> Encoder:
    return Encoder(path, spaces_matter)


def encode_with(name: str, spaces_matter: bool, path: str | None = None) -> Callable[[Iterable[str]], list[bytes]]:
    """A function for tasks: texts to id bytes with the tokenizer file ``path`` (default: the public one)."""
    return lambda texts: encoder(path or public_file(name), spaces_matter).encode(texts)
