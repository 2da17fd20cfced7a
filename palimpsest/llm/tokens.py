"""Token ids by the public byte-level tokenizer, as bytes of unsigned 32-bit ids.

The tokenizer's pattern always breaks before a single blank and around a single
line feed between solid characters, and between a letter and the signs after
it. So the ids of a text are those of its words, and words are looked up in a
cache that the tokenizer fills. A text with any other white space, or with the
opening of a special token, goes through the tokenizer whole.
"""

from __future__ import annotations

import os
from array import array

from palimpsest.llm.common import CACHES

TOKENIZER = "byte_bpe_50k.json"
CACHE = "tokens"

# Signs that the pattern takes as one run after a letter; apostrophes are not
# among them, because it knows some endings that begin with one.
_SIGNS = ".,;:!?#*$%&|<>()[]/+=-"
_CACHED_CHARS = 64
_CACHED_WORDS = 500_000
_CACHED_JOINED = 200_000
_LATIN_END = "\u0250"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Words(dict):
    """Ids of ``before + word`` by word. Words that end in signs are put
    together from two entries; what is full takes no more words."""

    def __init__(self, ids, before: str, signs: dict | None):
        super().__init__()
        self._ids, self._before, self._signs = ids, before, signs
        self._joined = 0

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_SIGNS)
        if letters and letters is not word and letters[-1].isalpha():
            signs = self if self._signs is None else self._signs
            ids = self[letters] + signs[word[len(letters) :]]
            if self._joined < _CACHED_JOINED and len(word) <= _CACHED_CHARS:
                self._joined += 1
                self[word] = ids
            return ids
        ids = self._ids(self._before + word)
        if len(self) < _CACHED_WORDS and len(word) <= _CACHED_CHARS:
            self[word] = ids
        return ids


class _Signs(dict):
    """For each character of a word the form that the model reads it in."""

    def __init__(self, tokenizer):
        super().__init__()
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self[" "] = self._split(" a")[0][0][:-1]

    def __missing__(self, sign: str) -> str:
        self[sign] = self._split(sign)[0][0]
        return self[sign]


class Encoder:
    """``encode(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model.tokenize
        self._forms = _Signs(self._tokenizer)
        self._first = _Words(self._word, "", None)
        self._later = _Words(self._word, " ", self._first)
        self._feed = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.removeprefix(" ")
        plain = letters.isascii()
        if letters.isalpha() and (plain or max(letters) < _LATIN_END):
            # One run of letters: it goes to the model as it is, without the
            # search for breaks. The model reads ASCII letters as they are.
            if plain:
                form = letters if letters is word else self._forms[" "] + letters
            else:
                form = "".join(map(self._forms.__getitem__, word))
            return array("I", [t.id for t in self._model(form)]).tobytes()
        return self._ids(word)

    def _line(self, line: str) -> bytes:
        first, *later = line.split(" ")
        return self._first[first] + b"".join(map(self._later.__getitem__, later))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.split()
        gaps = len(words) - 1
        single = len("".join(words)) + gaps == len(text)
        if not single or text.count(" ") + text.count("\n") != gaps or "<|" in text:
            return self._ids(text)
        return self._feed.join(map(self._line, text.split("\n")))


_ENCODERS: dict[str, Encoder] = CACHES.setdefault(CACHE, {})


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its cache outlives the task, until
    one that does not keep it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
