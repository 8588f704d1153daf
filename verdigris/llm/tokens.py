"""Exact token ids and counts of public tokenizers, with word reuse.

A tokenizer whose pre-tokenizer drops white space treats the words of a text
independently, so each distinct word is encoded once and looked up after. Other
vocabularies encode whole texts. Ids always come from the public library.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: Fixed value: the pre-tokenizer pattern under which words are independent.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of more characters are encoded each time they occur.
LONG = 60
#: Words kept by a worker, up to four times over, some 200 bytes each; the less recent half goes when a dict of them is full.
KEPT = 120_000


#: A single mark of these after letters is a token sequence of its own.
MARKS = ".,;:!?"
#: Letters below it have one code point in normal form; each but one has one lower-case letter.
PLAIN_BELOW, NOT_PLAIN = "\u0180", "\u0130"


#: The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes, in order, for code points from 256 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def byte_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)


def core_of(word: str) -> tuple[str, str] | None:
    """(lower-case letters, mark or nothing) if that is all a word holds: its
    tokens are those of the letters, then those of the mark."""
    mark = word[-1:]
    if mark in MARKS:
        letters = word[:-1]
    else:
        letters, mark = word, ""
    if letters.isalpha() and (letters.isascii() or max(letters) < PLAIN_BELOW and NOT_PLAIN not in letters):
        return letters.lower(), mark
    return None


class Lookup(dict):
    """Values by word; a missing word is taken from the older generation or made.
    Long words are made each time."""

    def __init__(self, make: Callable[[str], object], old: dict):
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= LONG:
            self[word] = found
        return found


class Encoder:
    """ids of whole texts as little-endian arrays, for a .json (tokenizers) or
    .model (sentencepiece) vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lists = lambda texts: sp.encode(texts, num_threads=1)
            size = sp.get_piece_size()
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            self.tokenizer = t
            self.lists = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            self.by_word = pre[0].get("pattern", {}).get("Regex") == WORDS_ONLY and pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert"))
            size = t.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.words = Lookup(self._make, {})
        if self.by_word:
            # of plain letters the normaliser and the pre-tokenizer keep all: the library's model is called at once
            self.merge = t.model.tokenize
            self.marks = {m: np.array(self.lists([m])[0], self.dtype).tobytes() for m in MARKS} | {"": b""}

    def _make(self, word: str) -> bytes:
        core = core_of(word)
        if core is None:
            return np.array(self.lists([word])[0], self.dtype).tobytes() if word else b""
        return array("H" if self.dtype.itemsize == 2 else "I", [x.id for x in self.merge(byte_letters(core[0]))]).tobytes() + self.marks[core[1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        if not self.by_word:
            return [np.array(x, self.dtype).tobytes() for x in self.lists(texts)]
        if len(self.words) > 2 * KEPT:
            self.words = Lookup(self._make, dict(self.words))
        known = self.words.__getitem__
        return [b"".join(map(known, s)) for s in split_words(map(folded, texts))]


def folded(text: str) -> str:
    """Latin-1 texts in lower case, which the normaliser would bring about; a text
    that may hold a special string, or other letters, as it is."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def split_words(texts: Iterable[str]) -> Iterable[list[str]]:
    """Between spaces and line feeds; words may be empty."""
    for t in texts:
        yield t.replace("\n", " ").split(" ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_list(column) -> list[str]:
    """An Arrow column of strings as a list, null as empty."""
    return [t or "" for t in column.to_pylist()]
