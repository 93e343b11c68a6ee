"""Whole texts to ids of the tokenizers library, with a bounded memory of words.

Both vocabularies' pre-tokenizers end a token before a single space or line feed that stands between two characters
that aren't white space, and look no further back.  So the ids of such a text are those of its words, one after
another.  Words repeat: a worker keeps the ids of up to ``WORDS`` of them, or as many as its caller says.  A new word of Latin-1 letters, with a mark
after it or not, goes straight to the library's BPE model; any other new word, any text with other white space about,
and any text that holds the string of a special token goes through the library's whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache
from itertools import islice

import numpy as np

WORDS = 500_000
MARKS = tuple(".,;:!?")
LATIN = "\u0100"


@cache
def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Odd(Exception):
    """White space about a word: the text isn't its words one after another."""


class Words(dict):
    """Word to its ids as little-endian uint32 bytes; what isn't known is found and kept."""

    def __init__(self, tokenizer, lead: str, spaceless: bool, most: int = WORDS):
        self.tokenizer, self.lead, self.spaceless, self.most = tokenizer, lead, spaceless, most
        self.letter = byte_letters()[32] if lead else ""
        self.marks: dict[str, bytes] = {}
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and max(word) < LATIN:  # one pre-token
            found = self.alphabetic(word)
        elif word[-1:] in MARKS and word[:-1].isalpha() and max(word) < LATIN:  # two
            mark = word[-1]
            found = self[word[:-1]] + (self.marks.get(mark) or self.marks.setdefault(mark, self.slowly(mark, "")))
        elif not self.spaceless and (not word or word[0].isspace() or word[-1].isspace()):
            raise Odd
        else:
            found = self.slowly(word, self.lead)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def alphabetic(self, word: str) -> bytes:
        if self.spaceless:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin1").translate(byte_letters())
        return array("I", [t.id for t in self.tokenize(self.letter + word)]).tobytes()

    def slowly(self, word: str, lead: str) -> bytes:
        return array("I", self.tokenizer.encode(lead + word, add_special_tokens=False).ids).tobytes()


class Encoder:
    """ids of whole texts, as the library as it comes gives them.  spaceless: white space has no ids."""

    def __init__(self, name: str, spaceless: bool, most: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, strings)), re.IGNORECASE) if strings else None
        self.spaceless = spaceless
        self.first = Words(self.tokenizer, "", spaceless, most)
        self.later = self.first if spaceless else Words(self.tokenizer, " ", spaceless, most)
        self.line_end = b"" if spaceless else np.array(self.tokenizer.encode("\n").ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.special and self.special.search(text):
            return self.whole(text)
        first, later, out = self.first.__getitem__, self.later.__getitem__, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(first(words[0]))
                out.extend(map(later, islice(words, 1, None)))
                out.append(self.line_end)
        except Odd:
            return self.whole(text)
        out.pop()
        return np.frombuffer(b"".join(out), "<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def encoder(name: str, spaceless: bool, most: int = WORDS) -> Encoder:
    """One for each worker process."""
    return Encoder(name, spaceless, most)
