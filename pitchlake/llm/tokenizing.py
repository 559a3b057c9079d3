"""Tokenizer files, and word-wise encoding that gives what the library gives on whole texts."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import unicodedata
from functools import lru_cache

#: Distinct words kept by a worker; beyond that the table starts anew.
TABLE_WORDS = 200_000


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _class(*majors: str) -> str:
    """Character class of the Latin code points of these major categories."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in majors)


L, N = _class("L"), _class("N")
#: Code points of which every Unicode version and normal form tells the same; a text with others, or with a special token, goes to the library whole.
UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f\\u2013\\u2014\\u2018-\\u201d]|<\\|")
_APOSTROPHES = "'s|'t|'re|'ve|'m|'ll|'d"
PIECES = {
    "byte": re.compile(f"{_APOSTROPHES}| ?[{L}]+| ?[{N}]+| ?[^\\s{L}{N}]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"{_APOSTROPHES}|[{L}]+|[{N}]|[^\\s{L}{N}]+"),
}


def pre_split(text: str, kind: str) -> list[str] | None:
    """The words that the library would split a text into, or None if only the library can tell."""
    if UNUSUAL.search(text):
        return None
    return PIECES[kind].findall(text.lower() if kind == "word" else text)


class WordTable(dict):
    """word -> what value(library encoding) gives; each distinct word is encoded once."""

    def __init__(self, path: str, kind: str, value):
        super().__init__()
        self.library, self.kind, self.value = load(path), kind, value

    def whole(self, text: str):
        return self.value(self.library.encode(text, add_special_tokens=False).ids)

    def words(self, text: str) -> list[str] | None:
        """The text's words, or None if only the library can split it."""
        return pre_split(text, self.kind)

    def learn(self, lists: list[list[str] | None]) -> None:
        seen = set().union(*(x for x in lists if x))
        new = list(seen - self.keys())
        if len(self) + len(new) > TABLE_WORDS:
            self.clear()
            new = list(seen)
        for word, e in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
            self[sys.intern(word)] = self.value(e.ids)
