"""Encoding with the public vocabularies; words that repeat are encoded once per worker."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: What the vocabularies' patterns call white space (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{SPACE}]+")
#: Separators that str.split() takes and Unicode's White_Space does not.
_ODD = re.compile("[\x1c-\x1f]")
#: A word that normalisation leaves alone but for its case, and that the vocabulary's pattern cuts in two at most; or any.
_PLAIN = re.compile(r"^(?:([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,!?;:*#$%&|]*)|(.*))$", re.MULTILINE)
#: Entries in each of a cache's two generations: a limit on memory, without effect on ids.
GENERATION = 300_000


def vocabulary_path(name: str) -> str:
    """`name` itself if it is a path, else the installed file of that name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """Holds what was asked for last: a full generation grows old, and entries that are asked for again move back."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, keys: list[str], make) -> dict[str, bytes]:
        """The current generation, with all of keys in it; make(keys) gives the values of unknown ones."""
        missing = set(keys).difference(self.new)
        if missing:
            if len(self.new) + len(missing) > GENERATION:
                self.old, self.new = self.new, {}
                missing = set(keys)
            if back := {x for x in missing if x in self.old}:
                self.new.update((x, self.old[x]) for x in back)
                missing -= back
            if missing:
                unknown = list(missing)
                self.new.update(zip(unknown, make(unknown), strict=True))
        return self.new


class WordEncoder:
    """Ids under a tokenizers file whose pattern drops white space: words are independent, so each is encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = [x["type"] for x in settings["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and settings["pre_tokenizer"]["pretokenizers"][0].get("invert") is True
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in codes)}
        self.pieces, self.words = Cache(), Cache()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        shown, cut = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in pieces], self.tokenizer.model.tokenize
        return [array("I", [y.id for y in cut(x)]).tobytes() for x in shown]

    def _words(self, words: list[str]) -> list[bytes]:
        cut = [(name.lower(), marks, rest) for name, marks, rest in _PLAIN.findall("\n".join(words))]
        known = self.pieces.fill([x for name, marks, _ in cut for x in (name, marks) if x], self._pieces)
        return [self._whole(rest) if rest else known[name] + known[marks] if marks else known[name] for name, marks, rest in cut]

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self._whole(text), np.uint32)
        words = _WORD.findall(text) if _ODD.search(text) else text.split()
        known = self.words.fill(words, self._words)
        return np.frombuffer(b"".join([known[x] for x in words]), np.uint32)

    def count(self, text: str) -> int:
        return len(self(text))


class RankEncoder:
    """Ids under a *.tiktoken file; a text's special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> WordEncoder | RankEncoder:
    """One encoder for each worker process and vocabulary (an installed file's name or a path)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = vocabulary_path(vocabulary)
    return RankEncoder(path) if path.endswith(".tiktoken") else WordEncoder(path)
