"""Token ids of whole texts, part by part through the tokenizers library."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Characters at which Python splits words but the tokenizer's pattern does not.
NO_BREAKS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Parts kept with their ids. Beyond that a new generation starts, which takes over what
#: is used again from the one before.
PARTS_KEPT = 500_000
#: Longer parts are encoded but not kept.
LONGEST_KEPT = 64
#: Letters that normalisation leaves alone and whose lower case is one letter of the range.
LETTERS = "a-zß-öø-įı-ſ"
#: Signs that are nothing more to the tokenizer: no apostrophe, no start of a special token.
SIGNS = r"!-&(-/:;=-@\[-`{-~"
PLAIN = frozenset(
    [*map(chr, range(0x20, 0x7F)), *"\t\n\x0b\x0c\r", *map(chr, range(0xC0, 0x180))]
) - frozenset("'<×÷İ")
#: Runs of letters, single digits and runs of signs: how the tokenizer cuts plain text.
PARTS = re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+")
STEM = re.compile(f"[{LETTERS}]+")
#: Ends the last token of each part.
PART_END = "</w>"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Memory(dict[str, bytes]):
    """The last one or two generations of what was used."""

    def __init__(self):
        super().__init__()
        self._before: dict[str, bytes] = {}

    def missing(self, parts: set[str]) -> set[str]:
        """Which of these are not known; those that are stay."""
        if len(self) + len(parts) > PARTS_KEPT:
            self._before = dict(self)
            self.clear()
        parts, before = parts.difference(self), self._before
        if not before:
            return parts
        again = {part: before[part] for part in parts if part in before}
        self.update(again)
        return parts.difference(again)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer lowers case, drops white space and cuts what is left into parts, across
    which it merges nothing; so a text's ids are those of its parts in order. Text of
    plain characters is cut here by the same rule, other words stay whole. Parts that are
    new in a call are encoded together and remembered. Texts with a character that only
    Python takes for white space are encoded whole.
    """

    def __init__(self, path: str | None = None):
        self._tokenizer = Tokenizer.from_file(path or default_path())
        self._known = Memory()
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(PART_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, parts: set[str]) -> None:
        stems = [part for part in parts if STEM.fullmatch(part)]
        if stems:
            ids = self._ids(" ".join(stems))
            ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(ends) != len(stems):
                raise ValueError("the tokenizer does not end each part with a marked token")
            data, starts = ids.tobytes(), [0, *ends]
            self._known.update(zip(stems, [data[a:b] for a, b in zip(starts, ends)]))
        for part in parts.difference(stems):
            self._known[part] = self.whole(part)

    @staticmethod
    def _parts(text: str) -> list[str]:
        if PLAIN.issuperset(text):
            return PARTS.findall(text.lower())
        found: list[str] = []
        for word in text.split():
            if PLAIN.issuperset(word):
                found += PARTS.findall(word.lower())
            else:
                found.append(word)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(c in text for c in NO_BREAKS) else self._parts(text) for text in texts]
        new: set[str] = set()
        for parts in cut:
            new.update(parts or ())
        new = self._known.missing(new)
        self._learn(new)
        ids_of = self._known.__getitem__
        out = [
            self.whole(text) if parts is None else b"".join(map(ids_of, parts))
            for text, parts in zip(texts, cut)
        ]
        for part in [part for part in new if len(part) > LONGEST_KEPT]:
            del self._known[part]
        return out


@cache
def encoder(path: str | None = None) -> WordEncoder:
    """The worker's own encoder: later tasks go on with the parts it knows."""
    return WordEncoder(path)
