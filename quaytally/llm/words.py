"""Words of many texts as numbers, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quaytally.llm.common import hash64, mixed

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that are taken eight at a time; the rest of a longer word is hashed by itself.
_LANED = 64


@dataclass
class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, one text after another."""

    joined: bytes
    start: np.ndarray  # first byte of a word
    end: np.ndarray  # byte after it
    size: np.ndarray  # words by text
    code: np.ndarray  # 64-bit hash of a word

    @property
    def first(self) -> np.ndarray:
        """The first word of each text."""
        return np.cumsum(self.size) - self.size

    @property
    def second(self) -> np.ndarray:
        """Another 64-bit hash of each word, independent of `code`."""
        return _codes(self.joined, self.start, self.end - self.start, 0x2545F4914F6CDD1D)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.size)), self.size)


def words_of(raws: list[bytes], lower: bool = False) -> Words:
    """The words of the texts; `lower` turns A-Z to a-z first."""
    joined = b" ".join(raws) + b" " * 9
    if lower:
        joined = joined.lower()
    flat = np.frombuffer(joined, np.uint8)
    space = _SPACE[flat]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not space[0]:
        start = np.concatenate([np.zeros(1, np.int64), start])
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    borders = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return Words(joined, start, end, np.diff(np.searchsorted(start, borders)), _codes(joined, start, end - start))


def _codes(joined: bytes, start: np.ndarray, length: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each word: eight bytes at a time are mixed in, so equal hashes of different words are chance."""
    lanes = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    code = mixed(lanes[start] & _MASKS[np.minimum(length, 8)], length.astype(np.uint64), salt)
    more, at = np.flatnonzero(length > 8), 8
    while more.size and at < _LANED:
        left = length[more] - at
        code[more] = mixed(code[more], lanes[start[more] + at] & _MASKS[np.minimum(left, 8)], salt)
        more, at = more[left > 8], at + 8
    if more.size:
        rest = np.array([hash64(joined[s + at : s + n] + b" " * bool(salt)) for s, n in zip(start[more].tolist(), length[more].tolist())], np.uint64)
        code[more] = mixed(code[more], rest)
    return code
