"""Hashes of all words of many texts at once, in numpy.

Texts are joined, their bytes weighted by the powers of an odd number and summed up once; the hash of
a word is the difference of two sums, brought to a common power.  No Python object is made for a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

from larder.llm.common import bare

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random weight of each byte value.
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.array([b < 128 and not _SPACE[b] and not chr(b).isalnum() for b in range(256)])
#: Texts with other white space than these bytes are split by Python first; without signs, also those with
#: letters and signs beyond Latin-1.
_GAP = re.compile(rb"[\t-\r ]")
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = re.compile(r"[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")


class WordArrays:
    """Texts -> an array of 64-bit hashes of the words of each.

    Words are runs of non-space characters of the lower-cased text; without ``signs`` they lose all that is
    neither letter nor digit, and vanish if nothing is left.
    """

    def __init__(self, signs: bool = True, block: int = 1 << 20):
        self.signs, self.block = signs, block
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        ones = np.ones(n, dtype=np.uint64)
        self.powers = np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * _P]))
        self.inverses = np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * _P_INVERSE]))

    def _plain(self, text: str | None) -> bytes:
        t = (text or "").lower()
        if self.signs:
            t = " ".join(t.split()) if _ODD_SPACE.search(t) else t
        elif _ODD.search(t):
            t = " ".join(map(bare, t.split()))
        return t.encode("utf-8", "surrogatepass")

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.raw(map(self._plain, texts))

    def raw(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        """The words of texts as they are, neither lower-cased nor stripped; long texts are hashed in pieces cut between words."""
        out, held, size = [], [], 0
        for t in texts:
            if len(t) > self.block:
                out += self._hash(held) if held else []
                held, size = [], 0
                parts, start = [], 0
                while start < len(t):
                    gap = _GAP.search(t, start + self.block)
                    end = gap.start() if gap else len(t)
                    parts += self._hash([t[start:end]])
                    start = end
                out.append(np.concatenate(parts))
                continue
            held.append(t)
            size += len(t) + 1
            if size >= self.block:
                out += self._hash(held)
                held, size = [], 0
        return out + (self._hash(held) if held else [])

    def _hash(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts])
        if not self.signs:
            sign = _SIGN[data]
            if sign.any():
                ends_of = ends_of - np.cumsum(sign)[ends_of - 1]
                data = data[~sign]
        if len(data) > len(self.powers):
            self._grow(1 << (len(data) - 1).bit_length())
        letter = ~_SPACE[data]
        edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
        first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_WEIGHTS[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[after] - sums[first]) * self.inverses[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        cuts = np.searchsorted(first, ends_of)
        return [h[a:b] for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts)]
