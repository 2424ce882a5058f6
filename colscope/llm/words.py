"""Vectorised 64-bit hashes of the words of whole texts."""

from __future__ import annotations

import re

import numpy as np

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
NOT_WORD = re.compile(r"\W")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Words are runs of letters, digits and underscores of the lower-cased text."""

    def __init__(self):
        self.letters = mix(np.arange(0x110000, dtype=np.uint64) + BASE)
        self.word = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
        self._grow(PIECE + 2)

    def _grow(self, n: int) -> None:
        self.up, self.down = powers(BASE, n), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n)

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) >= len(self.up):
            self._grow(2 * len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.letters[codes] * self.up[:len(codes)], out=sums[1:])
        edge = np.diff(np.concatenate([[False], self.word[codes], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        owner = np.searchsorted(np.cumsum(lens), starts, side="right")
        return hashes, np.bincount(owner, minlength=len(texts))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, one after the other, and the number of each text's words.

        Works through about a million characters at a time, so a very long text costs
        only its words' hashes beyond itself. NULL has no words.
        """
        out, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
        held, owners, chars = [], [], 0

        def flush() -> None:
            nonlocal held, owners, chars
            if held:
                hashes, n = self._piece(held)
                out.append(hashes)
                np.add.at(counts, owners, n)
            held, owners, chars = [], [], 0

        for i, text in enumerate(texts):
            at, text = 0, (text or "").lower()
            while at < len(text):
                end = len(text)
                if end - at > PIECE:
                    cut = NOT_WORD.search(text, at + PIECE)
                    end = cut.start() if cut else end
                if chars + end - at > PIECE:
                    flush()
                held.append(text[at:end]), owners.append(i)
                chars += end - at + 1
                at = end
        flush()
        return np.concatenate(out), counts
