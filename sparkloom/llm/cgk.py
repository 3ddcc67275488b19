"""Randomised edit embedding: shared random walks over characters.

A walk reads one character a step and writes it; a random bit shared by all walks, chosen by the step and the character,
says whether to move on. Two strings at edit distance k so get embeddings at Hamming distance O(k^2) with constant
probability: after an edit the walks drift until they meet, and go on together. A band is a sample of the steps, folded
into one word; near strings agree in some bands. All walks of a batch take their steps together, as arrays.
"""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import BASE, gram_hash, mix64, random_words, sliding_min

U = np.uint64
PAD = np.uint8(3)


def walk_starts(codes: np.ndarray, off: np.ndarray, gram: int, spacing: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where walks begin, and the text of each: the start of every text that isn't empty, and the leftmost smallest
    gram of each run of ``spacing`` grams. Places depend on the characters around them only."""
    texts = np.flatnonzero(np.diff(off) > 0)
    found = [off[texts]]
    step, reach = 1 << 17, gram + spacing - 1
    late = np.maximum(off[:-1], off[1:] - reach + 1)  # from here on, a run would leave the text
    for a in range(0, len(codes) - reach + 1, step):
        part = codes[a : a + step + reach - 1].astype(U)
        keys = mix64(gram_hash(part + U(1), gram))
        low = sliding_min((keys & ~U(0xFFFFF)) | np.arange(len(keys), dtype=U), spacing) & U(0xFFFFF)
        ok = np.ones(len(low), bool)
        i, j = np.searchsorted(off[1:], a, "right"), np.searchsorted(late, a + len(low), "left")
        for s, e in zip(np.maximum(late[i:j] - a, 0).tolist(), (off[i + 1 : j + 1] - a).tolist(), strict=True):
            ok[s:e] = False
        found.append(np.unique(low[ok]).astype(np.int64) + a)
    at = np.unique(np.concatenate(found))
    return at, np.searchsorted(off, at, "right") - 1


class Walks:
    """``bands`` bands of ``sample`` steps each, of walks of ``steps`` steps; fixed by the seed. Sure walks move on after
    every second step at least, so they read steps / 2 characters or more, and deal all steps to the bands."""

    def __init__(self, steps: int = 64, bands: int = 6, sample: int = 12, seed: int = 11, sure: bool = True):
        words = random_words(seed, steps * 256).reshape(steps, 256)
        self.move = (words >> U(17) & U(1)).astype(np.int64)
        if sure:
            if bands * sample < steps:
                raise ValueError("too few samples to have every step in a band")
            self.move[1::2] = 1
        order = np.argsort(random_words(seed + 1, bands * steps).reshape(bands, steps), axis=1)[:, :sample]
        if sure:
            order = np.resize(np.argsort(random_words(seed + 1, steps)), (bands, sample))
        self.in_band = np.zeros((steps, bands), bool)
        for b in range(bands):
            self.in_band[order[b], b] = True
        self.steps, self.bands = steps, bands

    def keys(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The band words of the walks that begin at starts, a column for each band. A walk sees the low eight bits of a
        character, and a pad beyond the end."""
        out = np.empty((len(starts), self.bands), U)
        low = codes.astype(np.uint8)
        inside = starts + self.steps <= ends
        for near_end in (False, True):
            chosen = np.flatnonzero(inside != near_end)
            for a in range(0, len(chosen), 1 << 15):
                part = chosen[a : a + (1 << 15)]
                out[part] = self._walk(low, starts[part], ends[part], near_end)
        return out

    def _walk(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, near_end: bool) -> np.ndarray:
        at = starts.astype(np.int64)
        words = np.empty((self.bands, len(at)), U)
        words[:] = np.arange(1, self.bands + 1, dtype=U)[:, None]
        for j in range(self.steps):
            if near_end:
                c = np.where(at < ends, low.take(at, mode="clip"), PAD)
            else:
                c = low.take(at)
            for b in np.flatnonzero(self.in_band[j]):
                words[b] *= U(BASE)
                words[b] += c
            at += self.move[j].take(c)
            if near_end:
                np.minimum(at, ends, out=at)
        return mix64(words).T


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off
