"""Whole Arrow batches of texts split into words and hashed with array operations.

A text column of an Arrow batch is one byte buffer and an offset array, so word boundaries and
64-bit word hashes of all its texts come from a few passes over the buffer; no text is decoded.
A word's hash is a polynomial in a random table of byte values modulo 2**64, then mixed. Hashes of
runs of words are polynomials in the words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RUN = 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 20  # bytes whose words are hashed at once, unless one text is longer


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordSplitter:
    """Words are maximal runs of the bytes in `word_bytes`, compared with A-Z in lower case."""

    def __init__(self, word_bytes: np.ndarray):
        self.is_word = np.zeros(256, dtype=bool)
        self.is_word[word_bytes] = True
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)
        self.value = mix(folded * np.uint64(_RUN) + np.uint64(1))
        self.power = _powers(_BASE, _BLOCK)
        self.inverse = _powers(_BASE_INV, _BLOCK)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            self.power, self.inverse = _powers(_BASE, n), _powers(_BASE_INV, n)

    def split(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in `data`, and the first word of each text; texts are
        data[cuts[i]:cuts[i + 1]] and no word goes across a cut."""
        inside = self.is_word[data]
        edge = np.empty(len(data), dtype=bool)
        if len(data):
            edge[0] = inside[0]
            np.logical_and(inside[1:], ~inside[:-1], out=edge[1:])
            at = cuts[(cuts < len(data))]
            edge[at] = inside[at]
        starts = np.flatnonzero(edge)
        if len(data):
            edge[-1] = inside[-1]
            np.logical_and(inside[:-1], ~inside[1:], out=edge[:-1])
            at = cuts[cuts > 0] - 1
            edge[at] = inside[at]
        ends = np.flatnonzero(edge) + 1
        return starts, ends, np.searchsorted(starts, cuts)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) <= _BLOCK:
            return self._hashes(data, starts, ends)
        # A long text is hashed piece by piece, cut between words.
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
            lo = starts[i]
            out.append(self._hashes(data[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo))
            i = j
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(self.value[data] * self.power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def batches(self, texts: pa.Array):
        """Blocks of consecutive texts: (index of the first text, bytes, cuts, word starts, word
        ends, first word of each text, word hashes). A null text has no words."""
        data, cuts = text_bytes(texts)
        i, n = 0, len(cuts) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + _BLOCK, side="right")) - 1)
            block = data[cuts[i] : cuts[j]]
            own = cuts[i : j + 1] - cuts[i]
            starts, ends, first = self.split(block, own)
            yield i, block, own, starts, ends, first, self.hashes(block, starts, ends)
            i = j


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end of the last. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
        wide = True
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1 + len(texts), dtype=np.int64)
    cuts = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries of `words`; n is part of the hash."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_RUN)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def runs_per_text(words: np.ndarray, first: np.ndarray, n: int):
    """Hashes of the n-word runs inside each text; of a shorter one, that of the whole text.

    Yields one array per text, with repeats, in order of place.
    """
    long_runs = run_hashes(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield long_runs[a : b - n + 1]
        elif b > a:
            yield run_hashes(words[a:b], b - a)
        else:
            yield words[:0]


_SPACES = [0x20, *range(0x09, 0x0E)]


def nonspace_words() -> WordSplitter:
    """Words are runs of anything but space and the characters 9 to 13."""
    return WordSplitter(np.setdiff1d(np.arange(256), _SPACES))


def alphanumeric_words() -> WordSplitter:
    """Words are runs of ASCII letters and digits and of everything beyond ASCII."""
    keep = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return WordSplitter(np.array(keep))
