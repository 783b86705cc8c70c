"""Hashes of the words and word shingles of many texts at once, by numpy over their UTF-8 bytes.

A word is a run of other bytes than 0x20 and 0x09 to 0x0D; A-Z count as a-z. A text's set of shingles has the hashes
of its runs of five words, or of all its words in turn if they are fewer; without words it is empty. Hashes have 64
bits and are the same everywhere, so two texts share a shingle where they share its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that one step looks at together, unless a single text has more.
STEP = 1_000_000
SHINGLE = 5

_K = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 0x20
_LOWER += 1  # no byte counts as nothing
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """K^i and K^-i modulo 2^64 for i under n."""
    if len(_POWERS["up"]) < n:
        for name, k in (("up", _K), ("down", pow(_K, -1, 1 << 64))):
            p = np.full(n + n // 4, k, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Spans:
    """Words of texts in turn: where each begins and ends, how many come up to each text's end, and sums to hash them by."""

    starts: np.ndarray
    stops: np.ndarray
    upto: np.ndarray
    sums: np.ndarray

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Of whole words, or of at most their `first` bytes."""
        stops = self.stops if first is None else np.minimum(self.stops, self.starts + first)
        return mixed((self.sums[stops] - self.sums[self.starts]) * _powers(len(self.sums))[1][self.starts])


def word_spans(raw: np.ndarray, ends: np.ndarray, apart: np.ndarray = _SPACE) -> Spans:
    """raw: the bytes of texts in turn; ends: where each ends; apart: which bytes part words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Spans(none, none, np.zeros(len(ends), np.int64), np.zeros(1, np.uint64))
    visible = ~apart[raw]
    begin = visible.copy()
    begin[1:] &= ~visible[:-1]
    firsts = np.concatenate([[0], ends[:-1]])
    firsts = firsts[firsts < n]
    begin[firsts] = visible[firsts]
    starts = np.flatnonzero(begin)
    stop = visible.copy()
    stop[:-1] &= ~visible[1:] | begin[1:]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[raw] * _powers(n + 1)[0][:n], out=sums[1:])
    return Spans(starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, ends), sums)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many words come up to each text's end."""
    spans = word_spans(raw, ends)
    return spans.hashes(), spans.upto


def shingle_hashes(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles in turn (not yet distinct), and how many come up to each text's end."""
    factors = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(ends, prepend=0)
    own = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    out_ends = np.cumsum(own)
    if len(words) >= SHINGLE:
        runs = words[: len(words) - SHINGLE + 1] * factors[0]
        for k in range(1, SHINGLE):
            runs = runs + words[k : len(words) - SHINGLE + 1 + k] * factors[k]
    else:
        runs = np.zeros(0, np.uint64)
    begin = ends - counts
    place = np.repeat(begin - (out_ends - own), own) + np.arange(int(out_ends[-1]) if len(out_ends) else 0)
    whole = np.zeros(len(place), np.uint64)
    fits = place < len(runs)
    whole[fits] = runs[place[fits]]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        w = words[begin[i] : ends[i]]
        whole[out_ends[i] - 1] = np.uint64((int((w * factors[: len(w)]).sum(dtype=np.uint64)) + len(w) * _K) % (1 << 64))
    return mixed(whole), out_ends


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at[1:] - at[0]


def steps(raw: np.ndarray, ends: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first, last + 1, bytes, ends."""
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield at, end, raw[base : int(ends[end - 1])], ends[at:end] - base
        at = end


def text_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    raw, ends = raw_texts(column)
    for _, _, some, own in steps(raw, ends):
        hashes, upto = shingle_hashes(*word_hashes(some, own))
        begin = 0
        for end in upto.tolist():
            x = np.sort(hashes[begin:end])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            yield x
            begin = end
