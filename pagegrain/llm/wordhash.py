"""Hashes of the words of a text, for whole arrays at once.

A polynomial prefix sum over the bytes gives the hash of any run of them as a
difference, shifted back to the run's start; all in wrapping 64-bit integers.
Words are runs of ASCII letters and digits and of non-ASCII bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; texts are cut between words, longer words are parted.
CHUNK = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
_WORD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[128:] = True


def _powers(base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(CHUNK, base, np.uint64))))


_UP, _DOWN = _powers(_BASE), _powers(_UNBASE)


class Words:
    """The words of at most CHUNK bytes: starts, ends and run hashes."""

    def __init__(self, data: np.ndarray) -> None:
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _WORD[data]
        edge = np.flatnonzero(np.diff(inside))
        self.start, self.end = edge[::2], edge[1::2]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=self._sums[1:])
        self._base, self._back = self._sums[self.start], _DOWN[self.start] * _MIX

    def hashes(self, stop: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """Hashes from each word's start up to ``stop`` (its end)."""
        h = (self._sums[self.end if stop is None else stop] - self._base) * self._back + np.uint64(salt * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h


def chunks(data: bytes) -> Iterator[np.ndarray]:
    """The bytes in runs of at most CHUNK, cut between words where possible."""
    whole = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(whole):
        stop = min(at + CHUNK, len(whole))
        if stop < len(whole):
            gaps = np.flatnonzero(~_WORD[whole[at:stop]])
            stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
        yield whole[at:stop]
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, in order, and each text's count."""
    parts, starts, at = [], [], 0
    for data in chunks(b" ".join(texts)):
        found = Words(data)
        parts.append(found.hashes())
        starts.append(found.start + at)
        at += len(data)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    edges = np.searchsorted(np.concatenate(starts) if starts else np.empty(0, np.int64), begins)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.diff(edges)
