"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in half until a leaf is short; leaves are encoded on their own.
Two neighbours are joined by re-encoding a window around the cut that grows,
by doubling, until both of its ends are *stable*. A position is stable when it
stands before a space or line feed and after a character that is no white
space: no match of the pre-tokenizer holds white space after other
characters, and none looks behind its start, so one match always ends and
another begins there, whatever stands farther off. Tokens outside such a
window are therefore those of the whole text. If no stable position is found
the window grows to the whole of both halves, which is the definition itself.

Nulls encode as the empty text; the empty text has no tokens.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from pagegrain.llm.common import map_columns

LEAF_CHARS = 1024
LEAF_IDS = 8192
FIRST_WINDOW = 32
#: Bytes of texts or ids that a task works on at once.
SLICE_BYTES = 1 << 20


@lru_cache(maxsize=4)
def load(vocab_path: str, pattern: str):
    """The vocabulary's encoder, once per process. ``vocab_path``: a file of
    base64 tokens and ranks, at the same place on every executor."""
    import tiktoken

    with open(vocab_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class TokenTree:
    """Encodes and decodes by joining halves."""

    def __init__(self, vocab_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> None:
        self.bpe = load(vocab_path, pattern)
        self.leaf_chars = max(1, leaf_chars)

    def leaf(self, text: str) -> np.ndarray:
        """Ids of a short text or of a join's window."""
        if not text:
            return np.empty(0, np.uint32)
        return np.asarray(self.bpe.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf_chars:
            return self.leaf(text[lo:hi])
        cut = (lo + hi) // 2
        return self.join(text, lo, cut, hi, self._span(text, lo, cut), self._span(text, cut, hi))

    def join(self, text: str, lo: int, cut: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[lo:hi] from those of text[lo:cut] and text[cut:hi]."""
        start, end = stable_before(text, lo, cut), stable_after(text, cut, hi)
        if start == cut or lo == cut or cut == hi:
            return np.concatenate((left, right))
        out = len(self.leaf(text[start:cut]))
        off = len(self.leaf(text[cut:end]))
        return np.concatenate((left[: len(left) - out], self.leaf(text[start:end]), right[off:]))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: those of the halves, concatenated."""
        if len(ids) <= LEAF_IDS:
            return self.bpe.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def is_stable(text: str, at: int) -> bool:
    return text[at] in " \n" and not text[at - 1].isspace()


def stable_before(text: str, lo: int, cut: int) -> int:
    """The last stable position in (lo, cut], or lo."""
    width, top = FIRST_WINDOW, cut
    while top > lo:
        bottom = max(lo, cut - width)
        for at in range(top, bottom, -1):
            if at < len(text) and is_stable(text, at):
                return at
        top, width = bottom, width * 2
    return lo


def stable_after(text: str, cut: int, hi: int) -> int:
    """The first stable position in (cut, hi), or hi."""
    width, bottom = FIRST_WINDOW, cut + 1
    while bottom < hi:
        top = min(hi, cut + width)
        for at in range(bottom, top):
            if is_stable(text, at):
                return at
        bottom, width = top, width * 2
    return hi


def encode_texts(df: DataFrame, vocab_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds ``out``: the ids as little-endian unsigned 32-bit integers, packed.

    Every row is encoded whole. Null texts get an empty value; an input column
    named ``out`` is replaced.
    """

    def make():
        tree = TokenTree(vocab_path, pattern)

        def work(texts: pa.Array):
            return [pa.array([tree.encode(x or "").astype("<u4").tobytes() for x in texts.to_pylist()], pa.binary())]

        return work

    return map_columns(df, [text], [(out, BinaryType(), pa.binary())], make, weigh=text, most=SLICE_BYTES)


def decode_ids(df: DataFrame, vocab_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that packed ids stand for. Null ids give none."""

    def make():
        tree = TokenTree(vocab_path, pattern)

        def work(packed: pa.Array):
            return [pa.array([tree.decode(np.frombuffer(x or b"", "<u4")) for x in packed.to_pylist()], pa.binary())]

        return work

    return map_columns(df, [ids], [(out, BinaryType(), pa.binary())], make, weigh=ids, most=SLICE_BYTES)
