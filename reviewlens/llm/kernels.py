"""Array functions over the bytes of many texts at once, used inside Arrow tasks.

Texts of a batch lie end to end in one byte array; `offsets` holds their borders. Hashes are
polynomials modulo 2^64 over random values per byte, mixed at the end, so any run of bytes is
hashed by two look-ups in running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 << 10
U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others; new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_MULTIPLIER))


@lru_cache(maxsize=4)
def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    up, down = np.full(size, _MULTIPLIER, U64), np.full(size, inverse, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers_to(max(1 << 16, 1 << max(size, 1).bit_length()))
    return up[:size], down[:size]


class Texts:
    """Some texts as one byte array."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        base = int(offsets[0])
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[base : int(offsets[-1])] if body is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - base
        self.n = len(column)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set bytes in every text."""
        running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return running[self.offsets[1:]] - running[self.offsets[:-1]]

    def is_word(self) -> np.ndarray:
        return ~_SPACE[self.data]

    def word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        word = self.is_word()
        first = np.zeros(len(word) + 1, bool)
        first[self.offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends = word
        ends[:-1] &= ~word[1:] | first[1:-1] if len(word) > 1 else True
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of every line, split at line feeds only."""
        feeds = np.flatnonzero(self.data == 10)
        of, every = self.document_of(feeds), np.arange(self.n)
        begins, begin_of = np.concatenate([self.offsets[:-1], feeds + 1]), np.concatenate([every, of])
        ends, end_of = np.concatenate([feeds, self.offsets[1:]]), np.concatenate([of, every])
        order = np.lexsort((begins, begin_of))
        return begins[order], ends[np.lexsort((ends, end_of))], begin_of[order]

    def running(self) -> np.ndarray:
        """Running polynomial over the bytes, one entry more than bytes."""
        up, _ = _powers(len(self.data))
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE_VALUES[self.data] * up, out=out[1:])
        return out

    def hashes(self, begins: np.ndarray, ends: np.ndarray, running: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of every run of bytes."""
        running = self.running() if running is None else running
        _, down = _powers(len(self.data) + 1)
        return mix((running[ends] - running[begins]) * down[begins] + U64(1))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with about `limit` bytes of text; a longer text is a slice of its own."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    part, longer = (np.cumsum(sizes) - sizes) // limit, sizes > limit
    borders = [0, *(np.flatnonzero((np.diff(part) > 0) | longer[1:] | longer[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b > a:
            piece = batch.slice(a, b - a)
            yield piece, Texts(piece.column(column))
    # A worker lives on after its task: give back what the batch has used.
    pa.default_memory_pool().release_unused()


def grams(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of n items of one text. `of` is sorted."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, of.dtype)
    total = np.zeros(count, U64)
    for k in range(n):
        total = total * U64(_MULTIPLIER) + hashes[k : k + count]
    whole = of[:count] == of[n - 1 :]
    return mix(total[whole]), of[:count][whole]


def first_of_group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of the keys, and where a new key starts in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, new


def with_text(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One key for a hash within a text."""
    return mix(hashes + (of.astype(U64) + U64(1)) * U64(_MULTIPLIER))


def sequence_hashes(items: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Hash of the sequence of items of every text; `of` is sorted."""
    up, down = _powers(len(items) + 1)
    running = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up[:-1], out=running[1:])
    borders = np.searchsorted(of, np.arange(n + 1))
    first, end = borders[:-1], borders[1:]
    return mix((running[end] - running[first]) * down[first] + (end - first).astype(U64))
