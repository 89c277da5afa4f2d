"""Vectorised hashing of texts: rolling polynomial hashes over whole Arrow batches with numpy.

All hashes are 64-bit polynomials over a table of random byte values, modulo 2**64 with an odd base,
followed by a bit mixer.  Texts are handled as UTF-8 bytes in blocks of about a megabyte, so memory
follows the longest single text, not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 20
STRETCH_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE)) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lean(run):
    """A pass over Arrow batches that hands the memory it freed back to the system at its end: Spark keeps a
    worker for later tasks, and the allocators would keep the pages for as long."""

    @functools.wraps(run)
    def inner(*args, **kwargs):
        try:
            yield from run(*args, **kwargs)
        finally:
            Powers.up = Powers.down = np.ones(1, U)
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return inner


class Powers:
    """Powers of the base and of its inverse, grown on demand and kept until a ``lean`` pass ends."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=U))
        return cls.up, cls.down


class Rolling:
    """Hash of any substring of a byte array in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = Powers.get(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] + U(k))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column (null as empty)."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def _hashes_apart(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that follow each other, a stretch of bytes at a time: the tables of ``Rolling`` are as
    long as the stretch or the longest span, not the text."""
    out, at = np.empty(len(start), U), 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + STRETCH_BYTES, side="right")))
        out[at:to] = Rolling(BYTE_VALUES[raw[low : int(end[to - 1])]]).spans(start[at:to] - low, end[at:to] - low)
        at = to
    return out


def spans_of_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
    """Words are runs of bytes for which ``inside`` holds, within a row.  Their hashes, for each row
    the index of its first word (one more entry at the end), and the words' first and end bytes."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64), none, none
    raw = _LOWER[raw] if lower else raw
    word = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[offsets < len(raw)]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes_apart(raw, start, end), np.searchsorted(start, offsets), start, end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each blank-separated word, and for each row the index of its first (and the end)."""
    return spans_of_words(raw, offsets, ~_SPACE, lower)[:2]


_STEP = [U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes (k up to 10)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += mix(words[j : j + n] + _STEP[j]) * _STEP[j]
    return mix(total)


def shingle_of(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes, as ``shingles`` gives it."""
    total = np.zeros(len(grams), U)
    for j in range(grams.shape[1]):
        total += mix(grams[:, j] + _STEP[j]) * _STEP[j]
    return mix(total)


def text_hash(words: np.ndarray) -> int:
    """Order-sensitive hash of a whole word sequence."""
    if not len(words):
        return 0
    up, _ = Powers.get(len(words))
    return int(mix(np.array([np.sum(mix(words) * up[: len(words)], dtype=U) + U(len(words))], U))[0])


def text_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``text_hash`` of each of the texts whose words begin at ``first`` (one more entry at the end)."""
    sizes = np.diff(first)
    out, full = np.zeros(len(sizes), U), np.flatnonzero(sizes)
    if len(full):
        up, _ = Powers.get(int(sizes.max()))
        inner = np.arange(len(words)) - np.repeat(first[:-1], sizes)
        out[full] = mix(np.add.reduceat(mix(words) * up[inner], first[full]) + sizes[full].astype(U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(batches, key: str) -> Iterator[dict[str, np.ndarray]]:
    """Arrow batches sorted by ``key`` as numpy columns, cut so that a key's rows come together."""
    rest: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
        if part[key][0] == part[key][-1] and rest and rest[0][key][0] == part[key][0]:
            rest.append(part)
            continue
        have = {k: np.concatenate([x[k] for x in rest] + [part[k]]) for k in part}
        cut = int(np.searchsorted(have[key], have[key][-1], side="left"))
        if cut:
            yield {k: v[:cut] for k, v in have.items()}
        rest = [{k: v[cut:] for k, v in have.items()}]
    if rest:
        yield {k: np.concatenate([x[k] for x in rest]) for k in rest[0]}


def rightmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its smallest, the last one among equals."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    low = U((1 << 24) - 1)
    out = []
    step = (1 << 23) - width
    for at in range(0, n - width + 1, step):
        part = values[at : at + step + width - 1]
        key = (part & ~low) | (low - np.arange(len(part), dtype=U))
        have = 1
        while have * 2 <= width:
            key = np.minimum(key[: len(key) - have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        out.append((low - (key & low)).astype(np.int64) + at)
    return np.concatenate(out)
