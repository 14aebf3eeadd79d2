"""Words and word n-grams as 64-bit hashes, computed on whole Arrow batches with numpy.

Spark normalises the text (`normalised`): lower case, every run of characters
that are neither letters, marks nor digits becomes one space.  What is left is
hashed here straight from the Arrow buffers, without a Python object per word.
Equal words and equal n-grams always hash alike; two different ones collide
with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text hashed at once; bounds the temporary arrays (about 40 bytes each).
PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_LIBC = ctypes.CDLL(None)
_given = [0.0]


def give_back(now: bool = False) -> None:
    """Returns freed memory to the system, at most a few times a second unless `now`: Spark keeps Python workers, and what they hold counts against the executor."""
    t = time.monotonic()
    if now or t - _given[0] > 0.3:
        _given[0] = t
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


def normalised(text: Column) -> Column:
    """Lower-case words of `text` with single spaces between; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a bijection on 64 bits)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the normalised texts, and where each text's words start (one more than rows)."""
    raw, offsets = buffers(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = np.flatnonzero(raw == 32)
    filled = offsets[:-1] < offsets[1:]
    flag = np.zeros(len(raw) + 1, bool)
    flag[space + 1] = True
    flag[offsets[:-1][filled]] = True
    starts = np.flatnonzero(flag)
    flag[:] = False
    flag[space] = True
    flag[offsets[1:][filled]] = True
    ends = np.flatnonzero(flag)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        out[at:to] = _hash_spans(raw, starts[at:to], ends[at:to])
        at = to
    return out, np.searchsorted(starts, offsets)


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lo, hi = starts[0], ends[-1]
    piece = _BYTE[raw[lo:hi]]
    length = np.diff(np.append(starts, hi))
    place = np.arange(hi - lo) - np.repeat(starts - lo, length)
    powers = np.cumprod(np.full(int(length.max()) + 1, _BASE))
    piece *= powers[place]
    piece[raw[lo:hi] == 32] = 0
    return mix(np.add.reduceat(piece, starts - lo))


def grams(word: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, in order, and where each text's begin.

    A text of fewer than n words, but at least one, has one gram: all its words.
    """
    count = np.diff(start)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(have)))
    first = np.repeat(start[:-1], have) + (np.arange(at[-1]) - np.repeat(at[:-1], have))
    padded = np.concatenate((word, np.zeros(n, np.uint64)))
    short = np.repeat(count, have) < n
    h = np.zeros(at[-1], np.uint64)
    left = np.repeat(start[1:], have) - first
    for k in range(n):
        part = padded[first + k] * _SLOT[k]
        if short.any():
            part[short & (left <= k)] = 0
        h += part
    return mix(h + np.uint64(n)), at


def distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and where each text's begin."""
    out, size = [], np.zeros(len(at) - 1, np.int64)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            s = np.sort(h[a:b])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
            size[k] = len(out[-1])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(size)))


def winnowed(h: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of every `span` neighbouring ones of a text (of all, if it has fewer), and the text of each.

    Texts with `span` equal neighbouring hashes have their least in common; least
    hashes that follow each other are given once, but may come again later.
    """
    filled = np.flatnonzero(np.diff(at))
    if not len(filled):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, size = h, 1
    while size < span and len(low):
        step = min(size, span - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
    within = np.arange(len(low)) + span <= at[text + 1]
    low, text = low[within], text[within]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < span))
    least = np.minimum.reduceat(h, at[filled])[np.searchsorted(filled, short)]
    return np.concatenate((low[new], least)), np.concatenate((text[new], short))


def pieces(batch: pa.RecordBatch, column: str = "norm", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least; bounds what hashing holds."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def pack(*arrays: np.ndarray) -> bytes:
    """Integers as compressed byte planes, their numbers ahead."""
    size = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    plane = b"".join(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return size.tobytes() + (pa.Codec("zstd", compression_level=1).compress(plane, asbytes=True) if plane else b"")


def unpack(body: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    total = int(sizes.sum()) * 8
    raw = np.frombuffer(pa.Codec("zstd").decompress(body[8 * (n + 1) :], total), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for s in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 8 * s].reshape(8, s).T).reshape(-1).view(np.uint64) if s else np.zeros(0, np.uint64))
        at += 8 * s
    return out
