"""Vectorised byte and word kernels shared by the operators (numpy only, no Spark).

A batch of texts is one byte buffer plus document offsets. A word of at most 16 bytes is two numbers of 8 bytes each, from
which its hash is made; a longer one goes through BLAKE2b. Sequences of values are hashed by joining neighbours' hashes in
pairs, pairs of pairs and so on, with a shift that mixes high bits into low ones at each join, so no family of strings
(such as those that fool sums of powers modulo 2**64) has equal hashes by construction. Where equality must be certain,
operators compare bytes or 128-bit digests.

Texts longer than `PIECE` bytes are taken in overlapping stretches, so what a kernel holds beside the text is bounded.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
U64 = np.uint64
_M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
PIECE = 1 << 20

#: `[^\x20\x09-\x0D]+`
WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z have been lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The first so many bytes of a number.
MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of (a, b) from theirs."""
    x = a ^ (a >> U64(32))
    x *= _M1
    x += b
    x ^= x >> U64(29)
    x *= _M2
    return x


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, by doubling."""
    n = len(values) - k + 1
    if n < 1:
        return np.empty(0, U64)
    out, covered, power, size = None, 0, values, 1
    while True:
        if k & size:
            out = power[covered : covered + n] if out is None else join(out, power[covered : covered + n])
            covered += size
        if 2 * size > k:
            return mix(out + U64(k))
        power = join(power[:-size], power[size:])
        size *= 2


def eights(buf: np.ndarray) -> np.ndarray:
    """Each place's next 8 bytes as one number; zeros follow the end, up to 8 places beyond."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    return np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive bytes."""
    n = len(buf) - k + 1
    if n < 1:
        return np.empty(0, U64)
    eight = eights(buf)
    out = eight[:n] & MASK[min(k, 8)]
    for at in range(8, k, 8):
        out = join(out, eight[at : at + n] & MASK[min(k - at, 8)])
    return mix(out + U64(k))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    eight = eights(buf)
    low = eight[start] & MASK[np.minimum(n, 8)]
    high = eight[start + 8 * (n > 8)] & MASK[np.clip(n - 8, 0, 8)]
    out = mix(join(mix(low), high) + n.astype(U64))
    long = np.flatnonzero(n > 16)
    out[long] = [int.from_bytes(hashlib.blake2b(buf[a:b], digest_size=8).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(x) < w:
        return np.empty(0, x.dtype)
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def pack(texts) -> tuple[np.ndarray, np.ndarray]:
    """Arrow strings (null: empty) as one byte buffer and len + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1] or b"", np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    body = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: workers are kept and would hold on to their peaks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def parts(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges [a, b) of documents of about `most` bytes each; a longer document stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes within one document, and each document's first word (n + 1)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    w = member[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[at] = w[at]
    end = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[end] = w[end]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, offsets)


def stretches(text: np.ndarray, member: np.ndarray, overlap: int):
    """Words of one text, a stretch of about PIECE bytes at a time: (number of the stretch's first word, its starts, its ends, from, to).

    Starts and ends count from byte `from` of the text. A stretch begins with the last `overlap` words of the one before, and goes on until it has more than so many.
    """
    at, number, size = 0, 0, len(text)
    while True:
        stop, step = at, PIECE
        while True:
            stop = min(size, stop + step)
            while stop < size and member[text[stop]] and member[text[stop - 1]]:  # not within a word
                near = np.flatnonzero(~member[text[stop : stop + PIECE]])
                stop = stop + int(near[0]) if len(near) else min(size, stop + PIECE)
            start, end, _ = words(text[at:stop], np.array([0, stop - at]), member)
            if stop == size or len(start) > overlap:
                break
            step = stop - at
        yield number, start, end, at, stop
        if stop == size:
            return
        number += len(start) - overlap
        at += int(start[len(start) - overlap]) if overlap else stop - at


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the n places covered by [s, s + length) for any s."""
    if not len(starts):
        return np.zeros(n, bool)
    s = np.unique(starts)
    apart = np.flatnonzero(np.diff(s) > length)
    edge = np.zeros(n + 1, np.int8)
    edge[s[np.concatenate(([0], apart + 1))]] = 1
    edge[np.minimum(s[np.concatenate((apart, [len(s) - 1]))] + length, n)] -= 1
    return np.cumsum(edge[:n], dtype=np.int8).view(bool)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these lengths laid out one after the other: each place's item and its place in the item."""
    total = int(lengths.sum())
    item = np.repeat(np.arange(len(lengths)), lengths)
    return item, np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
