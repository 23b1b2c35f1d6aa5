"""Length-delimited binary records and the checksum that frames them.

A record is: length (uint64), masked CRC-32C of those 8 bytes (uint32), payload, masked CRC-32C
of the payload (uint32), all little-endian. The checksums of many records are computed together:
each record is padded in front with zeros to whole blocks, all blocks advance side by side, two
bytes a step, and a record's block sums are then joined by the linear map that skips a block.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np

from corpusmill.llm import _files

_POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
_MASK_DELTA = 0xA282EAD8
_BLOCK = 256
READ = 4 << 20
#: Files that a reader keeps open, and bytes between two records that are still read in one go.
OPEN, GAP = 64, 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    pair = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        pair = step[pair & 0xFF] ^ (pair >> 8)
    skip = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(_BLOCK // 2):
            register = pair[register & 0xFFFF] ^ (register >> 16)
        skip[byte] = register
    return pair, skip


_PAIR, _SKIP = _tables()


def crc32c(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each slice [offsets[i], offsets[i + 1]); slices need 4 bytes at least."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint32)
    if not len(lengths):
        return out
    assert lengths.min() >= 4
    blocks = -(-lengths // _BLOCK)
    ends = np.cumsum(blocks)
    padded = np.zeros(int(ends[-1]) * _BLOCK, np.uint8)
    for i, (end, n) in enumerate(zip((ends * _BLOCK).tolist(), lengths.tolist(), strict=True)):
        padded[end - n : end] = body[offsets[i] : offsets[i + 1]]
    heads = (ends * _BLOCK - lengths)[:, None] + np.arange(4)
    padded[heads] ^= 0xFF
    columns = np.ascontiguousarray(padded.view("<u2").reshape(-1, _BLOCK // 2).T)
    sums = np.zeros(int(ends[-1]), np.uint32)
    for column in columns:
        sums = _PAIR[(sums ^ column) & 0xFFFF] ^ (sums >> 16)
    order = np.argsort(-blocks, kind="stable")
    counts, firsts = blocks[order], (ends - blocks)[order]
    register = np.zeros(len(lengths), np.uint32)
    for step in range(int(counts[0])):
        live = int(np.searchsorted(-counts, -step, "left"))
        r = register[:live]
        r = _SKIP[0][r & 0xFF] ^ _SKIP[1][(r >> 8) & 0xFF] ^ _SKIP[2][(r >> 16) & 0xFF] ^ _SKIP[3][r >> 24]
        register[:live] = r ^ sums[firsts[:live] + step]
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that a checksum of bytes that hold checksums stays strong."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


def frame(body: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The records of these payloads, and their offsets (n + 1)."""
    lengths = np.diff(offsets)
    at = np.concatenate(([0], np.cumsum(lengths + 16)))
    heads = lengths.astype("<u8").view(np.uint8)
    head_sums = masked(crc32c(heads, np.arange(len(lengths) + 1) * 8)).astype("<u4").view(np.uint8)
    sums = masked(crc32c(body, offsets)).astype("<u4").view(np.uint8)
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1, None] + np.arange(8)] = heads.reshape(-1, 8)
    out[at[:-1, None] + np.arange(8, 12)] = head_sums.reshape(-1, 4)
    out[at[1:, None] - np.arange(4, 0, -1)] = sums.reshape(-1, 4)
    for i, (a, n) in enumerate(zip((at[:-1] + 12).tolist(), lengths.tolist(), strict=True)):
        out[a : a + n] = body[offsets[i] : offsets[i + 1]]
    return out.tobytes(), at


def unframe(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All bytes, start and end of each whole record's payload, and the bytes that the whole records take. A wrong checksum raises ValueError."""
    body = np.frombuffer(data, np.uint8)
    starts, ends, at = [], [], 0
    while at + 16 <= len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        if at + 16 + n > len(data):
            break
        starts.append(at + 12)
        ends.append(at + 12 + n)
        at += 16 + n
    a, b = np.array(starts, np.int64), np.array(ends, np.int64)
    if len(a):
        heads = body[(a - 12)[:, None] + np.arange(8)].reshape(-1)
        head_sums = body[(a - 4)[:, None] + np.arange(4)].reshape(-1).view("<u4")
        sums = body[b[:, None] + np.arange(4)].reshape(-1).view("<u4")
        payloads = np.concatenate([body[x:y] for x, y in zip(starts, ends, strict=True)])
        offsets = np.concatenate(([0], np.cumsum(b - a)))
        if (masked(crc32c(heads, np.arange(len(a) + 1) * 8)) != head_sums).any() or (masked(crc32c(payloads, offsets)) != sums).any():
            raise ValueError("a record's checksum is wrong")
    return body, a, b, at


def _size(data: bytes) -> int:
    """Bytes of the record that starts here, by its checked head."""
    if (masked(crc32c(np.frombuffer(data, np.uint8, 8), np.array([0, 8]))) != np.frombuffer(data, "<u4", 1, 8)).any():
        raise ValueError("a record's checksum is wrong")
    return 16 + int.from_bytes(data[:8], "little")


def stream_records(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All bytes, start and end of each payload, of a few records at a time; a long record is read to its end in one go."""
    left = b""
    while True:
        want = READ
        if len(left) >= 12:
            want = max(READ, _size(left) - len(left))
        data = stream.read(want)
        if not data:
            if left:
                raise ValueError("a record file ends within a record")
            return
        left = left + data if left else data
        body, a, b, used = unframe(left)
        if used:
            yield body, a, b
            left = left[used:]


class Files:
    """Record files of a shuffled read, by number."""

    def __init__(self, place: Callable[[int], str]):
        self.place, self.open = place, OrderedDict()

    def __enter__(self) -> Files:
        return self

    def __exit__(self, *_) -> None:
        for file in self.open.values():
            file.close()

    def _file(self, part: int):
        if part in self.open:
            self.open.move_to_end(part)
        else:
            if len(self.open) >= OPEN:
                self.open.popitem(last=False)[1].close()
            fs, path = _files.store(self.place(part))
            self.open[part] = fs.open_input_file(path)
        return self.open[part]

    def fetch(self, part: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The records in the order asked for."""
        order = np.lexsort((at, part))
        p, a, z = part[order], at[order], (at + n)[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (a[1:] > z[:-1] + GAP)
        heads = np.flatnonzero(new)
        out: list[bytes] = [b""] * len(order)
        for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            first, last = int(a[x]), int(z[x:y].max())
            data = memoryview(self._file(int(p[x])).read_at(last - first, first))
            for k in range(x, y):
                out[int(order[k])] = bytes(data[int(a[k]) - first : int(z[k]) - first])
        return out
