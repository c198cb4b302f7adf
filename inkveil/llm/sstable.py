"""A sorted string table: one immutable shard file of a keyed store.

Layout: data blocks, Bloom filter, block index, footer.

* A data block holds entries in key order.  An entry stores how many bytes its
  key shares with the one before, the rest of the key and its value; every 16th
  entry is a restart with its whole key.  Blocks end with their restart offsets
  and are compressed with Zstandard; a CRC-32 of the stored bytes follows.
* The sparse index has the first key, place and size of each block.
* The Bloom filter has 10 bits and 7 probes a key.
* The footer has the places of filter and index, counts, and a magic number.

A lookup reads footer, filter and index once, rejects most absent keys by the
filter, finds the block by binary search in the index and the entry by binary
search among the block's restarts.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 1 << 18
RESTART_EVERY = 16
BLOOM_BITS, BLOOM_PROBES = 10, 7


def id_key(doc_id: int | None, ordinal: int = 0) -> bytes:
    """Sorts as the identifiers do, null first; the ordinal parts repeated ones."""
    if doc_id is None:
        return b"\x00" + struct.pack(">I", ordinal)
    return b"\x01" + struct.pack(">QI", doc_id + (1 << 63), ordinal)


def key_id(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _key_hashes(key: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    return struct.unpack("<QQ", h)


class Writer:
    """Writes entries that come in key order to a binary stream."""

    def __init__(self, stream):
        self.stream, self.at, self.entries, self.units = stream, 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[tuple[int, int]] = []
        self.pack = zstandard.ZstdCompressor(level=1)
        self.first = self.last = None
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.count, self.before, self.block_first = bytearray(), [], 0, b"", None

    def add(self, key: bytes, value: bytes, units: int = 0) -> None:
        if self.last is not None and key <= self.last:
            raise ValueError("keys must come in strictly ascending order")
        if self.block_first is None:
            self.block_first = key
        shared = 0
        if self.count % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.before))
            while shared < most and key[shared] == self.before[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before = self.last = key
        self.first = key if self.first is None else self.first
        self.count += 1
        self.entries += 1
        self.units += units
        self.hashes.append(_key_hashes(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if not self.count:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        data = self.pack.compress(raw)
        place, size = self._put(data + struct.pack("<I", zlib.crc32(data)))
        self.index.append((self.block_first, place, size))
        self._start()

    def close(self) -> None:
        self._flush()
        bits = max(64, self.entries * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for a, b in self.hashes:
            for k in range(BLOOM_PROBES):
                p = (a + k * b) % bits
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at, _ = self._put(struct.pack("<Q", bits) + bloom.tobytes())
        body = b"".join(_varint(len(k)) + k + struct.pack("<QQ", place, size) for k, place, size in self.index)
        index_at, _ = self._put(body)
        self._put(FOOTER.pack(bloom_at, index_at, len(body), len(self.index), self.entries, self.units, MAGIC))


class Reader:
    """Reads a table from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        self.bloom_at, index_at, index_size, blocks, self.entries, self.units, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted string table")
        head = self._at(self.bloom_at, index_at - self.bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", head)[0], head[8:]
        body, at = self._at(index_at, index_size), 0
        self.keys, self.places = [], []
        for _ in range(blocks):
            n, at = _read_varint(body, at)
            self.keys.append(body[at : at + n])
            self.places.append(struct.unpack_from("<QQ", body, at + n))
            at += n + 16
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...]]:
        data = self._at(*self.places[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged")
        raw = self.unpack.decompress(data[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw[:end], struct.unpack(f"<{n}I", raw[end:-4])

    @staticmethod
    def _entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def may_hold(self, key: bytes) -> bool:
        a, b = _key_hashes(key)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in ((a + k * b) % self.bits for k in range(BLOOM_PROBES)))

    def get(self, key: bytes) -> bytes | None:
        if not self.may_hold(key):
            return None
        k = bisect.bisect_right(self.keys, key) - 1
        if k < 0:
            return None
        raw, restarts = self._block(k)
        low, high = 0, len(restarts)
        while high - low > 1:
            mid = (low + high) // 2
            if next(self._entries(raw, restarts[mid]))[0] <= key:
                low = mid
            else:
                high = mid
        for found, value in self._entries(raw, restarts[low]):
            if found >= key:
                return value if found == key else None
        return None

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.keys)):
            yield from self._entries(self._block(k)[0])
