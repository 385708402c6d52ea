"""Cuckoo filters over 16-byte keys: membership with insertion and deletion."""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
_TRIES = 500
_HEAD = struct.Struct("<4sIQ")
_MAGIC = b"TFC1"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key that was inserted is always found; another
    is found by chance about once in 8,000. Only keys that were inserted may be deleted."""

    def __init__(self, buckets: int, table: np.ndarray | None = None, count: int = 0) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.mask, self.count = buckets - 1, count
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for so many keys at a load of four fifths at most."""
        return cls(1 << max(4, (max(1, keys) * 5 // (4 * SLOTS)).bit_length()))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        out = cls.sized(len(keys))
        while not all(map(out.insert, keys)):
            out = cls(2 * (out.mask + 1))
        return out

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[4:6], "little") or 1
        first = int.from_bytes(key[8:16], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 >> 3) & self.mask

    def insert(self, key: bytes) -> bool:
        """False if there was no room; the filter must then be built anew, larger."""
        print_, first, second = self._places(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                self.count += 1
                return True
        bucket = second
        for k in range(_TRIES):
            slot = (print_ + k) % SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = self._other(bucket, print_)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                self.count += 1
                return True
        return False

    def delete(self, key: bytes) -> bool:
        print_, first, second = self._places(key)
        for bucket in (first, second):
            found = np.flatnonzero(self.table[bucket] == print_)
            if len(found):
                self.table[bucket, found[0]] = 0
                self.count -= 1
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        print_, first, second = self._places(key)
        return bool((self.table[first] == print_).any() or (self.table[second] == print_).any())

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, self.mask + 1, self.count) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        magic, buckets, count = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a cuckoo filter")
        return cls(buckets, np.frombuffer(raw, "<u2", buckets * SLOTS, _HEAD.size).reshape(buckets, SLOTS).astype(np.uint16), count)
