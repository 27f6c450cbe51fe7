"""Counting quotient filters: exact counters of packed n-grams, in a few bytes each.

An n-gram of k ids is packed into one number of k * bits bits, which a Feistel
network permutes. The permuted number is cut into a quotient (its upper bits)
and a remainder (all others). Entries lie in ascending order; a bit for each
possible quotient tells whether it occurs, a bit for each entry whether it is
the last of its quotient, and only the remainder is written out, so with the
permutation undone every n-gram comes back exactly. Counters are one byte,
larger ones escape to eight. Sorted filters merge by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ROUNDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Packing:
    """How k ids of ``bits`` bits are packed: two halves, an odd id cut between them.

    Each half has 64 bits at most, so ``bits`` may reach 25 for five ids.
    """

    k: int
    bits: int

    def __post_init__(self) -> None:
        if self.bits < 2 or max(self.left, self.right) > 64:
            raise ValueError(f"{self.k} ids of {self.bits} bits don't fit two halves of 64 bits")

    @property
    def cut(self) -> int:
        """Bits of the middle id that go right."""
        return self.bits // 2 if self.k % 2 else 0

    @property
    def left(self) -> int:
        return self.k * self.bits - self.right

    @property
    def right(self) -> int:
        return self.k // 2 * self.bits + self.cut

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        b, half = np.uint64(self.bits), self.k // 2
        left = np.zeros(len(ids[0]), dtype=np.uint64)
        right = left.copy()
        for x in ids[:half]:
            left = (left << b) | x
        for x in ids[self.k - half:]:
            right = (right << b) | x
        if self.k % 2:
            low = np.uint64(self.cut)
            left = (left << (b - low)) | (ids[half] >> low)
            right |= (ids[half] & ((np.uint64(1) << low) - np.uint64(1))) << np.uint64(half * self.bits)
        return left, right

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        b, half, full = np.uint64(self.bits), self.k // 2, (np.uint64(1) << np.uint64(self.bits)) - np.uint64(1)
        middle = []
        if self.k % 2:
            low = np.uint64(self.cut)
            high = left & ((np.uint64(1) << (b - low)) - np.uint64(1))
            left = left >> (b - low)
            middle = [(high << low) | (right >> np.uint64(half * self.bits))]
        first = [(left >> np.uint64(i * self.bits)) & full for i in reversed(range(half))]
        last = [(right >> np.uint64(i * self.bits)) & full for i in reversed(range(half))]
        return [*first, *middle, *last]

    def _masks(self) -> list[np.uint64]:
        return [np.uint64((1 << n) - 1) for n in (self.left, self.right)]

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same packed numbers, one to one, spread over all their values."""
        lm, rm = self._masks()
        for i in (0, 2):
            left = left ^ (mix(right, _ROUNDS[i]) & lm)
            right = right ^ (mix(left, _ROUNDS[i + 1]) & rm)
        return left, right

    def restore(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Undoes ``permute``."""
        lm, rm = self._masks()
        for i in (2, 0):
            right = right ^ (mix(left, _ROUNDS[i + 1]) & rm)
            left = left ^ (mix(right, _ROUNDS[i]) & lm)
        return left, right


def _sorted(packing: Packing, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple:
    """Distinct entries in ascending order, their counts added."""
    if packing.left + packing.right <= 64:
        whole = (left << np.uint64(packing.right)) | right
        order = np.argsort(whole, kind="stable")  # sorted runs are merged
    else:
        order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    if not len(left):
        return left, right, counts
    at = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return left[at], right[at], np.add.reduceat(counts, at)


@dataclass
class QuotientFilter:
    """Distinct permuted entries in ascending order and their counts.

    ``prefix`` upper bits are the same in all entries (the shard's number).
    """

    packing: Packing
    prefix: int
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    @classmethod
    def count(cls, packing: Packing, ids: list[np.ndarray], prefix: int = 0) -> QuotientFilter:
        """Counts of n-grams given as columns of ids."""
        left, right = packing.permute(*packing.pack(ids))
        return cls(packing, prefix, *_sorted(packing, left, right, np.ones(len(left), dtype=np.int64)))

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        first = filters[0]
        cat = lambda c: np.concatenate([getattr(f, c) for f in filters])
        return cls(first.packing, first.prefix, *_sorted(first.packing, cat("left"), cat("right"), cat("counts")))

    def ids(self) -> list[np.ndarray]:
        return self.packing.unpack(*self.packing.restore(self.left, self.right))

    def where(self, rows: np.ndarray) -> QuotientFilter:
        return QuotientFilter(self.packing, self.prefix, self.left[rows], self.right[rows], self.counts[rows])

    def shards(self, prefix: int) -> list[tuple[int, QuotientFilter]]:
        """(number, filter) of every shard with entries, by the ``prefix`` upper bits."""
        if not len(self.left):
            return []
        number = self.left >> np.uint64(self.packing.left - prefix) if prefix else np.zeros(len(self.left), dtype=np.uint64)
        at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        return [(int(number[a]), QuotientFilter(self.packing, prefix, self.left[a:b], self.right[a:b], self.counts[a:b]))
                for a, b in zip(at, np.append(at[1:], len(number)), strict=True)]

    def to_bytes(self) -> bytes:
        n, p = len(self.left), self.packing
        own = p.left - self.prefix  # bits of the left half that differ
        q = max(0, min(own, n.bit_length()))
        low = np.uint64(own - q)
        head = self.left & np.uint64((1 << own) - 1)
        quotient = (head >> low).astype(np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotient] = True
        last = np.ones(n, dtype=bool)
        last[:-1] = quotient[1:] != quotient[:-1]
        rest = head & ((np.uint64(1) << low) - np.uint64(1))
        planes = [_bytes(rest, own - q), _bytes(self.right, p.right)]
        large = self.counts >= 255
        small = np.where(large, 255, self.counts).astype(np.uint8)
        return b"".join([np.array([n, q, self.left[0] >> np.uint64(own) if self.prefix and n else 0], dtype="<u8").tobytes(),
                         np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), *planes, small.tobytes(),
                         self.counts[large].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes, packing: Packing, prefix: int = 0) -> QuotientFilter:
        n, q, number = map(int, np.frombuffer(data, dtype="<u8", count=3))
        own, at = packing.left - prefix, 24

        def take(size: int, kind: str = "u1") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=size, offset=at)
            at += out.nbytes
            return out

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
        last = np.unpackbits(take(-(-n // 8)), count=n).astype(np.int64)
        quotient = occupied[np.cumsum(last) - last].astype(np.uint64) if n else np.zeros(0, dtype=np.uint64)
        rest = _numbers(take(n * -(-(own - q) // 8)), n)
        right = _numbers(take(n * -(-packing.right // 8)), n)
        counts = take(n).astype(np.int64)
        large = counts == 255
        counts[large] = take(int(large.sum()), "<i8")
        left = (quotient << np.uint64(own - q)) | rest
        if prefix:
            left |= np.uint64(number << own)
        return cls(packing, prefix, left, right, counts)


def _bytes(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of the numbers, in whole bytes, one plane after another."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].T).tobytes()


def _numbers(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = data.reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()
