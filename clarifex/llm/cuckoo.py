"""A cuckoo filter in numpy: a set of 64-bit hashes that supports deletion, with no false negatives."""

from __future__ import annotations

import numpy as np

from clarifex.llm.common import runs

#: Fingerprints of 16 bits, four to a bucket: false positives stay below 2 * 4 / 65535.
SLOTS, ROUNDS = 4, 500


class CuckooFilter:
    """Each hash has a fingerprint and two buckets, either of which follows from the other and the fingerprint."""

    def __init__(self, buckets: int):
        self.table = np.zeros((max(2, 1 << (max(1, buckets) - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of distinct ``hashes``, at most about 80% full."""
        buckets = max(2, int(len(hashes) / SLOTS / 0.8) + 1)
        while True:
            made = cls(buckets)
            if made.insert(hashes):
                return made
            buckets = len(made.table) * 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _own(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mark = np.maximum((x >> np.uint64(48)).astype(np.uint16), np.uint16(1))  # 0 is a free slot
        return mark, (x & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one = self._own(hashes)
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[self._other(mark, one)] == mark[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Add hashes that are not in the set. False, with the filter unchanged, if there is no room."""
        before = self.table.copy()
        mark, bucket = self._own(hashes)
        mark, bucket = self._place(mark, bucket)
        mark, bucket = self._place(mark, self._other(mark, bucket))
        for turn in range(ROUNDS):
            if not len(mark):
                return True
            # One of each full bucket's waiting marks takes the place of a stored one, which goes to its other bucket.
            order = np.argsort(bucket, kind="stable")
            first = order[runs(bucket[order])[0]]
            slot = (mark[first].astype(np.int64) + turn) % SLOTS
            thrown = self.table[bucket[first], slot]
            self.table[bucket[first], slot] = mark[first]
            mark[first] = thrown
            empty = thrown == 0
            bucket[first] = self._other(thrown, bucket[first])
            keep = np.ones(len(mark), bool)
            keep[first[empty]] = False
            mark, bucket = self._place(mark[keep], bucket[keep])
        self.table = before
        return False

    def _place(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put marks into free slots of their buckets; those left over."""
        if not len(mark):
            return mark, bucket
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        starts, lengths = runs(bucket)
        rank = np.arange(len(mark)) - np.repeat(starts, lengths)
        free = self.table[bucket] == 0
        seat = np.cumsum(free, axis=1) - 1
        fits = rank < free.sum(axis=1)
        slot = (free & (seat == rank[:, None])).argmax(axis=1)
        self.table[bucket[fits], slot[fits]] = mark[fits]
        return mark[~fits], bucket[~fits]

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one fingerprint for each of ``hashes``, all of which must be in the set."""
        mark, one = self._own(hashes)
        mark, one = self._clear(mark, one)
        self._clear(mark, self._other(mark, one))

    def _clear(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Free one slot of its bucket for each mark; those that found none."""
        while len(mark):
            found = self.table[bucket] == mark[:, None]
            slot, here = found.argmax(axis=1), found.any(axis=1)
            # Equal marks in one bucket need a slot each: one of them goes at a time.
            first = np.zeros(len(mark), bool)
            first[np.unique(bucket * SLOTS + slot, return_index=True)[1]] = True
            now = first & here
            if not now.any():
                break
            self.table[bucket[now], slot[now]] = 0
            mark, bucket = mark[~now], bucket[~now]
        return mark, bucket
