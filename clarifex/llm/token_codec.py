"""An adaptive context-mixing range coder for token ids, in numpy.

A payload holds sections, and a section independently coded blocks of at most ``BLOCK`` ids, each with
a checksum. Every block starts from the same state, which the section's head holds: how often each id
occurs (order 0), and after each id the followers that occur at least ``LEAST`` times (order 1).
From there a block's model adapts id by id:

* order 0 and order 1 are mixed by the share of ids that are no listed follower of the id before; the
  share is halved or doubled as the last ``WINDOW`` ids of the block had fewer or more such ids;
* order 2 predicts the id that last followed the two before in this block; the mass that it adds to the
  mixed distribution is what brings the id's probability to the rate at which such predictions, as sure
  as this one, were right in this block.

The three predictions are added up into one distribution, and one step of the range coder codes an id.
All sums are exact in whole numbers; the few floats are single IEEE operations, alike on all machines.
Blocks are coded side by side, one position of all blocks at a time.

Layout, little-endian: magic; u32 sections; each section: u32 bytes of its packed head, blocks, bytes
of words, then these three; crc32 of all before. A head is a zlib stream of the tables that ``_Tables``
lists; blocks are (u32 ids, u32 words, u32 crc32 of the ids as u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CLXT\x02\0\0\0"
#: Ids of a block and of a section; different ids of a section at most. Short blocks are many, which numpy needs to be coded side by side.
BLOCK, SECTION, MOST_IDS = 512, 1 << 22, 1 << 20
#: Occurrences that make a follower listed; ids that the order 0/1 mix looks back on; slots of order 2 in a block.
LEAST, WINDOW, SLOTS = 4, 32, 64
#: Bits of list shares; bits by which the mix is finer than order 0 and 1; range of the order 0 share in 1/256.
SHARE, FINER, LOWEST, HIGHEST = 16, 4, 8, 248
#: How often predictions of order 2 are right at first, by their sureness (the first stands for no prediction), and how fast that is corrected.
RATES, PACE = (0.0, 0.25, 0.5, 0.7, 0.8), 1 / 16
#: Places that an encoder looks at in one go: whole blocks, and at most 1 << 16.
STEP = 1 << 16
#: Positions after which an encoder looks whether its words still fit.
GROW = 64
_LOW = np.uint64(2**31)


class CorruptBlock(ValueError):
    """A checksum does not fit."""


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each: exact below 8, then three bits behind the first."""
    n = np.maximum(counts, 1).astype(np.int64)
    high = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    shift = np.maximum(high - 3, 0)
    return np.where(n < 8, n, 8 * (high - 2) + ((n << np.maximum(3 - high, 0)) >> shift) - 8).astype(np.uint8)


def _count(codes: np.ndarray) -> np.ndarray:
    """The counts that ``_small`` stands for."""
    c = codes.astype(np.int64)
    return np.where(c < 8, c, (8 + (c & 7)) << np.maximum((c >> 3) - 1, 0))


class _Tables:
    """Orders 0 and 1 as a section's head has them: ids, their counts, the order 0 share after each, the listed followers and their counts."""

    def __init__(self, alphabet: np.ndarray, seen: np.ndarray, share: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, times: np.ndarray, missed: int):
        self.packed = (alphabet, seen, share, sizes, symbols, times, missed)
        v = self.v = len(alphabet)
        self.alphabet, self.missed = alphabet, missed
        self.bits = max(16, int(v).bit_length() + 6)
        total, counts = 1 << self.bits, _count(seen)
        least = 256 // LOWEST  # so that an id keeps a place of its own in the smallest share
        freq = least + counts * (total - least * v) // max(1, int(counts.sum()))
        freq[np.argmax(freq)] += total - freq.sum()
        self.ends = np.concatenate(([0], np.cumsum(freq)))
        # After each id, and at a block's start (id v), a list: a stop in front, then its followers in order.
        full = np.append(sizes, 0) + 1
        self.first = np.cumsum(full) - full
        stops = np.zeros(int(full.sum()), bool)
        stops[self.first] = True
        self.owner = np.repeat(np.arange(v + 1), full)
        self.symbol = np.full(len(stops), -1, np.int64)
        self.symbol[~stops] = symbols
        weight = np.zeros(len(stops), np.int64)
        weight[~stops] = _count(times)
        upto = np.cumsum(weight)
        base = upto[self.first]
        whole = np.append(upto[self.first[1:] - 1], upto[-1]) - base
        after = (upto - base[self.owner]) << SHARE
        self.after = after // np.maximum(whole[self.owner], 1)
        self.before = np.concatenate(([0], self.after[:-1])) * ~stops
        own = np.append(share, 0).astype(np.int64)
        listed = whole > 0
        self.share = np.stack([np.where(listed, np.clip(x, LOWEST, HIGHEST), 256) for x in (own >> 1, own, own << 1)]).reshape(-1)
        # What orders 0 and 1 give is scaled by share / 256, and by rest >> down: together 2**bits.
        self.rest, self.down = (256 - self.share) << max(0, self.bits - 24), max(0, 24 - self.bits)
        self.low = round(0.6 * WINDOW * missed / 65536)
        self.high = max(self.low + 1, round(1.5 * WINDOW * missed / 65536))

    def level(self, recent: np.ndarray) -> np.ndarray:
        """Which of the three shares of order 0 holds, by the misses of the last WINDOW ids."""
        return (recent > self.low).astype(np.int64) + (recent >= self.high)

    def pack(self) -> bytes:
        alphabet, seen, share, sizes, symbols, times, missed = self.packed
        steps = np.diff(symbols, prepend=0)
        parts = [np.diff(alphabet, prepend=0).astype("<u4"), seen, share, sizes.astype("<u4"), steps.astype("<i4"), times]
        # Bytes of one rank stand together, which packs better.
        raw = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(-1, p.itemsize).T).tobytes() for p in parts)
        return struct.pack("<IIH", len(alphabet), len(symbols), missed) + zlib.compress(raw, 6)

    @classmethod
    def unpack(cls, head: bytes) -> _Tables:
        v, n, missed = struct.unpack_from("<IIH", head)
        raw, at, out = zlib.decompress(head[10:]), 0, []
        for many, kind in ((v, "<u4"), (v, "u1"), (v, "u1"), (v, "<u4"), (n, "<i4"), (n, "u1")):
            size = np.dtype(kind).itemsize
            part = np.frombuffer(raw, np.uint8, many * size, at).reshape(size, many).T
            out.append(np.ascontiguousarray(part).view(kind).reshape(-1))
            at += many * size
        alphabet, seen, share, sizes, steps, times = out
        return cls(np.cumsum(alphabet.astype(np.int64)), seen, share, sizes.astype(np.int64), np.cumsum(steps.astype(np.int64)), times, missed)


class _Second:
    """How often order 2 is right in each block, by the sureness of its predictions."""

    def __init__(self, blocks: int, bits: int):
        self.rate, self.row = np.tile(np.array(RATES), blocks), np.arange(blocks) * len(RATES)
        self.top, self.finer = float(1 << (bits + FINER)), float(1 << FINER)
        self.most = float((1 << (bits + FINER)) - (1 << bits))

    def mass(self, kind: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mass to add for predictions of these kinds (0: none), whose ids have ``width`` of 2**bits without it; what ``learn`` needs."""
        at = self.row + kind
        rate = self.rate.take(at)
        mass = rate * self.top
        mass -= width * self.finer
        np.maximum(mass, 0.0, out=mass)
        return np.minimum(mass, self.most, out=mass).astype(np.int64), at, rate

    def learn(self, at: np.ndarray, rate: np.ndarray, right: np.ndarray) -> None:
        self.rate[at] = rate + (right - rate) * PACE  # without a prediction it stays 0


def _slot(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    mixed = (before.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (last.astype(np.uint32) * np.uint32(0x85EBCA6B))
    return ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)


def encode(ids: np.ndarray) -> bytes:
    """The payload of some ids (each below 2**32)."""
    ids = np.asarray(ids, np.uint32)
    sections, at = [], 0
    while at < len(ids):
        upto = min(len(ids), at + SECTION)
        if upto - at > MOST_IDS and len(np.unique(ids[at:upto])) > MOST_IDS:
            upto = at + MOST_IDS
        sections.append(_encode(ids[at:upto]))
        at = upto
    out = MAGIC + struct.pack("<I", len(sections)) + b"".join(sections)
    return out + struct.pack("<I", zlib.crc32(out))


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload; CorruptBlock if any checksum does not fit."""
    if len(payload) < 16 or payload[:8] != MAGIC or struct.unpack("<I", payload[-4:])[0] != zlib.crc32(payload[:-4]):
        raise CorruptBlock("the payload is damaged")
    at, parts = 12, []
    for _ in range(struct.unpack_from("<I", payload, 8)[0]):
        head, blocks, size = struct.unpack_from("<III", payload, at)
        at += 12
        table = np.frombuffer(payload, "<u4", 3 * blocks, at + head).reshape(-1, 3).astype(np.int64)
        words = np.frombuffer(payload, "<u4", size // 4, at + head + 12 * blocks)
        tables = _Tables.unpack(payload[at : at + head])
        ids = _decode(tables, words, table[:, 0], table[:, 1])
        ends = np.cumsum(table[:, 0]).tolist()  # whatever the length of blocks was when they were written
        for k, (length, _, crc) in enumerate(table.tolist()):
            if zlib.crc32(ids[ends[k] - length : ends[k]]) != crc:
                raise CorruptBlock(f"block {k} is damaged")
        parts.append(ids)
        at += head + 12 * blocks + size
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, how often each occurs, and the ids as places among them."""
    if ids.max() < MOST_IDS:
        times = np.bincount(ids)
        alphabet = np.flatnonzero(times)
        place = np.zeros(len(times), np.int32)
        place[alphabet] = np.arange(len(alphabet))
        return alphabet, times[alphabet], place[ids]
    alphabet, dense, times = np.unique(ids, return_inverse=True, return_counts=True)
    return alphabet.astype(np.int64), times, dense.reshape(-1).astype(np.int32)


def _pairs(dense: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of an id (``v`` at a block's start) and the one behind it, in order: first, second and how often; and which of them each place has."""
    n = len(dense)
    packed = np.empty(n, np.int64)  # key and place: sorting the two packed is much faster than argsort
    packed[1:] = dense[:-1]
    packed[::BLOCK] = v
    packed *= v
    packed += dense
    packed <<= 22
    packed |= np.arange(n, dtype=np.int32)
    packed.sort()
    order = packed & ((1 << 22) - 1)
    packed >>= 22
    new = np.concatenate(([True], packed[1:] != packed[:-1]))
    starts = np.flatnonzero(new)
    pairs = packed[starts]
    del packed
    which = np.empty(n, np.int32)
    which[order] = np.cumsum(new, dtype=np.int32)
    which -= 1
    return pairs // v, pairs % v, np.diff(np.append(starts, n)), which


def _expected(before: np.ndarray, last: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What order 2 expects in some whole blocks (STEP ids at most): the sureness, 0 for nothing, and the pair that stood at the slot's last use in the block, if it began with the same id."""
    n = len(pair)
    at = np.arange(n, dtype=np.uint32)
    packed = ((at // BLOCK * SLOTS + _slot(before, last).astype(np.uint32)) << np.uint32(16)) | at
    packed.sort()
    order, slot = (packed & np.uint32(0xFFFF)).astype(np.int64), packed >> np.uint32(16)
    same = np.concatenate(([False], slot[1:] == slot[:-1]))
    met, began = pair.take(order), last.take(order)
    found = np.concatenate((met[:1], met[:-1]))
    right = same & (found == met)
    sure = same.astype(np.int8)
    streak = same
    for _ in range(3):  # one more for each of the last predictions at the slot that was right
        streak = same & np.concatenate(([False], (streak & right)[:-1]))
        sure += streak
    sure[1:] *= began[1:] == began[:-1]
    kind, guess = np.empty(n, np.int8), np.empty(n, np.int64)
    kind[order], guess[order] = sure, np.where(sure > 0, found, 0)
    return kind, guess


def _encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    alphabet, seen, dense = _alphabet(ids)
    v = len(alphabet)
    owner, symbol, times, which = _pairs(dense, v)
    listed = (times >= LEAST) & (owner < v)
    held = np.bincount(owner[listed], times[listed], minlength=v + 1)
    met = np.bincount(owner, times, minlength=v + 1)
    share = np.clip(np.rint(256 * (met - held + 1) / (met + 2)), 1, 255).astype(np.uint8)[:v]
    miss = ~listed[which]
    tables = _Tables(alphabet, _small(seen), share, np.bincount(owner[listed], minlength=v)[:v], symbol[listed], _small(times[listed]), min(65535, int(miss.mean() * 65536)))
    # Each pair's place in the lists: the last entry at or before it.
    entry = tables.first[owner] + np.cumsum(listed) - np.concatenate(([0], np.cumsum(np.bincount(owner[listed], minlength=v + 1))))[owner]
    low, high = np.where(listed, tables.before[entry], tables.after[entry]), tables.after[entry]

    blocks = -(-n // BLOCK)
    lengths = np.minimum(BLOCK, n - BLOCK * np.arange(blocks)).astype(np.int64)
    gone = np.concatenate(([0], np.cumsum(miss, dtype=np.int32)))
    # A row for each position, a column for each block: start, end, kind, width and side.
    longest = int(lengths.max())
    rows = [np.empty((longest, blocks), x) for x in (np.int32, np.int32, np.int8, np.int32, np.int8)]
    fit = np.int32 if tables.bits <= 22 else np.int64  # products stay below 2**31
    ends, shares, rests, low, high = (x.astype(fit) for x in (tables.ends, tables.share, tables.rest, low, high))
    symbol = symbol.astype(np.int32)
    for a in range(0, n, STEP):  # in steps that stay in the cache
        now = slice(a, min(n, a + STEP))
        d, u = dense[now], which[now].astype(np.int64)
        last, before = np.empty_like(d), np.empty_like(d)
        last[1:] = d[:-1]
        last[::BLOCK] = v
        before[1:] = last[:-1]
        before[::BLOCK] = v
        kind, g = _expected(before, last, u)
        at = np.arange(a, now.stop)
        own = tables.level(gone[now] - gone.take(np.maximum(at - WINDOW, at // BLOCK * BLOCK))) * (v + 1) + last
        scale, rest = shares.take(own), rests.take(own)
        place = lambda d, part: ((scale * ends.take(d)) >> 8) + ((part * rest) >> tables.down)  # noqa: E731, B023
        other = symbol.take(g)
        side = np.where(kind == 0, 0, np.where(g == u, 1, 2 * (other < d))).astype(np.int8)  # the added mass stands behind, in or before the id's place
        found = place(d, low.take(u)), place(d + 1, high.take(u)), kind, place(other + 1, high.take(g)) - place(other, low.take(g)), side
        for row, x in zip(rows, found, strict=True):
            if len(x) % BLOCK:
                x = np.append(x, np.zeros(-len(x) % BLOCK, x.dtype))  # what follows a block's end is not coded
            row[:, a // BLOCK : a // BLOCK + len(x) // BLOCK] = x.reshape(-1, BLOCK)[:, :longest].T
    del gone, which, miss, dense
    out = _code(*rows, lengths, tables.bits)
    crcs = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK]) for k in range(blocks)]
    head, words = tables.pack(), b"".join(w.astype("<u4").tobytes() for w in out)
    return struct.pack("<III", len(head), blocks, len(words)) + head + np.array([lengths, [len(w) for w in out], crcs], np.uint32).T.tobytes() + words


def _code(start: np.ndarray, end: np.ndarray, kind: np.ndarray, width: np.ndarray, side: np.ndarray, lengths: np.ndarray, bits: int) -> list[np.ndarray]:
    """The range coder's words of each block; the arrays have a row for each position."""
    n, second, fine = len(lengths), _Second(len(lengths), bits), np.uint64(bits + FINER)
    low, span = np.zeros(n, np.uint64), np.full(n, 2**63 - 1, np.uint64)
    out, filled, rows, full = np.zeros((n, len(start) // 4 + GROW), np.uint64), np.zeros(n, np.int64), np.arange(n), int(lengths.min())
    for k in range(len(start)):
        if k % GROW == 0 and filled.max() + GROW + 2 > out.shape[1]:  # a position gives at most one word, and the end two
            out = np.concatenate((out, np.zeros((n, max(2 * GROW, out.shape[1] // 2)), np.uint64)), axis=1)
        mass, at, rate = second.mass(kind[k], width[k])
        left = (1 << (bits + FINER)) - mass
        a = ((left * start[k]) >> bits) + mass * (side[k] > 1)
        b = ((left * end[k]) >> bits) + mass * (side[k] > 0)
        second.learn(at, rate, side[k] == 1)
        unit = span >> fine
        if k >= full:  # blocks that are over stay as they are
            whole = k >= lengths
            a[whole], b[whole] = 0, 1
            unit[whole] = span[whole]
        low += unit * a.view(np.uint64)
        span = unit * (b - a).view(np.uint64)
        small = np.flatnonzero(span < _LOW)
        if len(small):
            x, at = low.take(small), filled.take(small)
            out[small, at] = x >> np.uint64(31)
            filled[small] = at + 1
            low[small] = (x & (_LOW - np.uint64(1))) << np.uint64(32)
            span[small] = span.take(small) << np.uint64(32)
    for _ in range(2):
        out[rows, filled] = low >> np.uint64(31)
        filled += 1
        low = (low & (_LOW - np.uint64(1))) << np.uint64(32)
    over = out >> np.uint64(32)
    while over.any():  # carries go into the word before
        out &= np.uint64(2**32 - 1)
        out[:, :-1] += over[:, 1:]
        np.right_shift(out, np.uint64(32), out=over)
    return [out[k, : filled[k]] for k in range(n)]


def _decode(tables: _Tables, words: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n, v, bits = len(lengths), tables.v, tables.bits
    second, rows, fine = _Second(n, bits), np.arange(n), np.uint64(bits + FINER)
    stream = np.append(words.astype(np.uint64), np.zeros(4, np.uint64))
    place = np.cumsum(counts) - counts
    # The register has 63 bits: the last bit of a word waits for the next one.
    code = (stream[place] << np.uint64(31)) | (stream[place + 1] >> np.uint64(1))
    feed = stream >> np.uint64(1)
    feed[1:] |= (stream[:-1] & np.uint64(1)) << np.uint64(31)
    place += 2
    span = np.full(n, 2**63 - 1, np.uint64)
    longest, full = int(lengths.max()), int(lengths.min())
    ids = np.full((longest + 2, n), v, np.int64)
    misses, recent, old = np.zeros((WINDOW, n), np.int64), np.zeros(n, np.int64), rows * SLOTS
    ends, following, shares, rest, down = tables.ends[:-1], tables.ends[1:], tables.share, tables.rest, tables.down
    # Entries of the lists, with one behind that is in none. All by share, list and place in one rising row.
    many, symbol, own = len(tables.symbol), tables.symbol, tables.owner
    owner = np.append(own, -1)
    edge = np.stack((np.append(tables.after, 0), np.append(tables.before, 0)), axis=1).reshape(-1)  # an entry's end, and where it begins
    # Of each list, cut into equal parts, two or more for each entry: the last entry at or before a part's start, from which few steps are left.
    sizes = np.diff(np.append(tables.first, many))
    shift = bits - np.array([int(x).bit_length() + 1 for x in sizes])
    parts = np.tile((1 << bits) >> shift, 3)
    part, shift = np.cumsum(parts) - parts, np.tile(shift, 3)
    line, held, upto = [], np.zeros(int(parts.sum()) + 1, np.int64), np.zeros(int(parts.sum()) + 1, np.int64)
    for k in range(0, 3 * (v + 1), v + 1):
        start = ((shares[k + own] * ends[np.maximum(symbol, 0)]) >> 8) + ((tables.before * rest[k + own]) >> down)
        start[symbol < 0] = 0
        line.append(((k + own) << (bits + 1)) + start)
        at, wide = part[k + own], shift[k + own]
        held += np.bincount(at + (start >> wide), minlength=len(held))
        upto += np.bincount(at - (-start >> wide), minlength=len(upto))
    guide = (np.cumsum(upto) - 1).astype(np.int32)
    halves = [1 << h for h in range(int(held.max()).bit_length() - 1, -1, -1)]
    line = np.concatenate((*line, np.full(2 * halves[0], np.iinfo(np.int64).max)))
    many_times = np.arange(3) * many
    ids_at = np.repeat(np.arange(v, dtype=np.int32), np.diff(tables.ends)) if bits <= 22 else None  # order 0's id at each place
    # Below 2**52 the floor of a quotient of floats is that of the whole numbers, and many times as fast.
    over = (lambda x, y: (x / y).astype(np.int64)) if 2 * bits + FINER < 52 else np.floor_divide
    # What order 2 remembers: the entry (times two, and one if it is the id itself), the id, and how sure it is.
    memory = np.full(n * SLOTS, 2 * many << 22, np.int64)
    whole, sure_ones = 1 << (bits + FINER), 3
    for k in range(longest):
        last = ids[k + 1]
        level = tables.level(recent)
        own = level * (v + 1) + last
        scale, other = shares.take(own), rest.take(own)
        # What order 2 expects.
        slot = old + _slot(ids[k], last)
        kept = memory.take(slot)
        entry = kept >> 22
        j = entry >> 1
        usable = owner.take(j) == last
        guess = ((kept >> 2) & (MOST_IDS - 1)) * usable
        sure = kept & sure_ones
        a = ((scale * ends.take(guess)) >> 8) + ((edge.take(entry) * other) >> down)
        b = ((scale * following.take(guess)) >> 8) + ((edge.take(j + j) * other) >> down)
        mass, at, rate = second.mass((1 + sure) * usable, b - a)
        left = whole - mass
        first, end = (left * a) >> bits, ((left * b) >> bits) + mass
        unit = span >> fine
        spot = np.minimum((code // unit).view(np.int64), whole - 1)
        passed = usable & (spot >= end)
        hit = usable & (spot >= first) & ~passed
        # What orders 0 and 1 have there.
        plain = np.where(hit, a, over(((spot - mass * passed + 1) << bits) - 1, left))
        key, e = (own << (bits + 1)) + plain, guide.take(part.take(own) + (plain >> shift.take(own))).astype(np.int64)
        for h in halves:  # the last entry of the list at or before it; for many lists at once this is faster than searchsorted
            e += (line.take(e + h) <= key).view(np.int8) * h
        e -= many_times.take(level)
        s = symbol.take(e)
        into = (edge.take(e + e) * other) >> down
        listed = (s >= 0) & (plain < ((scale * following.take(s)) >> 8) + into)
        base = over((plain - into + 1) * 256 - 1, scale)
        now = np.where(listed, s, ids_at.take(base, mode="clip") if ids_at is not None else np.searchsorted(ends, base, side="right") - 1)
        entry = e + e + listed
        a = ((scale * ends.take(now)) >> 8) + ((edge.take(entry) * other) >> down)
        b = ((scale * following.take(now)) >> 8) + into
        first, end = ((left * a) >> bits) + mass * passed, ((left * b) >> bits) + mass * (passed | hit)
        if k >= full:
            live = k < lengths
            first, end, unit, now = np.where(live, first, 0), np.where(live, end, 1), np.where(live, unit, span), np.where(live, now, 0)
        second.learn(at, rate, hit)
        code -= unit * first.view(np.uint64)
        span = unit * (end - first).view(np.uint64)
        short = (span < _LOW).astype(np.uint64)  # all blocks at once is faster than picking those that need a word
        code = (code << (short << np.uint64(5))) | (feed.take(place) * short)
        span <<= short << np.uint64(5)
        place += short.view(np.int64)
        memory[slot] = (entry << 22) | (now << 2) | (np.minimum(sure + 1, 3) * hit)
        recent += (new := ~listed) - misses[k % WINDOW]
        misses[k % WINDOW] = new
        ids[k + 2] = now
    own = ids[2:]
    dense = np.concatenate([own[: lengths[k], k] for k in range(n)]) if full < longest else own.T.reshape(-1)
    return tables.alphabet[dense].astype("<u4")
