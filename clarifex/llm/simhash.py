"""SimHash near-dedup with a generalised pigeonhole search over the fingerprints.

Bits that go together are put into one part. If the thresholds t of the parts add up to
``tau - parts + 1``, two fingerprints within tau bits are within t bits in at least one part (a part
with t = -1 is never probed). The thresholds are allocated by dynamic programming on candidate
counts estimated from a bounded sample; probes meet stored fingerprints by part value, and every
meeting is verified. Only distinct fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import ROW_KEY, cut, made, of, release, runs, skew_join, table, text_bytes, tidy, with_row_key
from clarifex.llm.components import components

#: Fingerprints on the driver for the estimates. Rows of a bucket beyond which it is split further. Pairs compared at once.
SAMPLE, LARGE_BUCKET, AT_ONCE = 4096, 20_000, 1 << 21


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased; of the whole sequence if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    n = max(1, len(words) - width + 1)
    ends = [*gaps, len(joined)][-n:]
    return np.fromiter((h(joined[a:b], 42) for a, b in zip([0, *(g + 1 for g in gaps)][:n], ends, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; none: 0."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) for each row; fp is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            fps = np.array([fingerprint(shingle_hashes(x, width)) for x in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(each, f"_id {dict(rows.dtypes)['_id']}, fp long")


def bit_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal width; each group is grown from a free bit by those most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) - 0.5
    spread = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, 64))
    norm = np.sqrt((spread**2).sum(axis=0))
    linked = np.abs(spread.T @ spread) / np.maximum(np.outer(norm, norm), 1e-9)
    free, out = list(range(64)), []
    for k in range(parts):
        take = len(free) // (parts - k)
        own = [free.pop(0)]
        while len(own) < take:
            own.append(free.pop(int(np.argmax([linked[b, own].sum() for b in free]))))
        out.append(sorted(own))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one of each dictionary, that add up to ``total``; by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, more in options.items():
                if done + t not in grown or cost + more < grown[done + t][0]:
                    grown[done + t] = (cost + more, [*chosen, t])
        best = grown
    return best[total]


def plan(sample: np.ndarray, n: int, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed part: the cheapest plan of 2 to 4 (beyond 10 bits, 6) parts for ``n`` fingerprints, as estimated on the sample."""
    some = sample[:1024]
    most = 4 if tau <= 10 else 6  # wide searches need narrow parts, or the probes are too many
    apart = some[:, None] ^ some[None, :]
    off = ~np.eye(len(some), dtype=bool)
    plans = []
    for parts in range(2, most + 1):
        groups, costs = bit_parts(sample, parts), []
        for own in groups:
            distance = np.bitwise_count(apart & np.uint64(sum(1 << b for b in own)))[off]
            ball = lambda r, w=len(own): sum(comb(w, k) for k in range(r + 1))
            near = [(float((distance <= t).mean()) if len(distance) else 0.0) + ball(t // 2) * ball(t - t // 2) / 2.0 ** len(own) for t in range(tau + 1)]
            costs.append({-1: 0.0} | {t: 50.0 * n * ball(t - t // 2) + n * n * near[t] for t in range(tau + 1)})
        cost, chosen = allocate(costs, tau - parts + 1)
        plans.append((cost, [(own, t) for own, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _salt(part: int) -> np.uint64:
    return np.uint64(int(part) * 0x9E3779B97F4A7C15 % 2**64)


def _keys(fps: np.ndarray, probed: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, bool]]:
    """The bucket keys of each fingerprint: of its variants within t // 2 bits (stored), and of those beyond within t - t // 2 (probes).

    Two values within t bits have a common variant among the stored of one and all of the other. The
    part's number stands in a key's three low bits.
    """
    for k, (own, t) in enumerate(probed):
        value = fps & _mask(own)
        for flips in range(t - t // 2 + 1):
            for some in combinations(own, flips):
                yield _key(value ^ _mask(some), k), flips > t // 2


def _key(value: np.ndarray, part: int) -> np.ndarray:
    return (_mixed(value, _salt(part)) & np.uint64(2**64 - 8)) | np.uint64(part)


def _slices(level: int, tau: int) -> list[int]:
    """The bits of each of tau + 1 slices by which large buckets are dealt at a level."""
    return [sum(1 << b for b in range(64) if (b * (level * 2 + 1) // (level + 1)) % (tau + 1) == k) for k in range(tau + 1)]


def first_meeting(probed: list[tuple[list[int], int]], tau: int):
    """A function of fingerprints a, b (those of a stored) in a bucket of this first key and path: whether this is the one of all buckets they share that answers for them.

    It is in the first part in which they are near enough, at the variant of a with the least of the bits
    in which they differ flipped; where buckets were dealt again, in the first slice that they share.
    """
    masks = [_mask(own) for own, _ in probed]

    def answers(a: np.ndarray, b: np.ndarray, key: int, path: int) -> np.ndarray:
        apart, part = a ^ b, key & 7
        ok = np.ones(len(a), bool)
        for j in range(part):
            ok &= np.bitwise_count(apart & masks[j]) > probed[j][1]
        rest = apart & masks[part]
        flipped = np.zeros(len(a), np.uint64)
        for _ in range(probed[part][1] // 2):
            bit = rest & (~rest + np.uint64(1))
            flipped, rest = flipped | bit, rest ^ bit
        ok &= _key((a & masks[part]) ^ flipped, part).view(np.int64) == key
        for level in range(LEVELS):
            if k := path // 64**level % 64:
                for j, s in enumerate(_slices(level, tau)[:k]):
                    ok &= ((apart & np.uint64(s)) == 0) == (j == k - 1)
        return ok

    return answers


def _mixed(value: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A one-to-one mix of 64-bit values; collisions between parts only cost a comparison."""
    x = value ^ salt
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def close_pairs(stored: np.ndarray, others: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (of stored, of others) within tau bits. Large sets are split by tau + 1 slices of the bits that vary, so no product of large sets is compared."""
    if len(stored) * len(others) <= AT_ONCE:
        i, j = np.nonzero(np.bitwise_count(stored[:, None] ^ others[None, :]) <= tau)
        yield stored[i], others[j]
        return
    both = np.concatenate((stored, others))
    varied = int(np.bitwise_or.reduce(both) & ~np.bitwise_and.reduce(both))
    free = [b for b in range(64) if varied >> b & 1]
    if len(free) <= 2 * (tau + 1):
        step = max(1, AT_ONCE // len(others))
        for at in range(0, len(stored), step):
            i, j = np.nonzero(np.bitwise_count(stored[at : at + step, None] ^ others[None, :]) <= tau)
            yield stored[at : at + step][i], others[j]
        return
    for k in range(tau + 1):
        mask = np.uint64(sum(1 << b for b in free[k :: tau + 1]))
        mine, theirs = (np.argsort(x & mask, kind="stable") for x in (stored, others))
        a, b = stored[mine], others[theirs]
        values, starts = np.unique(a & mask, return_index=True)
        ends = np.append(starts[1:], len(a))
        lo, hi = np.searchsorted(b & mask, values), np.searchsorted(b & mask, values, side="right")
        for s, e, x, y in zip(starts, ends, lo, hi, strict=True):
            if y > x:
                yield from close_pairs(a[s:e], b[x:y], tau)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as links from each node to the least node of its component within the batch: as many rows as nodes at most."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (root[x], root[y], x, y):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            far = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[far], nodes[root[far]]
        root = new


def _by_bucket(links):
    """A function for mapInArrow over rows sorted by key, which gives ``links`` the columns (key, fp, probe, ...) of whole buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            now = (now[0], now[1].view(np.uint64), *now[2:])
            if held and held[-1][0][-1] == now[0][-1] and len(held) <= 64:
                held.append(now)  # one bucket goes on over whole batches
                continue
            cols = [np.concatenate(x) for x in zip(*held, now, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1])
            yield from links(*(c[:last] for c in cols))
            held = [tuple(c[last:] for c in cols)]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return each


def _verify(tau: int):
    def links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, *_) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        starts, lengths = runs(key)
        small = np.repeat(lengths, lengths) <= 32
        for step in range(1, 32):
            if len(key) <= step:
                break
            near = (key[step:] == key[:-step]) & small[step:] & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= tau)
            if not (key[step:] == key[:-step]).any():
                break
            left.append(fp[:-step][near])
            right.append(fp[step:][near])
        for s, n in zip(starts[lengths > 32], lengths[lengths > 32], strict=True):
            own = fp[s : s + n]
            for a, b in close_pairs(np.unique(own[~probe[s : s + n]]), np.unique(own), tau):
                if len(a):
                    x, y = _stars(a, b)
                    left.append(x)
                    right.append(y)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
        if len(a):
            a, b = _stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return _by_bucket(links)


def planned(distinct: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """The plan of a search among the rows of ``distinct`` (fp, ...), from their number and a bounded sample."""
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    return plan(sample, distinct.count(), tau)


def buckets(rows: DataFrame, probed: list[tuple[list[int], int]], tau: int, large_bucket: int) -> DataFrame:
    """(key, fp, probe, ...) for ``rows`` (fp, ...): any two within tau bits share a key, which for one at least is no probe.

    Nothing is stored: keys are quickly made again. Buckets of about ``large_bucket`` rows or more, as
    a hash sample of the rows shows, are dealt out again by slices of their bits; then all rows also
    say what ``first_meeting`` needs: their key at first (own) and the path.
    """
    more = [c for c in rows.columns if c != "fp"]
    schema = "key long, fp long, probe boolean" + "".join(f", {c} {t}" for c, t in rows.select(*more).dtypes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for key, probe in _keys(fps.view(np.uint64), probed):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps), pa.array(np.full(len(fps), probe)), *batch.columns[1:]], ["key", "fp", "probe", *more])

    share = 16 if large_bucket >= 1600 else 1
    seen = rows.select("fp", *more).where(F.pmod(F.xxhash64("fp", *more), F.lit(share)) == 0).mapInArrow(keyed, schema)
    out = rows.select("fp", *more).mapInArrow(keyed, schema)
    for level in range(LEVELS):
        sizes = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("alone"))
        large = cut(sizes.where((F.col("n") * share > large_bucket) & ~F.col("alone")).select("key"))  # fewer than rows / large_bucket
        if not large.take(1):
            break
        if "own" not in out.columns:
            out, seen = (x.withColumn("own", F.col("key")).withColumn("path", F.lit(0)) for x in (out, seen))
        out, seen = (_dealt(x, large, tau, level) for x in (out, seen))
    return out


def _dealt(rows: DataFrame, large: DataFrame, tau: int, level: int) -> DataFrame:
    """``rows`` with those of large buckets dealt by tau + 1 slices, one of which two near fingerprints share."""
    marked = rows.join(F.broadcast(large.withColumn("hot", F.lit(True))), "key", "left")
    signed = [s - 2**64 if s >= 2**63 else s for s in _slices(level, tau)]
    dealt = F.array(*[F.struct(F.xxhash64("key", F.lit(level * 64 + k), F.col("fp").bitwiseAND(F.lit(s))).alias("key"), F.lit((k + 1) * 64**level).alias("step")) for k, s in enumerate(signed)])
    stays = F.array(F.struct(F.col("key"), F.lit(0).alias("step")))
    to = marked.withColumn("to", F.explode(F.when(F.col("hot"), dealt).otherwise(stays)))
    return to.withColumn("key", F.col("to.key")).withColumn("path", F.col("path") + F.col("to.step")).select(*rows.columns)


def by_bucket(rows: DataFrame, *then: str) -> DataFrame:
    """The rows of buckets, each bucket in one task and together."""
    return rows.repartition("key").sortWithinPartitions("key", *then)


def near_links(distinct: DataFrame, tau: int, large_bucket: int) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (column fp, each once) that connect all pairs within tau bits.

    Each linked pair is in one component of the links; a bucket gives at most one link for each of its rows.
    """
    fps = distinct.select("fp")
    return by_bucket(buckets(fps, planned(fps, tau), tau, large_bucket), "probe").mapInArrow(_verify(tau), "a long, b long")


def near_dedup(docs: DataFrame, width: int = 5, tau: int = 3, id_col: str = "doc_id", text_col: str = "text", large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``tau`` or fewer differing bits; component_id is the least id reached by
    links, its own included (null if the component has only null ids). Null texts and texts without
    words have fingerprint zero and link like any other. No rows give no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, width, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(classes.select("fp"), tau, large_bucket))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = cut(skew_join(rooted, cut(heads), ["root"], "classes").select("fp", "n", "component_id"))
    out = skew_join(rows, named, ["fp"], "n")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Meetings for each document left up to which near copies are settled by all pairs at once (a near pair meets under many keys). Rows of a bucket beyond which its pairs are estimated from so many.
FEW_PAIRS, MANY, SOME = 200, 2048, 256

#: One document in so many tells which shingles are frequent, which are those in so many of these or more; so many of them are known at most. Only costs depend on it.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 25, 3, 200_000

#: Rows with a shared key that a task goes through at once.
CHUNK = 1 << 16

#: Candidates up to which all are verified at once, and the driver goes through those that are near.
SETTLED = 10_000

#: Rows of one size band that one task compares with as many others at least; a block has a hundredth of all rows if that is more.
BLOCK = 16_384

#: Times that large buckets are dealt again at most.
LEVELS = 3

#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to few or many rows with an id each."""
    side = cut(ids)
    return docs.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side, ids.columns[0], how)


def shingle_sets(rows: DataFrame, width: int, whole: bool = False, least: float = 0.8, common=None) -> DataFrame:
    """``rows`` with what is known of the distinct shingles in place of ``_text``: a 128-bit digest (_class), their SimHash (fp), number (_n), sketch (_sketch) and ``rarest`` (_keys), by the broadcast ``common``; or all of them in order (_set)."""
    others = [c for c in rows.columns if c != "_text"]
    names = ["_set"] if whole else ["_class", "fp", "_n", "_sketch", "_keys"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            sets = [np.unique(shingle_hashes(x, width)) for x in text_bytes(batch.column("_text"))]
            raw = [s.tobytes() for s in sets]
            if whole:
                cols = [pa.array(raw, pa.binary())]
            else:
                fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
                known = common.value if common else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                keys = [rarest(s, least, *known).tobytes() for s in sets]
                cols = [pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *cols], [*others, *names])

    kinds = {"_class": "binary", "fp": "long", "_n": "long", "_sketch": "binary", "_keys": "binary", "_set": "binary"}
    schema = ", ".join([f"{c} {dict(rows.dtypes)[c]}" for c in others] + [f"{c} {kinds[c]}" for c in names])
    return rows.select(*others, "_text").mapInArrow(each, schema)


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (hashes in order, counts) in one of ``COMMON_SHARE`` of the texts (_text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            for x in text_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x, width)).view(np.int64))], ["h"])

    some = texts.select("_text").where(F.pmod(F.xxhash64("_text"), F.lit(COMMON_SHARE)) == 0)
    counts = some.mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_LEAST)
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON_MOST).toArrow()
    hashes, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def rarest(hashes: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of the distinct hashes (in order), the least frequent first, that any two sets with a Jaccard similarity of ``least`` share one of them.

    In one order of all hashes, the first that two sets share is among the n - ceil(least n) + 1 first of each: at least ``least`` n of its own are shared.
    """
    n = len(hashes)
    most = n - int(np.ceil(least * n - 1e-6)) + 1 if n else 0
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    known = common[at] == hashes if len(common) else np.zeros(n, bool)
    first = hashes[~known][:most]
    if len(first) == most:
        return first
    rest = hashes[known]
    return np.concatenate((first, rest[np.argsort(counts[at[known]], kind="stable")][: most - len(first)]))


def sketch(hashes: np.ndarray) -> bytes | None:
    """How many of the distinct hashes fall into each of 2^k equal ranges, of 4 to 8 hashes on average, a byte each; None if one has over 255."""
    k = max(1, (len(hashes) // 8).bit_length())
    counts = np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most_alike(a: bytes, b: bytes) -> float:
    """The largest Jaccard similarity that two sets with these sketches can have: no range has more in common than the fewer of its two counts."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).sum(axis=1)
    common = int(np.minimum(x, y).sum())
    return common / max(1, int(x.sum() + y.sum()) - common)


def _may_be_near(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose sketches (node, _sketch) allow a Jaccard similarity of ``least``. Whole sets are fetched for these alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            may = [a is None or b is None or most_alike(a, b) >= least for a, b in zip(batch.column("_u").to_pylist(), batch.column("_v").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(may, pa.bool_()))

    of_side = lambda side: sketches.select(F.col("node").alias(side), F.col("_sketch").alias(f"_{side}"))
    return pairs.join(of_side("v"), "v").join(of_side("u"), "u").select("u", "v", "_u", "_v").mapInArrow(each, "u long, v long")


def _nodes(pairs: DataFrame) -> DataFrame:
    """(node): whatever is in a pair."""
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _near(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets (node, _set) have a Jaccard similarity of ``least`` or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            near = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common / max(1, len(x) + len(y) - common) >= least)
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    counts = cut(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")))
    heads = _by_id(sets.select(F.col("node").alias("u"), F.col("_set").alias("_first")), counts, "inner")
    own = pairs.join(sets.select(F.col("node").alias("v"), "_set"), "v")
    return skew_join(own, heads, ["u"], "n").select("u", "v", "_set", "_first").mapInArrow(each, "u long, v long")


def by_size(rows: DataFrame, least: float, block: int) -> DataFrame:
    """(key, fp, node, n, side, ...) for ``rows`` (fp, node, n, ...): any two nodes whose n allow a similarity of ``least`` meet under one key, and under one alone.

    It is the plain search by size alone, which grows with the square of the rows; tests hold ``_candidates`` against it.
    Bands of n are so wide that such nodes are in one band or in neighbours. A band is cut into blocks of
    about ``block`` rows, and two blocks meet under a key of their own: side 0 with side 1, or a block (side 2)
    with itself.
    """
    total, wide = rows.count(), max(-np.log(least), 1e-9) * 1.0001
    block = max(block, total // 100)
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(float(wide)))
    blocks = {r.band: -(-r.rows // block) for r in rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block).collect()}  # 100 at most
    more = [c for c in rows.columns if c not in ("fp", "node", "n")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("band").to_numpy()
            below, here, above = (np.array([blocks.get(b + d, 1) for b in at.tolist()], np.int64) for d in (-1, 0, 1))
            mine = (_mixed(batch.column("node").to_numpy().view(np.uint64), _salt(1)) % here.view(np.uint64)).view(np.int64)
            for cross, (left, right, width) in enumerate(((mine, None, here), (mine, None, above), (None, mine, below))):
                for j in range(int(width.max(initial=0))):
                    some = np.flatnonzero(j < width)
                    m, other = mine[some], np.full(len(some), j)
                    if cross == 0:
                        i, k, side = np.minimum(m, j), np.maximum(m, j), np.where(m == j, 2, (m > j).astype(np.int64))
                    else:
                        i, k, side = (m, other, np.zeros(len(some), np.int64)) if right is None else (other, m, np.ones(len(some), np.int64))
                    key = ((at[some] - (cross == 2)) * 2 + (cross > 0)) << 14 | i << 7 | k
                    cols = [batch.column(c).take(pa.array(some)) for c in ("fp", "node", "n", *more)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *cols[:3], pa.array(side.astype(np.int8)), *cols[3:]], ["key", "fp", "node", "n", "side", *more])

    schema = "key long, fp long, node long, n long, side tinyint" + "".join(f", {c} {t}" for c, t in rows.select(*more).dtypes)
    keyed = rows.select("fp", "node", "n", *more, band.alias("band")).mapInArrow(each, schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "n")  # a number, as little data may be much to compare


def _alike(fp: np.ndarray, n: np.ndarray, rows: np.ndarray, others: np.ndarray, tau: int, least: float, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ``rows``, of ``others``), both indices in the order of n, of fingerprints within ``tau`` bits and sizes that allow a similarity of ``least``; ``once``: of a set with itself, the first index is the lesser.

    A few are compared at a time, which stay in a processor's cache.
    """
    a, b, an, bn = fp[rows], fp[others], n[rows], n[others]
    lo, hi = np.searchsorted(bn, an * least - 1e-6), np.searchsorted(bn, (an + 1e-6) / least, side="right")
    for s in range(0, len(a), 32):
        e = min(s + 32, len(a))
        for t in range(max(lo[s], s) if once else lo[s], hi[e - 1], 2048):
            to = min(t + 2048, hi[e - 1])
            hits = np.flatnonzero(np.bitwise_count(a[s:e, None] ^ b[None, t:to]) <= tau)
            if len(hits):
                i, j = rows[s + hits // (to - t)], others[t + hits % (to - t)]
                ok = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6
                ok &= (i < j) | (not once)
                yield i[ok], j[ok]


def _meetings(side: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The indices, in a bucket, of rows in ``left`` and of those in ``right`` that they meet there."""
    if (side == 2).all():
        return [(np.flatnonzero(left), np.flatnonzero(right))]
    return [(np.flatnonzero(left & (side == k)), np.flatnonzero(right & (side == 1 - k))) for k in (0, 1)]


def _all_pairs(tau: int, least: float, count: bool):
    """(u, v), u < v, for all nodes that are alike; or only (n), about how many, which is estimated in large buckets."""

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, n: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, m in zip(*runs(key), strict=True):
            mine = node[s : s + m]
            rows, others = _meetings(side[s : s + m], *[np.ones(m, bool)] * 2)[0]
            times, found, whole = 1.0, 0, True
            if count and len(rows) > MANY:
                times, whole = len(rows) / SOME, False
                rows = np.sort(np.random.default_rng(m).choice(rows, SOME, replace=False))
            for i, j in _alike(fp[s : s + m], n[s : s + m], rows, others, tau, least, once=side[s] == 2 and whole):
                found += len(i) if whole or side[s] != 2 else int((mine[i] < mine[j]).sum())
                if not count:
                    x, y = mine[i], mine[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])
            if count and found:
                yield pa.RecordBatch.from_arrays([pa.array([int(found * times)])], ["n"])

    return _by_bucket(links)


def _way(key: np.ndarray, way: tuple, s: int) -> tuple[int, int]:
    """The first key and the path of the bucket that starts at row s."""
    return (int(way[0][s]), int(way[1][s])) if way else (int(key[s]), 0)


def _every_pair(tau: int, answers, count: bool):
    """(u, v), u < v, for all nodes within ``tau`` bits in a bucket, from the one that answers for them; or only (n), about how many, which is estimated in large buckets."""

    def links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, node: np.ndarray, *way) -> Iterator[pa.RecordBatch]:
        for s, n in zip(*runs(key), strict=True):
            held = probe[s : s + n]
            if n == 1 or held.all():
                continue
            order = np.argsort(fp[s : s + n], kind="stable")
            fps, mine = fp[s : s + n][order], node[s : s + n][order]
            stored, times = np.unique(fp[s : s + n][~held]), 1.0
            if count and len(stored) > MANY:
                times = len(stored) / SOME
                stored = np.sort(np.random.default_rng(n).choice(stored, SOME, replace=False))
            for a, b in close_pairs(stored, np.unique(fps), tau):
                once = (a <= b) & answers(a, b, *_way(key, way, s))
                a, b = a[once], b[once]
                (at, to), (at_b, to_b) = ((np.searchsorted(fps, x), np.searchsorted(fps, x, side="right")) for x in (a, b))
                many, wide = (to - at) * (to_b - at_b), to_b - at_b
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([int(many[a < b].sum() * times + (many[a == b] * (many[a == b] > 1)).sum() * times / 2)])], ["n"])
                elif many.sum():
                    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    i, j = np.repeat(at, many) + k // np.repeat(wide, many), np.repeat(at_b, many) + k % np.repeat(wide, many)
                    u, v = np.minimum(mine[i], mine[j]), np.maximum(mine[i], mine[j])
                    yield pa.RecordBatch.from_arrays([pa.array(u[u < v]), pa.array(v[u < v])], ["u", "v"])

    return _by_bucket(links)


def keyed(rows: DataFrame) -> DataFrame:
    """(key, fp, node, n, pos) for each of the _keys of ``rows`` (fp, node, n, _keys), pos being its place among them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            raw = [np.frombuffer(x, np.int64) for x in batch.column("_keys").to_pylist()]
            times = np.array([len(x) for x in raw], np.int64)
            if times.sum():
                pos = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own = [np.repeat(batch.column(c).to_numpy(), times) for c in ("fp", "node", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(raw), *own, pos.astype(np.int32))], ["key", "fp", "node", "n", "pos"])

    return rows.select("fp", "node", "n", "_keys").mapInArrow(each, "key long, fp long, node long, n long, pos int")


def _shared(links):
    """A function for mapInArrow over rows (key, ...) sorted by key, which gives ``links`` the columns of the rows whose key is not theirs alone, many whole buckets at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
            held[:] = [[c[end:] for c in cols]]
            same = cols[0][1:end] == cols[0][: end - 1] if end else np.zeros(0, bool)
            many = np.concatenate((same, [False])) | np.concatenate(([False], same)) if end else same
            if many.any():
                yield from links(*(c[:end][many] for c in cols))

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)])
                size += batch.num_rows
                if size >= CHUNK:
                    yield from whole(False)
                    size = 0
        if held:
            yield from whole(True)

    return each


def _met(key: np.ndarray, n: np.ndarray, pos: np.ndarray, least: float, rows: np.ndarray, placed: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows of one key whose sizes (and with ``placed`` places) allow a similarity of ``least``, of which one at least is in the mask ``rows``; rows are in order of key and n.

    Where a pair meets first, its sets have nothing before these places in common, so that no more than what is behind one of them is.
    """

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = n[i] >= least * n[j] - 1e-6
        if placed:
            ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least / (1 + least) * (n[i] + n[j]) - 1e-6
        return ok

    starts, lengths = runs(key)
    small = np.repeat(lengths, lengths) <= 32
    for step in range(1, 32):
        i = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        if not len(i):
            break
        i = i[(rows[i] | rows[i + step]) & allowed(i, i + step)]
        yield i, i + step
    for s, m in zip(starts[lengths > 32].tolist(), lengths[lengths > 32].tolist(), strict=True):
        own, sizes = s + np.flatnonzero(rows[s : s + m]), n[s : s + m]
        lo, hi = s + np.searchsorted(sizes, n[own] * least - 1e-6), s + np.searchsorted(sizes, (n[own] + 1e-6) / least, side="right")
        for a, x, y in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True):
            other = np.arange(x, y)
            other = other[(other > a) | ((other < a) & ~rows[x:y])]
            i, j = np.minimum(other, a), np.maximum(other, a)
            ok = allowed(i, j)
            yield i[ok], j[ok]


def _meetings_of(least: float):
    """The rows whose key is shared, with about how many others of the key each may be near (met)."""

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, *_) -> Iterator[pa.RecordBatch]:
        met, rows, times = np.zeros(len(key), np.int64), np.ones(len(key), bool), np.ones(len(key))
        for s, m in zip(*runs(key), strict=True):
            if m > MANY:
                rows[s : s + m], times[s : s + m] = False, m / SOME / 2
                rows[s + np.random.default_rng(m).choice(m, SOME, replace=False)] = True
        for i, j in _met(key, n, pos, least, rows):
            np.add.at(met, i, times[i].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, fp, node, n, pos, met)], ["key", "fp", "node", "n", "pos", "met"])

    return _shared(links)


def _candidates(least: float, ready: bool = False):
    """(u, v, bits) for all nodes that share a key and may be near, u < v, by how many bits their fingerprints differ; if rows say who is ready, for each u that is and v that is not, whatever their places."""

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, *now) -> Iterator[pa.RecordBatch]:
        rows = now[0] if ready else np.ones(len(key), bool)
        for i, j in _met(key, n, pos, least, rows, placed=not ready):
            if ready:
                i, j = i[rows[i] ^ rows[j]], j[rows[i] ^ rows[j]]
            u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)).astype(np.int32))], ["u", "v", "bits"])

    return _shared(links)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi], each of which has one at least."""
    out, k, level = np.empty(len(lo), values.dtype), np.frexp(hi - lo)[1] - 1, values
    for q in range(int(k.max(initial=-1)) + 1):
        some = k == q
        out[some] = np.minimum(level[lo[some]], level[hi[some] - (1 << q)])
        level = np.minimum(level[: -(1 << q)], level[1 << q :])  # of twice as many from each place on
    return out


def _lowest(least: float):
    """(node, low) for each row whose key is shared: the least node of the key, itself included, whose size allows a similarity of ``least``."""

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, n: np.ndarray, *_) -> Iterator[pa.RecordBatch]:
        lo, hi = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for s, m in zip(*runs(key), strict=True):
            sizes = n[s : s + m]
            lo[s : s + m] = s + np.searchsorted(sizes, sizes * least - 1e-6)
            hi[s : s + m] = s + np.searchsorted(sizes, (sizes + 1e-6) / least, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_least(node, lo, hi))], ["node", "low"])

    return _shared(links)


def _later(pairs: DataFrame, near) -> DataFrame:
    """(v): of candidates (u, v), u < v, the nodes that go when all are gone through in order.

    ``near`` gives those of some pairs that are near. In a round it is asked of pairs whose u stays; once
    there are ``SETTLED`` pairs or fewer, of all, and the driver goes through what is near.
    """
    out = pairs.sparkSession.createDataFrame([], "v long")
    while pairs.count() > SETTLED:
        held = cut(pairs.select(F.col("v").alias("u")).distinct())
        going = cut(near(cut(_by_id(pairs, held, "left_anti"))).select("v").distinct())
        out = cut(out.unionByName(going))
        pairs = cut(_by_id(_by_id(_by_id(pairs, held, "left_semi"), going, "left_anti"), going.withColumnRenamed("v", "u"), "left_anti"))
    gone: set[int] = set()
    for u, v in sorted((r.u, r.v) for r in near(pairs).collect()) if pairs.take(1) else ():
        if u not in gone:
            gone.add(v)
    return out.unionByName(pairs.sparkSession.createDataFrame([(v,) for v in gone], "v long"))


def drop_near_copies(docs: DataFrame, width: int = 5, tau: int = 14, least: float = 0.8, beyond: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies of a document that stays.

    Documents are near if the Jaccard similarity of their sets of shingles of ``width`` words is
    ``least`` or more. In order of ids (null last; rows with one id by their texts' hashes) a document
    goes if it is near one before it that stays. So of rows with equal sets one stays, and nothing
    goes for a document that went itself. Candidates are pairs that share one of their rarest shingles,
    as all near pairs do, with fingerprints of the sets within ``tau`` bits. With ``beyond``, those that
    differ in more bits, which fingerprints alone would lose, follow where both documents stay so far,
    until none of them is near: then no two that stay are near. Each is verified on whole sets. Texts
    without words have equal (empty) sets.
    """
    spark, rows = docs.sparkSession, with_row_key(docs)
    since = made()
    text = F.col(f"`{text_col}`")
    texts = rows.select(F.col(ROW_KEY).alias("_row"), text.alias("_text"))
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text"), F.col(ROW_KEY).alias("row"))
    common = spark.sparkContext.broadcast(common_shingles(texts, width))
    marked = table(shingle_sets(rows.select(F.col(ROW_KEY).alias("_row"), order.alias("o"), text.alias("_text")), width, least=least, common=common), "marked")
    found = marked.groupBy("_class").agg(F.min("o").alias("o"), F.min("fp").alias("fp"), F.min("_n").alias("n"))
    firsts = table(found.orderBy("o").select(F.monotonically_increasing_id().alias("node"), F.col("o.row").alias("_row"), "fp", "n"), "firsts")  # nodes in the order of ids
    gone = marked.select("_row").join(firsts.select("_row"), "_row", "left_anti")

    def rows_of(pairs: DataFrame) -> DataFrame:
        return cut(_by_id(firsts.select("node", "_row"), _nodes(pairs), "inner").select("_row", "node"))

    def possible(pairs: DataFrame) -> DataFrame:
        sketches = cut(_by_id(marked.select("_row", "_sketch"), rows_of(pairs), "inner").select("node", "_sketch"))
        return cut(_may_be_near(pairs.select("u", "v"), sketches, least))

    def near(pairs: DataFrame) -> DataFrame:
        sets = table(shingle_sets(_by_id(texts, rows_of(pairs), "inner").select("node", "_text"), width, whole=True), "sets")
        return cut(_near(pairs, sets, least))

    def counted(some: DataFrame) -> DataFrame:
        return table(by_bucket(some, "n").mapInArrow(_meetings_of(least), "key long, fp long, node long, n long, pos int, met long"), "shared")

    shared = counted(keyed(_by_id(marked.select("_row", "_keys"), firsts.select("_row", "fp", "node", "n"), "inner")))
    out = spark.createDataFrame([], "v long")
    while (shared.agg(F.sum("met")).first()[0] or 0) > FEW_PAIRS * shared.select("node").distinct().count():
        # Dense groups go by rounds: a node without one before it stays, and is compared with all that it meets; those leave or wait for the next round.
        low = cut(by_bucket(shared, "n").mapInArrow(_lowest(least), "node long, low long").groupBy("node").agg(F.min("low").alias("low")))
        ready = _by_id(shared, low.select("node", (F.col("low") == F.col("node")).alias("ready")), "inner").select("key", "fp", "node", "n", "pos", "ready")
        pairs = by_bucket(ready, "n").mapInArrow(_candidates(least, ready=True), "u long, v long, bits int").where(F.lit(beyond) | (F.col("bits") <= tau))
        gone_now = cut(near(possible(cut(pairs.distinct()))).select("v").distinct())
        out = cut(out.unionByName(gone_now))
        waiting = low.where("low < node").select("node").join(gone_now.withColumnRenamed("v", "node"), "node", "left_anti")
        shared = counted(_by_id(shared.drop("met"), waiting, "inner").select("key", "fp", "node", "n", "pos"))
        tidy(spark)
    pairs = cut(by_bucket(shared, "n").mapInArrow(_candidates(least), "u long, v long, bits int").distinct())
    settled = _settled(pairs, possible, near, tau) if beyond else _later(possible(pairs.where(F.col("bits") <= tau)), near)
    out = cut(out.unionByName(settled))
    gone = cut(gone.unionByName(_by_id(firsts.select("node", "_row"), out.withColumnRenamed("v", "node"), "inner").select("_row")))
    release(spark, since)  # all but the rows themselves
    tidy(spark)
    return _by_id(rows, gone.withColumnRenamed("_row", ROW_KEY), "left_anti").drop(ROW_KEY)


def _settled(pairs: DataFrame, possible, near, tau: int) -> DataFrame:
    """(v): of candidates (u, v, bits), u < v, the nodes that go when all are gone through in order, those within ``tau`` bits being asked first.

    What goes is right once no two that stay are near: then whatever went did so for one before it that stays.
    """
    known: list[DataFrame] = []

    def remembered(some: DataFrame) -> DataFrame:
        known.append(near(some))
        return known[-1]

    out = _later(possible(pairs.where(F.col("bits") <= tau)), remembered)
    tested = None
    while True:
        held = cut(out)
        open_ = _by_id(_by_id(pairs, held.withColumnRenamed("v", "u"), "left_anti"), held, "left_anti")
        # Those within tau bits of each other that stay at first have been asked.
        todo = cut(open_.where(F.col("bits") > tau) if tested is None else open_.join(tested, ["u", "v"], "left_anti"))
        more = remembered(possible(todo)) if todo.take(1) else todo
        if not more.take(1):
            return held
        tested = cut(open_.select("u", "v") if tested is None else tested.unionByName(todo.select("u", "v")))
        edges = known[0]
        for some in known[1:]:
            edges = edges.unionByName(some)
        known[:] = [cut(edges)]
        out = _later(known[0], lambda x: x)


def keep_out(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone``, whose one column has the name of the id in ``docs``."""
    return _by_id(docs, gone, "left_anti")
