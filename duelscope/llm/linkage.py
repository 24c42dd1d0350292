"""Links between similar sets that share a bucket, found without listing all pairs of a group.

Rows (token, ent, n, pos) say that entity ``ent``, a set of ``n`` elements,
stands in bucket ``token`` (with ``pos`` smaller elements before it, or 0).
The caller promises that two similar sets share a bucket.  Wanted are the
connected components of "similar", so a pair whose ends are known to be
connected need not be compared:

1. In small buckets all pairs become candidates; in large ones, where a group
   of near copies would give the square of its size, only neighbours in a few
   pseudo-random orders do.  A large bucket is dealt out by a hash of its
   members first, so that no task holds it.
2. Candidates are compared exactly and joined by distributed union-find.
3. Large buckets that still hold several components are gone through for all
   pairs across them.  Where that would be too many pairs, a bucket is divided
   by a second element first: of two similar sets, prefixes that are one
   element longer share two elements.  So sets that have no more in common
   than the bucket's element never meet.

No pair is left out but those already connected, and none is compared twice.
A divided bucket is dealt out over several tasks: members of its largest
component once, the others to every share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import PARITY_BITS, lean, mix, needed, similar, spread
from .shared import empty, forget, keyed, lookup, sent, stash
from .unionfind import components

SMALL = 32
ORDERS = 6
SHARE = 2048
#: Pairs across components above which a bucket is divided by a second element.
MANY_PAIRS = 1 << 20


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches in which no group of rows with equal ``by`` is cut; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [_column(batch, k) for k in by]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = np.flatnonzero(change)
        if held and any(_column(held[-1], k)[-1] != v[0] for k, v in zip(by, keys)):
            yield _joined(held)
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        at = int(cuts[-1]) + 1
        yield _joined([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


def paired(batches: Iterator[pa.RecordBatch], always: str | None = None, alone: str | None = None) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, ent) those whose token another entity has too, each entity once; batch by batch.

    always: a column of numbers; rows in which it is not negative are kept whatever their token.
    alone: a column of truth values; entities for which it holds are kept although they may be the only one.
    """
    last: pa.RecordBatch | None = None  # the last distinct row, and whether it was given out
    given = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        token, ent = _column(batch, "token"), _column(batch, "ent")
        free = _column(batch, always) >= 0 if always else np.zeros(len(token), dtype=bool)
        once = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (ent[1:] != ent[:-1])] | free)
        t = token[once]
        alike = np.r_[False, t[1:] == t[:-1]]
        keep = alike | np.r_[alike[1:], False] | free[once]
        if alone:
            keep |= _column(batch, alone)[once]
        end = int(once[-1])
        was_kept = bool(keep[-1])
        if last is not None and given:
            keep[0] = False
            was_kept = was_kept or len(once) == 1
        out = once[keep]
        if len(out):
            yield batch.take(pa.array(out))
        last, given = batch.slice(end, 1), was_kept


#: Parts into which the rows of a token are dealt that many entities have.
PARTS = 256


def shared_only(rows: DataFrame) -> DataFrame:
    """The rows of buckets with two entities or more, each entity once.

    Rows (token, ent, n, pos) and perhaps ``common``: where it holds, the bucket is
    large for sure or shares a hash class with a large one; its rows are dealt
    out over many tasks and all kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in paired(batches, alone="common"):
            yield batch.select(["token", "ent", "n", "pos"])

    rows = rows if "common" in rows.columns else rows.withColumn("common", F.lit(False))
    dealt = rows.select("token", "ent", "n", "pos", "common").repartition(F.when(F.col("common"), F.xxhash64("token", F.pmod("ent", F.lit(PARTS)))).otherwise(F.col("token")))
    return dealt.sortWithinPartitions("token", "ent").mapInArrow(lean(run), "token long, ent long, n int, pos int")


class Bucket:
    """Pairs of rows of some buckets that length and position allow."""

    def __init__(self, ent, n, pos, percent: int):
        self.ent, self.n, self.pos, self.percent = ent, n.astype(np.int64), pos.astype(np.int64), percent

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        need = needed(self.n[x], self.n[y], self.percent)
        return (np.minimum(self.n[x] - self.pos[x], self.n[y] - self.pos[y]) >= need) & (self.ent[x] != self.ent[y])

    def ordered(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(self.ent[x], self.ent[y]), np.maximum(self.ent[x], self.ent[y])


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        both = np.unique(np.stack([np.concatenate(v) for v in zip(*found)], axis=1), axis=0)
        if len(both):
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (token, ent, n, pos, m), where m is null in small buckets.

    All pairs of small buckets; of large ones those next to each other in
    pseudo-random orders.  Linear in the rows, and no group is large.
    """
    shares = F.ceil(F.col("m") / SHARE)
    order = lambda r: F.struct(F.xxhash64("token", r, F.pmod(F.xxhash64("ent", r), shares)).alias("at"), F.xxhash64(r, "ent").alias("key"))
    orders = F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), order)
    whole = F.array(F.struct(F.col("token").alias("at"), F.col("ent").alias("key")))
    dealt = rows.withColumn("big", F.col("m").isNotNull()).withColumn("place", F.explode(F.when(F.col("m").isNull(), whole).otherwise(orders)))
    dealt = dealt.select("place.at", "place.key", "big", "ent", "n", "pos").repartition("at").sortWithinPartitions("at", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["at"]):
            at, big = _column(batch, "at"), _column(batch, "big")
            b = Bucket(_column(batch, "ent"), _column(batch, "n"), _column(batch, "pos"), percent)
            found = []
            for step in range(1, SMALL):
                x = np.flatnonzero((at[step:] == at[:-step]) & (~big[step:] | (step == 1))) if len(at) > step else np.empty(0, np.int64)
                if not len(x):
                    break
                y = x + step
                k = b.allowed(x, y)
                found.append(b.ordered(x[k], y[k]))
            yield from _pairs(found)

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket's share that lie in different components and whose parity maps allow it.

    Rows with ``inner`` (of the bucket's largest component) stand in one share;
    the others stand in all.  Two of the others are compared in the share that is
    ``own`` to the one with the smaller ent: rows may come in another order in
    each share, so their places say nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["token", "share"]):
            token, share, inner, root = (_column(batch, c) for c in ("token", "share", "inner", "root"))
            b = Bucket(_column(batch, "ent"), _column(batch, "n"), _column(batch, "pos"), percent)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint64).reshape(len(token), -1)
            own, ent = _column(batch, "own"), b.ent
            starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (share[1:] != share[:-1])])
            found, held = [], 0
            for lo, hi in zip(starts, np.r_[starts[1:], len(token)]):
                here = np.arange(lo, hi)
                for x in here[~inner[lo:hi]]:
                    y = here[inner[lo:hi] | ((ent[here] > ent[x]) & (own[x] == share[x]))]
                    y = y[root[y] != root[x]]
                    xs = np.full(len(y), x)
                    k = b.allowed(xs, y)
                    xs, y = xs[k], y[k]
                    far = np.bitwise_count(bits[xs] ^ bits[y]).sum(axis=1)
                    k = far <= b.n[xs] + b.n[y] - 2 * needed(b.n[xs], b.n[y], percent)
                    found.append(b.ordered(xs[k], y[k]))
                    held += int(k.sum())
                    if held > 200_000:
                        yield from _pairs(found)
                        found, held = [], 0
            yield from _pairs(found)

    return rows.repartition("token", "share").sortWithinPartitions("token", "share").mapInArrow(lean(run), "a long, b long").distinct()


def hashed_sets(members: list[bytes]) -> list[np.ndarray]:
    """Sets that were sent as their sorted hashes."""
    return [np.frombuffer(m, np.uint64) for m in members]


Decode = Callable[[list[bytes]], list[np.ndarray]]
Fetch = Callable[[DataFrame], DataFrame]


def _compared(pairs: DataFrame, info: DataFrame, fetch: Fetch | None, decode: Decode, percent: int) -> DataFrame:
    """The pairs that are similar; parity maps go first, then each pair is compared exactly once."""
    def possible(batch: pa.RecordBatch) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, PARITY_BITS // 64) for c in ("bits_a", "bits_b"))
        n = _column(batch, "n_a").astype(np.int64), _column(batch, "n_b").astype(np.int64)
        return np.flatnonzero(np.bitwise_count(x ^ y).sum(axis=1) <= n[0] + n[1] - 2 * needed(*n, percent))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).take(pa.array(possible(batch)))

    def links_of(part: pa.RecordBatch) -> pa.RecordBatch:
        ends = [part.column(c).to_pylist() for c in ("a", "b")]
        texts: dict[int, bytes] = {}
        for ids, c in zip(ends, ("set_a", "set_b")):
            texts.update(zip(ids, part.column(c).to_pylist()))
        sets = dict(zip(texts, decode(list(texts.values()))))
        counts = {e: spread(s) for e, s in sets.items()}
        k = np.array([similar(sets[a], sets[b], percent, (counts[a], counts[b])) for a, b in zip(*ends)], dtype=bool)
        return pa.record_batch([pa.array(_column(part, c)[k]) for c in ("a", "b")], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield links_of(batch.slice(lo, 512))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = batch.take(pa.array(possible(batch)))
                for lo in range(0, part.num_rows, 512):
                    yield links_of(part.slice(lo, 512))

    known = ["n", "bits"] if fetch else ["n", "bits", "members"]
    side = lambda s: info.select(F.col("ent").alias(s), *[F.col(c).alias(f"{'set' if c == 'members' else c}_{s}") for c in known])
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    if fetch is None:
        return stash(wide.mapInArrow(lean(both), "a long, b long"), "links")
    maybe = stash(wide.mapInArrow(lean(near), "a long, b long"), "maybe")
    if empty(maybe):
        return maybe
    ends = stash(maybe.select(F.explode(F.array("a", "b")).alias("ent")).distinct().join(info.drop("n", "bits"), "ent"), "ends")
    sets = stash(keyed(fetch(ends), ends.select("ent"), ["ent"], "left_semi").dropDuplicates(["ent"]), "sets")
    a, b = (sets.select(F.col("ent").alias(s), F.col("members").alias(f"set_{s}")) for s in "ab")
    links = stash(maybe.join(a, "a").join(b, "b").mapInArrow(lean(exact), "a long, b long"), "links")
    forget(maybe, ends, sets)
    return links


def _divided(rows: DataFrame, info: DataFrame, fetch: Fetch | None, decode: Decode, order: Callable[[np.ndarray], np.ndarray], percent: int) -> DataFrame:
    """The rows (token, ent, n, root), once for each element of a longer prefix, with a token of both; pos is 0.

    Two similar sets of more than one element share two elements of prefixes
    that are one longer than is needed to share one; so beside the element of
    their bucket, if it is one, they share another.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                token, out = _column(part, "token"), []
                for i, s in enumerate(decode(part.column("members").to_pylist())):
                    first = s[order(s)][: len(s) - -(-percent * len(s) // 100) + 2]
                    first = first[first.view(np.int64) != token[i]]
                    out.append((mix(first * np.uint64(0x9E3779B97F4A7C15) + token[i : i + 1].view(np.uint64)).view(np.int64), i))
                if out:
                    at = np.repeat([i for _, i in out], [len(k) for k, _ in out]).astype(np.int64)
                    n = len(at)
                    yield pa.record_batch([pa.array(np.concatenate([k for k, _ in out])), pa.array(_column(part, "ent")[at]), pa.array(_column(part, "n")[at]), pa.array(np.zeros(n, np.int32)), pa.array(_column(part, "root")[at])], names=["token", "ent", "n", "pos", "root"])

    if fetch is None:
        sets = info.select("ent", "members")
    else:
        ends = stash(rows.select("ent").distinct().join(info.drop("n", "bits"), "ent"), "ends")
        sets = stash(keyed(fetch(ends), ends.select("ent"), ["ent"], "left_semi").dropDuplicates(["ent"]), "sets")
    return rows.select("token", "ent", "n", "root").join(sets, "ent").select("token", "ent", "n", "root", "members").mapInArrow(lean(run), "token long, ent long, n int, pos int, root long")


def _open_buckets(rows: DataFrame) -> DataFrame:
    """(token, main, all, top) of buckets whose rows (token, ent, root) lie in several components."""
    sizes = rows.groupBy("token", "root").count()
    main = sizes.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("top"))
    return main.where("top < all")


def _dealt(rows: DataFrame, main: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs across the components of these buckets."""
    shares = sent(main).select("token", "main", F.ceil(F.col("all") / SHARE).cast("int").alias("shares"))
    placed = rows.join(shares, "token").join(info.select("ent", "bits"), "ent")
    placed = placed.withColumn("inner", F.col("root") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("ent"), "shares").cast("int"))
    placed = placed.withColumn("share", F.explode(F.when(F.col("inner"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))))
    return _across(placed.select("token", "share", "inner", "own", "root", "ent", "n", "pos", "bits"), percent)


def linked(buckets: DataFrame, info: DataFrame, fetch: Fetch | None, decode: Decode = hashed_sets, percent: int = 80, order: Callable[[np.ndarray], np.ndarray] = lambda s: np.arange(len(s))) -> DataFrame:
    """(ent, root) of every entity that is similar to another one.

    buckets: a stashed result of ``shared_only``.  info: a stashed row (ent, n,
    bits, and where the entity is found, or its members) for each entity of the
    buckets.  fetch: for rows of ``info`` without n and bits, (ent, members) of
    at least these entities; none where info has them.  decode: members to
    sorted 64-bit hashes.  order: the places of such a set's elements, rare
    first where tokens are elements of a set.
    """
    large = stash(buckets.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > SMALL), "large")
    rows = buckets.withColumn("m", F.lit(None).cast("long")) if empty(large) else lookup(buckets, large, "token")
    compared = stash(_neighbours(rows, percent), "pairs")
    links = _compared(compared, info, fetch, decode, percent)
    roots = components(links)
    if empty(large):
        return roots
    rooted = keyed(buckets, large.select("token"), ["token"], "left_semi")
    rooted = stash(keyed(rooted, roots, ["ent"], "left").withColumn("root", F.coalesce("root", "ent")), "rooted")
    main = stash(_open_buckets(rooted), "open")
    if empty(main):
        return roots
    many = F.col("all") * (F.col("all") - F.col("top")) > MANY_PAIRS
    few, much = stash(main.where(~many), "few"), stash(main.where(many), "much")
    pairs = _dealt(rooted, few, info, percent)
    if not empty(much):
        parts = stash(_divided(keyed(rooted, much.select("token"), ["token"], "left_semi"), info, fetch, decode, order, percent), "divided")
        pairs = pairs.unionByName(_dealt(parts, stash(_open_buckets(parts), "open"), info, percent)).distinct()
    pairs = stash(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
    if empty(pairs):
        return roots
    more = _compared(pairs, info, fetch, decode, percent)
    return roots if empty(more) else components(links.unionByName(more))
