"""Near-duplicate vectors by collision-counting projections.

A table of projections holds all sums of one direction out of each of ``blocks``
blocks of random directions, with either sign: (2 * DIRECTIONS) ** blocks of
them.  A vector takes part in the one on which it projects farthest, which is
the sum of the farthest of each block, so finding it costs blocks * DIRECTIONS
products.  The members of a projection are sorted by what they project to; two
collide if one lies in the window centred on the other.  There are ``tables``
such tables.  For each pair the tables in which it collides are counted, and
pairs that collide in at least ``needed`` are verified by their cosine.

What a pair of a given cosine collides with does not depend on the data or on
the dimension: its products with a random direction are a normal pair of that
correlation.  So windows, tables and the count are calibrated by simulating
pairs at the least cosine wanted: a pair there passes with probability RECALL,
nearer pairs more often.  More vectors take more blocks, so that unrelated
vectors seldom share a projection, and with them more tables.

Vectors that share no projection, or too few, with any other are out after a
count of members, for which only ids and keys are written and shuffled.  The
others are joined by the projections they share.  What is joined in at most
UNIT vectors goes once to one task, which compares all pairs of it.  Of what is
joined in more, each vector goes to each projection it shares; a projection of
many members is dealt out in blocks of pairs over tasks, and a pair is handled
in the first table in which it collides.  Either way links are summed without
ever writing pairs: tasks return links per vector, and a forest of the links
for union-find.  Equal vectors are one entity with a weight, however
often they occur.  Within a group of near, but not equal, copies every link is
verified, so the work of such a group grows with its number of links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length do not link; a row
with a null vec_id has the component of its vector, null if none of it has an
id, and is not kept; a repeated vec_id gives a row for each of its rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean, mix
from .linkage import grouped
from .shared import empty, forget, keyed, lookup, measured, stash
from .unionfind import components, forest

#: Directions of a block; with either sign twice as many.
DIRECTIONS = 128
#: Projections for each vector, at least, so that unrelated ones rarely meet.
SPREAD = 64
#: Collisions that a pair at the least cosine has on average.
AVERAGE = 8
RECALL = 0.99
#: Share of such pairs within a window.
WITHIN = 0.98
#: Members of a block of a large projection, the least and the most.
BLOCK = (128, 4096)
#: Most vectors, joined by shared projections, that one task compares in all pairs; so many rows of the product at once.
UNIT, ROWS = 16384, 256
#: Vectors that are projected, and pairs that are compared, at once.
STEP, PAIRS = 2_000, 1 << 20


@dataclass(frozen=True)
class Plan:
    """What decides where vectors meet."""

    cosine: float
    blocks: int
    tables: int
    window: float
    needed: int


@functools.lru_cache
def meeting(cosine: float, blocks: int) -> tuple[float, float]:
    """(probability that a pair of this cosine collides in a table, half width of the window), from 20,000 simulated ones."""
    rng = np.random.default_rng(20240229)
    same, gap = np.ones(20_000, dtype=bool), np.zeros(20_000)
    for _ in range(blocks):
        x = rng.standard_normal((20_000, DIRECTIONS), dtype=np.float32)
        y = np.float32(cosine) * x + np.float32(math.sqrt(1 - cosine * cosine)) * rng.standard_normal(x.shape, dtype=np.float32)
        at = np.arange(len(x)), np.abs(x).argmax(axis=1)
        same &= (np.abs(y).argmax(axis=1) == at[1]) & (np.sign(x[at]) == np.sign(y[at]))
        gap += np.abs(x[at]) - np.abs(y[at])
    window = float(np.quantile(np.abs(gap[same]), WITHIN))
    return float(same.mean()) * WITHIN, window


def planned(vectors: int, cosine: float) -> Plan:
    """Blocks by the number of vectors; the largest count that a pair at the least cosine reaches with probability RECALL."""
    blocks = 2
    while (2 * DIRECTIONS) ** blocks < SPREAD * vectors:
        blocks += 1
    p, window = meeting(cosine, blocks)
    tables = math.ceil(AVERAGE / p)
    needed, missed = 1, (1 - p) ** tables
    while (missed := missed + math.comb(tables, needed) * p**needed * (1 - p) ** (tables - needed)) <= 1 - RECALL:
        needed += 1
    return Plan(cosine, blocks, tables, window, needed)


@functools.lru_cache(maxsize=256)
def _directions(dims: int, table: int, blocks: int) -> np.ndarray:
    return np.random.default_rng([dims, table, blocks]).standard_normal((dims, blocks * DIRECTIONS), dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; large and small ones do not overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projected(x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(projection, value) of unit vectors of one length, a column for each table."""
    x = x.astype(np.float32)
    key, value = np.empty((len(x), plan.tables), dtype=np.uint64), np.zeros((len(x), plan.tables), dtype=np.float32)
    rows = np.arange(len(x))
    for t in range(plan.tables):
        h = x @ _directions(x.shape[1], t, plan.blocks)
        k = np.full(len(x), (x.shape[1] << 32) + t, dtype=np.uint64)
        for b in range(plan.blocks):
            part = h[:, b * DIRECTIONS : (b + 1) * DIRECTIONS]
            at = np.abs(part).argmax(axis=1)
            far = part[rows, at]
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + (2 * at + (far < 0)).astype(np.uint64))
            value[:, t] += np.abs(far)
        key[:, t] = k
    return key.view(np.int64), value


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of an array column, some of one length at a time."""
    sizes = np.array([len(v) for v in column], dtype=np.int64)
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        for lo in range(0, len(rows), STEP):
            at = rows[lo : lo + STEP]
            yield at, unit(flat[first[at][:, None] + np.arange(dims)])


def _listed(rows: pa.Array, tables: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) // tables + 1, dtype=np.int32) * tables), rows)


def _keys(vectors: DataFrame, plan: Plan) -> DataFrame:
    """(ent, dims, keys): the projections of each vector, half of a key's bits for each table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column("embedding")):
                keys = projected(x, plan)[0].astype(np.int32)
                yield pa.record_batch([batch.column("ent").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), _listed(pa.array(keys.ravel()), plan.tables)], names=["ent", "dims", "keys"])

    return vectors.select("ent", "embedding").mapInArrow(lean(run), "ent long, dims int, keys array<int>")


def _joined(lists: DataFrame, plan: Plan) -> DataFrame:
    """(ent, root): which candidates the projections join, directly or by others between them."""
    rows = lists.select("ent", "dims", F.posexplode("keys").alias("t", "k")).select("ent", F.xxhash64("dims", "t", "k").alias("key"))
    for _ in range(2):  # who meets nobody often enough may have been all that others met
        shared = stash(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared")
        hits = stash(keyed(rows, shared, ["key"], "left_semi"), "hits")
        enough = stash(hits.groupBy("ent").agg(F.count("*").alias("n")).where(F.col("n") >= plan.needed).select("ent"), "enough")
        rows = stash(keyed(hits, enough, ["ent"], "left_semi"), "candidates")
        forget(shared, hits, enough)
    firsts = stash(rows.groupBy("key").agg(F.min("ent").alias("first"), F.count("*").alias("m")).where("m > 1").select("key", "first"), "firsts")
    met = stash(keyed(rows, firsts, ["key"], "inner").where("ent <> first").select(F.col("ent").alias("a"), F.col("first").alias("b"), "key"), "met")
    least = min(2, plan.needed)
    strong = components(met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b"))
    if least == 1:
        return strong
    # unrelated vectors share a single projection by chance: what is joined so far joins further by two of them
    ends = met
    for c in ("a", "b"):
        ends = keyed(ends, strong.withColumnsRenamed({"ent": c, "root": f"{c}_root"}), [c], "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    further = components(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "key").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b"))
    if empty(further):
        return strong
    moved = keyed(strong.withColumn("end", F.col("root")), further.withColumnsRenamed({"ent": "end", "root": "to"}), ["end"], "left").select("ent", F.coalesce("to", "root").alias("root"))
    alone = keyed(further, strong.select("ent"), ["ent"], "left_anti").select("ent", "root")
    return stash(moved.unionByName(alone), "joined")


def _placed(entities: DataFrame, plan: Plan) -> DataFrame:
    """(ent, copies, vector, keys, values): the unit vector, its projections, and where it lies in them, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column("embedding")):
                keys, values = projected(x, plan)
                some = batch.select(["ent", "copies"]).take(pa.array(at))
                yield pa.record_batch([*some.columns, pa.array([v.tobytes() for v in x], pa.binary()), _listed(pa.array(keys.ravel()), plan.tables), pa.array([v.tobytes() for v in values], pa.binary())], names=["ent", "copies", "vector", "keys", "values"])

    return entities.mapInArrow(lean(run), "ent long, copies long, vector binary, keys array<bigint>, values binary")


class Members:
    """Some members of one projection: who they are and where they collide."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, plan: Plan):
        part = batch.slice(lo, hi - lo)
        self.ent, self.copies = part.column("ent").to_numpy(), part.column("copies").to_numpy()
        self.x = np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=np.float64).reshape(hi - lo, -1)
        self.keys = np.ascontiguousarray(part.column("keys").flatten().to_numpy().reshape(hi - lo, plan.tables).T)
        self.values = np.ascontiguousarray(np.frombuffer(b"".join(part.column("values").to_pylist()), dtype=np.float32).reshape(hi - lo, plan.tables).T)
        self.block, self.plan = part.column("block").to_numpy(), plan

    def collide(self, t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.keys[t][a] == self.keys[t][b]) & (np.abs(self.values[t][a] - self.values[t][b]) <= self.plan.window)

    def windows(self, t: int, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b) of this projection's window: of block i and block j, or within one block; a bounded number at a time."""
        order = np.argsort(self.values[t], kind="stable")
        value, block = self.values[t][order], self.block[order]
        end = np.searchsorted(value, value + np.float32(self.plan.window), side="right")
        many = end - np.arange(len(order)) - 1
        lo = 0
        while lo < len(order):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(many[lo:]), PAIRS, side="right")))
            a = np.repeat(np.arange(lo, hi), many[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
            if i != j:
                across = block[a] != block[b]
                a, b = a[across], b[across]
            yield order[a], order[b]
            lo = hi

    def links(self, t: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs whose first collision is in table t."""
        found = []
        for a, b in self.windows(t, i, j):
            for s in range(t):
                later = ~self.collide(s, a, b)
                a, b = a[later], b[later]
            hits, open_ = self.collide(t, a, b).astype(np.int16), np.arange(len(a))
            for s in range(t + 1, self.plan.tables):
                open_ = open_[hits[open_] < self.plan.needed]
                if not len(open_):
                    break
                hits[open_] += self.collide(s, a[open_], b[open_])
            passed = np.flatnonzero(hits >= self.plan.needed)
            for lo in range(0, len(passed), 1 << 16):
                x, y = a[passed[lo : lo + (1 << 16)]], b[passed[lo : lo + (1 << 16)]]
                near = np.einsum("ij,ij->i", self.x[x], self.x[y]) >= self.plan.cosine
                found.append((x[near], y[near]))
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _linked(members: DataFrame, plan: Plan) -> DataFrame:
    """Links per vector (kind 0: ent, other rows linked by pairs of this task) and a forest of them (kind 1: two ends)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["key", "i", "j"]
        for batch in grouped(batches, by):
            columns = [batch.column(c).to_numpy() for c in by]
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(change) + 1, batch.num_rows]
            tables = batch.column("t").to_numpy()
            ent, n, ends, roots = [], [], [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo < 2:
                    continue
                m = Members(batch, int(lo), int(hi), plan)
                a, b = m.links(int(tables[lo]), int(columns[1][lo]), int(columns[2][lo]))
                if not len(a):
                    continue
                links = np.bincount(a, m.copies[b], hi - lo) + np.bincount(b, m.copies[a], hi - lo)
                some = np.flatnonzero(links)
                ent.append(m.ent[some])
                n.append(links[some].astype(np.int64))
                x, y = forest(m.ent[a], m.ent[b])
                ends.append(x[x != y])
                roots.append(y[x != y])
            if ent:
                yield _told((np.concatenate(ent), np.concatenate(n)), (np.concatenate(ends), np.concatenate(roots)))

    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lean(run), "kind int, ent long, other long")


def _told(n: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Links per vector as kind 0 and a forest of them as kind 1."""
    kinds = np.r_[np.zeros(len(n[0]), np.int32), np.ones(len(ends[0]), np.int32)]
    return pa.record_batch([pa.array(kinds), pa.array(np.concatenate([n[0], ends[0]])), pa.array(np.concatenate([n[1], ends[1]]))], names=["kind", "ent", "other"])


def within(x: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a < b) of unit vectors with at least this cosine; a bounded number at a time."""
    for lo in range(0, len(x), ROWS):
        near = x[lo : lo + ROWS] @ x[lo:].T
        a, b = np.nonzero(near >= cosine - 1e-9)
        a, b, near = a + lo, b + lo, near[a, b]
        close = np.flatnonzero(near < cosine + 1e-9)  # a product of matrices may round in another order
        near[close] = np.einsum("ij,ij->i", x[a[close]], x[b[close]])
        linked = (a < b) & (near >= cosine)
        yield a[linked], b[linked]


def _compared(members: DataFrame, cosine: float) -> DataFrame:
    """The same as ``_linked`` of (root, ent, copies, embedding): all pairs of those with one root are compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["root"]):
            root, copies = batch.column("root").to_numpy(), batch.column("copies").to_numpy()
            starts = np.r_[0, np.flatnonzero(root[1:] != root[:-1]) + 1, len(root)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                part = batch.slice(lo, hi - lo)
                ents, first = np.unique(part.column("ent").to_numpy(), return_index=True)
                column = part.column("embedding").take(pa.array(first))
                places = [(at, x) for at, x in _by_length(column)]
                many = copies[lo:hi][first]
                for dims in {x.shape[1] for _, x in places}:
                    at = np.concatenate([p for p, x in places if x.shape[1] == dims])
                    ent, weight = ents[at], many[at]
                    n, ends = np.zeros(len(at)), []
                    for a, b in within(np.concatenate([x for _, x in places if x.shape[1] == dims]), cosine):
                        n += np.bincount(a, weight[b], len(at)) + np.bincount(b, weight[a], len(at))
                        if len(a):
                            ends.append(forest(ent[a], ent[b]))
                    if ends:
                        x, y = forest(*(np.concatenate(e) for e in zip(*ends)))
                        yield _told((ent[n > 0], n[n > 0].astype(np.int64)), (x[x != y], y[x != y]))

    return members.mapInArrow(lean(run), "kind int, ent long, other long")


def _links(vectors: DataFrame, entities: DataFrame, joined: DataFrame, plan: Plan) -> DataFrame:
    """Links per vector and a forest of them, over all that the projections join."""
    sizes = stash(joined.groupBy("root").agg(F.count("*").alias("members")), "sizes")
    large = stash(sizes.where(F.col("members") > UNIT), "large")
    some = stash(keyed(keyed(joined, sizes, ["root"], "inner"), entities.select("ent", "copies"), ["ent"], "inner"), "members")
    if empty(some):
        return some.select(F.lit(0).alias("kind"), "ent", F.lit(0).cast("long").alias("other"))
    wide = keyed(vectors, some, ["ent"], "inner")
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), vectors.sparkSession.sparkContext.defaultParallelism)
    units = wide.where(F.col("members") <= UNIT).select("root", "ent", "copies", "embedding").repartition(tasks, "root").sortWithinPartitions("root", "ent")
    links = _compared(units, plan.cosine)
    if empty(large):
        return links
    once = wide.where(F.col("members") > UNIT).groupBy("ent").agg(F.first("copies").alias("copies"), F.first("embedding").alias("embedding"))
    return links.unionByName(_linked(_dealt(stash(_placed(once, plan), "placed"), plan), plan))


def _dealt(placed: DataFrame, plan: Plan) -> DataFrame:
    """The members of projections that are shared: (key, i, j, block, t, ent, copies, vector, keys, values), a row for each pair of blocks."""
    some = placed
    for _ in range(2):  # who meets nobody often enough may have been all that others met
        lists = some.select("ent", F.explode("keys").alias("key"))
        shared = stash(lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
        hits = keyed(lists, shared, ["key"], "inner")
        enough = stash(hits.groupBy("ent").agg(F.count("*").alias("n")).where(F.col("n") >= plan.needed).select("ent"), "enough")
        some = stash(keyed(some, enough, ["ent"], "left_semi"), "candidates")
    rows = keyed(some.select("*", F.posexplode("keys").alias("t", "key")), shared, ["key"], "inner")
    least, most = BLOCK
    size = F.least(F.greatest(F.ceil(F.col("m") / 8), F.lit(least)), F.lit(most))
    blocks = F.ceil(F.col("m") / size).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("ent", "key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "t", "ent", "copies", "vector", "keys", "values")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of (vec_id, embedding)."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.col("embedding")).alias("embedding"))
    rows = rows.withColumn("ent", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    entities = stash(rows.where("ent is not null").groupBy("ent").agg(F.count("*").alias("copies"), F.min("vec_id").alias("smallest")), "entities")
    plan = planned(measured(entities)[0], cosine)
    # one row of each vector; rows that are equal in vec_id too stay, and count as one where they are compared
    repeated = stash(entities.where("copies > 1").select("ent", "smallest", F.lit(True).alias("again")), "repeated")
    vectors = rows.where("ent is not null")
    vectors = (vectors if empty(repeated) else keyed(vectors, repeated, ["ent"], "left").where("again is null or vec_id <=> smallest")).select("ent", "embedding")
    lists = stash(_keys(vectors, plan), "keys")
    joined = _joined(lists, plan)
    forget(lists)
    links = stash(_links(vectors, entities, joined, plan), "links", by="kind")
    roots = components(links.where("kind = 1").select(F.col("ent").alias("a"), F.col("other").alias("b")))
    counts = links.where("kind = 0").groupBy("ent").agg(F.sum("other").alias("n"))
    some = keyed(keyed(entities.select("ent", "copies", "smallest"), stash(counts, "counts"), ["ent"], "left"), roots, ["ent"], "left").where("copies > 1 or n is not null")
    some = stash(some.select("ent", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "smallest", F.coalesce("root", "ent").alias("root")), "found")
    firsts = stash(some.groupBy("root").agg(F.min("smallest").alias("component_id")), "firsts")
    found = stash(keyed(some.select("ent", "n_links", "root"), firsts, ["root"], "left").select("ent", "n_links", "component_id"), "found")
    out = rows.select("vec_id", "ent") if empty(found) else lookup(rows.select("vec_id", "ent"), found, "ent")
    if empty(found):
        out = out.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: The same rows in DuckDB's SQL by comparing all pairs, where the operator finds every link.
SQL = r"""
with recursive v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda e: e::double) as x from embeddings),
u as materialized (
  select row, vec_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) as x from v
  where len(x) > 0 and len(list_filter(x, lambda e: e is not null and isfinite(e))) = len(x) and len(list_filter(x, lambda e: e <> 0)) > 0),
l as materialized (
  select a.row as a, b.row as b from u a join u b on a.row <> b.row and len(a.x) = len(b.x) and list_inner_product(a.x, b.x) >= 0.95),
reach(row, r) as (select row, row from v union select reach.row, l.b from reach join l on l.a = reach.r),
c as (select reach.row, min(v.vec_id) as component_id from reach join v on v.row = reach.r group by reach.row),
n as (select a as row, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) as kept from v join c using (row) left join n using (row)
"""
