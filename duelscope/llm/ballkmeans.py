"""Ball k-means on integer vectors: exact centroids and distances, few comparisons.

A cluster is a ball: its centroid and a radius that holds all its members.
Balls are neighbours if half the distance of their centroids is less than the
radius; only to neighbours can a ball lose members.  A member nearer to its
centroid than half the way to the nearest neighbour lies in the stable core and
is compared with none; the rest lies in annuli between the halves of the ways
to the first, second, ... neighbour, and is compared with those neighbours
alone whose half way it has passed.  All tests are of squared integers, with
ties counted as not stable, so the assignment is that of comparing with every
centroid, ties included.

The radius is carried from the round before: the farthest member as it was
assigned, and the way the centroid has moved since, rounded up.

A round is one pass over the written vectors: it assigns them, writes them with
their cluster, and sums each cluster in each task; the sums of a fixed number
of clusters go to the driver, and a lost executor costs a reread.

Defined cases: vectors that are null, of another length, or hold a null or a
component that is not finite are left out; components whose integer is beyond
2 ** 26 count as 2 ** 26 with their sign, since squared distances are longs; of
equal hashes of ids (repeated ids) the smaller vector comes first, an id that is
null comes last; fewer vectors than clusters make as many clusters as vectors;
repeated rows are vectors of their own; empty clusters keep their centroid; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean
from .shared import forget, stash

#: Four times a squared distance of 64 such components still is a long.
LIMIT = 1 << 26


@dataclass(frozen=True)
class Balls:
    """Centroids, and for each the centroids a member may go to, by squared distance."""

    centroids: np.ndarray  # (k, d) of long
    others: list[np.ndarray]  # neighbours of each ball, the nearest first
    ways: list[np.ndarray]  # their squared distances


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def balls(centroids: np.ndarray, radii: list[int] | None) -> Balls:
    """radii: the squared radius of each ball, -1 for one without members; none: every centroid is everyone's neighbour."""
    others, ways = [], []
    for i, c in enumerate(centroids):
        way = squared(centroids, c)
        near = np.ones(len(way), dtype=bool) if radii is None else np.array([int(w) <= 4 * radii[i] for w in way], dtype=bool)
        near[i] = False
        found = np.flatnonzero(near)
        found = found[np.argsort(way[found], kind="stable")]
        others.append(found)
        ways.append(way[found])
    return Balls(centroids, others, ways)


def grown(radius: int, moved: int) -> int:
    """The squared radius, rounded up, of a ball whose centroid has moved by the root of ``moved``."""
    return -1 if radius < 0 else radius + moved + 2 * (math.isqrt(radius * moved) + 1)


def assign(x: np.ndarray, at: np.ndarray, b: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, comparisons) of vectors that were in the clusters ``at``; the smaller number wins ties."""
    cluster, dist, made = at.copy(), np.empty(len(x), dtype=np.int64), 0
    for i in np.unique(at):
        rows = np.flatnonzero(at == i)
        members = x[rows]
        own = squared(members, b.centroids[i])
        best, to = own.copy(), np.full(len(rows), i, dtype=np.int32)
        passed = np.searchsorted(b.ways[i], 4 * own, side="right")  # neighbours whose half way lies no farther than the member
        made += len(rows)
        for k in range(int(passed.max(initial=0))):
            ring = np.flatnonzero(passed > k)
            j = b.others[i][k]
            d = squared(members[ring], b.centroids[j])
            made += len(ring)
            better = (d < best[ring]) | ((d == best[ring]) & (j < to[ring]))
            best[ring[better]], to[ring[better]] = d[better], j
        cluster[rows], dist[rows] = to, best
    return cluster, dist, made


def whole(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors that take part, as longs."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite)
    clipped = lambda v: F.least(F.greatest(v.cast("double") * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    return kept.select("vec_id", F.transform("embedding", lambda v: F.floor(clipped(v)).cast("long")).alias("x"))


def first_centroids(x: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id: a fixed number of rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = x.select(digest.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _round(rows: DataFrame, b: Balls, dims: int, name: str) -> DataFrame:
    """Each vector with its cluster and distance (kind 0), and each task's sums of each cluster (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(b.centroids)
        sums, count, far, total = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64), [0] * k
        fields = ["kind", "vec_id", "x", "cluster", "distance", "total"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, dims)
            cluster, dist, _ = assign(x, batch.column("cluster").to_numpy(), b)
            for i in np.unique(cluster):
                own = cluster == i
                sums[i] += x[own].sum(axis=0)
                count[i] += own.sum()
                far[i] = max(far[i], dist[own].max())
                total[i] += sum(map(int, dist[own].tolist()))
            none = pa.nulls(len(x), pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(np.zeros(len(x), np.int32)), batch.column("vec_id"), batch.column("x"), pa.array(cluster), pa.array(dist), none], names=fields)
        used = np.flatnonzero(count)
        if len(used):
            packed = pa.array([[int(count[i]), *sums[i].tolist()] for i in used], pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(np.ones(len(used), np.int32)), pa.nulls(len(used), pa.int64()), packed, pa.array(used.astype(np.int32)), pa.array(far[used]), pa.array([int(total[i]) for i in used], pa.decimal128(38, 0))], names=fields)

    return stash(rows.select("vec_id", "x", "cluster").mapInArrow(lean(run), "kind int, vec_id long, x array<bigint>, cluster int, distance long, total decimal(38,0)"), name, by="kind")


def _sums(done: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]], list[int], list[int]]:
    """(members, sums, squared radius, summed distance) of each cluster: k times dims + 2 rows reach the driver."""
    parts = done.where("kind = 1")
    each = parts.select("cluster", F.posexplode("x")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    count, sums, radius, total = [0] * k, [[0] * dims for _ in range(k)], [-1] * k, [0] * k
    for r in each.collect():
        if r["pos"]:
            sums[r["cluster"]][r["pos"] - 1] = int(r["s"])
        else:
            count[r["cluster"]] = int(r["s"])
    for r in parts.groupBy("cluster").agg(F.max("distance").alias("far"), F.sum("total").alias("t")).collect():
        radius[r["cluster"]], total[r["cluster"]] = r["far"], int(r["t"])
    return count, sums, radius, total


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the table's (vec_id, embedding)."""
    x = stash(whole(vectors, dims, scale), "vectors")
    centroids = first_centroids(x, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return x.sparkSession.createDataFrame([], schema)
    last, at, radii = x, x.withColumn("cluster", F.lit(0).cast("int")), None
    for step in range(rounds + 1):
        done = _round(at, balls(centroids, radii), dims, f"round{step}")
        count, sums, far, total = _sums(done, len(centroids), dims)
        forget(last)
        last, at = done, done.where("kind = 0")
        if step < rounds:
            new = np.array([[v // n for v in s] if n else c.tolist() for s, n, c in zip(sums, count, centroids)], dtype=np.int64)
            radii = [grown(r, int(m)) for r, m in zip(far, squared(new, centroids))]
            centroids = new
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    ends = x.sparkSession.createDataFrame([(i, total[i], digests[i]) for i in range(len(centroids))], "cluster int, cluster_inertia long, centroid_sha256 string")
    return at.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(total)).cast("long").alias("inertia"), "centroid_sha256")  # k rows


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same in DuckDB's SQL, by comparing every vector with every centroid in each round."""
    assigned = """a{r} as materialized (
  select vec_id, row, x, cluster, d from (
    select v.vec_id, v.row, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d,
      row_number() over (partition by v.row order by d, c.cluster) as nearest
    from v cross join c{r} c) where nearest = 1)"""
    moved = """m{r} as materialized (
  select cluster, list(m order by i) as c from (
    select cluster, i, floor_div(sum(x[i])::bigint, count(*)) as m from a{r} cross join range(1, {end}) g(i) group by cluster, i) group by cluster),
c{n} as materialized (select c{r}.cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (cluster))"""
    floor_div = "case when {s} % {n} < 0 then {s} // {n} - 1 else {s} // {n} end"
    moved = moved.replace("floor_div(sum(x[i])::bigint, count(*))", floor_div.format(s="sum(x[i])::bigint", n="count(*)"))
    steps = []
    for r in range(rounds):
        steps += [assigned.format(r=r), moved.format(r=r, n=r + 1, end=dims + 1)]
    steps.append(assigned.format(r=rounds))
    return f"""
with v as materialized (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e::double))) = {dims}),
c0 as materialized (
  select (row_number() over (order by h, x) - 1)::int as cluster, x as c from (select sha256('{seed}:' || vec_id::varchar) as h, x from v order by h, x limit {k})),
{(',' + chr(10)).join(steps)}
select vec_id, a.cluster, d as distance, (sum(d) over (partition by a.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c using (cluster)
"""


SQL = sql()
