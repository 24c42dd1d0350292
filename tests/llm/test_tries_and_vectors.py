"""Conversation trie, ball k-means and near-duplicate vectors against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelscope.llm import ballkmeans, neardup, prefixtrie, scan

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
EXTRA = ("place", "path", "key", "ent", "n1", "up", "cluster", "x", "kind", "copies")


def extended(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


# ---- running totals


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_totals_of_groups_that_span_ranges(spark, parts):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 50), rng.randint(-(2**62), 2**62)) for g in [1] * 400 + [2] * 3 + [3] * 90 + [4] + [9] * 200 for _ in (0,)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = scan.running(spark.createDataFrame(rows, "g long, o long, v long"), "g", ["o"], ["v"], "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = collections.defaultdict(list)
    for r in got:
        by[r["g"]].append(r)
    assert sorted((r["g"], r["o"], r["v"]) for r in got) == sorted(rows)
    for group in by.values():
        group.sort(key=lambda r: r["place"])
        assert [r["place"] for r in group] == list(range(1, len(group) + 1))
        assert [r["o"] for r in group] == sorted(r["o"] for r in group)
        total = 0
        for r in group:
            total = scan._wrapped(total + r["v"])
            assert r["sum_v"] == total


def test_running_totals_of_an_empty_table(spark):
    assert scan.running(spark.createDataFrame([], "g long, o long, v long"), "g", ["o"], ["v"], "test").count() == 0


# ---- the trie


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = ((len(members[node]) - 1) * len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(11)
    rows, first = [], ("user", "hello there")
    for c in [*range(0, 240), 777, 900, -3, -150]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, *(first if t == 0 and c % 3 else (rng.choice(["user", "assistant", None]), "".join(rng.choices("ab é😀", k=rng.randint(0, 3)))))))
    for c in range(1000, 1080):  # a large group of copies
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    for c in (2000, 2001):  # one long conversation twice, but for its last turn
        rows += [(c, t, "user", f"long {t}") for t in range(900)] + [(c, 900, "user", str(c))]
    rows += [(5, 2, "user", "tie"), (5, 2, "assistant", "tie"), (5, None, "user", "no turn"), (6, 1, None, None), (6, 1, None, None), (None, 0, "user", "no id"), (3000, 0, "user", "x" * 200_000)]
    return rows


def listed(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_trie_equals_brute_force(spark):
    rows = conversations()
    assert listed(prefixtrie.prefixes(extended(spark.createDataFrame(rows, TURNS)))) == collections.Counter(brute_trie(rows))


def test_trie_rounds_do_not_follow_depth(spark, monkeypatch):
    rows = [(c, t, "user", f"long {t}" if t < c else f"end {c}") for c in range(1, 130) for t in range(c + 1)]  # each prefix of a chain has a side leaf
    made = []
    real = prefixtrie.stash
    monkeypatch.setattr(prefixtrie, "stash", lambda df, name="table", by=None: made.append(name) or real(df, name, by))
    turns = prefixtrie.numbered(spark.createDataFrame(rows, TURNS)).withColumnRenamed("place", "depth")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    turns = turns.join(sizes, "conv_id").select("conv_id", "length", "depth", "digest", "chars")
    root = sizes.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    top = prefixtrie.trie(turns.unionByName(root)).where("depth = 0").first()
    assert (top["n_convs"], top["n_leaves"]) == (129, 129)
    assert made.count("pending") <= 4


def test_trie_of_no_rows(spark):
    assert prefixtrie.prefixes(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.prefixes(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


# ---- ball k-means


def brute_kmeans(rows, k, rounds, seed=2, dims=64):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x, *_ in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    centres = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        got = nearest()
        for j in range(len(centres)):
            own = [x for (_, x), (_, g) in zip(kept, got) if g == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own)]
    got = nearest()
    total = collections.Counter()
    for d, j in got:
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for (i, _), (d, j) in zip(kept, got)), key=repr)


def vectors(rng, n, dims=64):
    centres = rng.normal(size=(9, dims))
    return [(i, (centres[i % 9] + rng.normal(size=dims) * 0.3 * (i % 4)).astype(np.float32).tolist(), 0) for i in range(n)]


def of_kmeans(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_kmeans_equals_brute_force(spark, rounds):
    rows = vectors(np.random.default_rng(1), 300)
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (900, None, 1), (901, [1.0] * 63, 1), (902, [None] + [1.0] * 63, 1), (903, [float("nan")] + [1.0] * 63, 1), (904, [float("inf")] * 64, 1), (905, [], 1), (906, [0.0] * 64, 1)]
    df = extended(spark.createDataFrame(rows, VECTORS)).repartition(5)
    assert of_kmeans(ballkmeans.clustered(df, k=12, rounds=rounds)) == brute_kmeans(rows, 12, rounds)


def test_kmeans_of_few_equal_and_no_vectors(spark):
    rows = [(i, [0.25 * (i % 2)] * 64, 0) for i in range(6)]  # fewer places than clusters: ties and clusters without members
    assert of_kmeans(ballkmeans.clustered(spark.createDataFrame(rows, VECTORS), k=40)) == brute_kmeans(rows, 40, 5)
    assert ballkmeans.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0)], VECTORS)
    assert [r["distance"] for r in ballkmeans.clustered(huge).collect()] == [0, 0]


def test_balls_compare_few_and_lose_none():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, size=(40, 8))
    x = (centres[rng.integers(0, 40, 5000)] + rng.integers(-150, 150, size=(5000, 8))).astype(np.int64)
    every = ballkmeans.balls(centres, None)
    cluster, dist, _ = ballkmeans.assign(x, np.zeros(5000, np.int32), every)
    brute = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert np.array_equal(cluster, brute.argmin(axis=1)) and np.array_equal(dist, brute.min(axis=1))
    moved = centres + rng.integers(-60, 60, size=centres.shape)
    far = [int(dist[cluster == i].max(initial=-1)) for i in range(40)]
    radii = [ballkmeans.grown(r, int(m)) for r, m in zip(far, ballkmeans.squared(moved, centres))]
    few = ballkmeans.balls(moved, radii)
    got, d, made = ballkmeans.assign(x, cluster, few)
    brute = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
    assert np.array_equal(got, brute.argmin(axis=1)) and np.array_equal(d, brute.min(axis=1))
    assert sum(map(len, few.others)) < 40 * 39 / 4 and made < 5000 * 4  # of 40 each


# ---- near-duplicate vectors


def at_cosine(rng, x, cosine):
    z = rng.normal(size=len(x))
    z -= (z @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


def brute_links(rows, cosine=0.95):
    usable = [k for k, (_, x, *_) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    by = collections.defaultdict(list)
    for k in usable:
        by[len(rows[k][1])].append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], dtype=np.float32).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            n[ks[a]] += 1
            n[ks[b]] += 1
            root[find(ks[b])] = find(ks[a])
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, n[k], c := least.get(find(k)), i is not None and i == c) for k, (i, *_) in enumerate(rows)), key=repr)


def of_links(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), 0) for i in range(150)]
    centre = rng.normal(size=64)
    rows += [(200 + i, (at_cosine(rng, centre, 0.99) * (1 + i)).tolist(), 0) for i in range(330)]  # near copies of other lengths, over several blocks
    rows += [(1000 + i, rows[7][1], 0) for i in range(120)] + [(2000, at_cosine(rng, np.array(rows[7][1]), 0.985).tolist(), 0)]  # equal vectors and one beside them
    rows += [rows[3], rows[3], (None, rows[4][1], 0), (None, rng.normal(size=64).tolist(), 0)]
    rows += [(3000 + k, x, 0) for k, x in enumerate([None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [3e38] * 64, [1e-38] * 64, [1.0] * 3, [1.0, 1.01, 1.0], [1.0], [2.0], [-1.0]])]
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], k) for i, x, k in rows]
    assert of_links(neardup.near_duplicates(extended(spark.createDataFrame(rows, VECTORS)).repartition(4))) == brute_links(rows)


def copies_of(rng, groups, members):
    centres = rng.normal(size=(groups, 64))
    return [(i, (centres[i % groups] + rng.normal(size=64) * 0.05).astype(np.float32).tolist(), 0) for i in range(groups * members)]


def test_near_copies_go_once_to_where_they_are_compared(spark, monkeypatch):
    gone = []
    for name in ("_linked", "_compared"):
        own = getattr(neardup, name, None)
        monkeypatch.setattr(neardup, name, lambda members, *a, own=own: (gone.append(members.count()), own(members, *a))[1], raising=False)
    rows = copies_of(np.random.default_rng(8), 3, 40)
    assert of_links(neardup.near_duplicates(spark.createDataFrame(rows, VECTORS))) == brute_links(rows)
    assert sum(gone) <= len(rows)


@pytest.mark.parametrize("unit", [1, 45])
def test_near_copies_of_too_many_joined_vectors(spark, monkeypatch, unit):
    monkeypatch.setattr(neardup, "UNIT", unit)
    rows = copies_of(np.random.default_rng(9), 3, 40) + [(1000 + i, v, 0) for i, (_, v, _) in enumerate(copies_of(np.random.default_rng(9), 1, 60))]
    rows += [rows[5], (None, rows[7][1], 0), (2000, rows[7][1], 0)]
    assert of_links(neardup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4))) == brute_links(rows)


def test_pairs_within_a_cosine():
    x = neardup.unit(np.random.default_rng(3).normal(size=(700, 6)))
    a, b = (np.concatenate(v) for v in zip(*neardup.within(x, 0.9)))
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(700) for j in range(i + 1, 700) if np.einsum("i,i->", x[i], x[j]) >= 0.9}


def test_near_duplicates_of_no_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert of_links(neardup.near_duplicates(spark.createDataFrame([(1, None, 0), (2, [1.0, 0.0], 0)], VECTORS))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        x = rng.normal(size=64)
        rows += [(2 * i, x.tolist()), (2 * i + 1, at_cosine(rng, x, 0.9502).tolist())]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = got.where("n_links > 0 and vec_id % 2 = 1 and component_id = vec_id - 1").count()
    assert found >= 0.98 * 1500
    assert got.where("n_links > 1").count() == 0


@pytest.mark.parametrize("vectors", [100, 10**5, 10**8, 10**11])
def test_plans_reach_their_recall(vectors):
    plan = neardup.planned(vectors, 0.95)
    p, _ = neardup.meeting(0.95, plan.blocks)
    below = sum(math.comb(plan.tables, k) * p**k * (1 - p) ** (plan.tables - k) for k in range(plan.needed))
    assert below <= 1 - neardup.RECALL < below + math.comb(plan.tables, plan.needed) * p**plan.needed * (1 - p) ** (plan.tables - plan.needed)
    assert (2 * neardup.DIRECTIONS) ** plan.blocks >= neardup.SPREAD * vectors
