"""The pipeline against a brute-force version of every stage, on the smallest tables."""

import collections
import math
import os

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from duelscope.llm import linededup, mixing, quality

from .test_llm import WORD, brute_groups, shingles  # noqa: F401


def approximate(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def statistics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    m = max(n, 1)
    vector = [math.log(m), math.log(max(sum(map(len, w)), 1) / m), math.sqrt(len(re.findall(r"[#*$%&|<>]", text or "")) / m), math.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)), len(covered) / m]
    return failed, vector


def robust(groups):
    """Centre and scatter with floors of every group after the concentration steps, which all take together."""
    floors = np.diag(np.square(quality.FLOORS))
    models = {}
    for g, x in groups.items():
        sd = np.array([(approximate(c, 0.75) - approximate(c, 0.25)) / 1.349 for c in x.T])
        models[g] = np.array([approximate(c, 0.5) for c in x.T]), np.diag(sd**2) + floors
    for step in range(quality.STEPS):
        moved = False
        for g, x in groups.items():
            centre, scatter = models[g]
            d2 = distances(x, centre, scatter)
            near = x[d2 <= approximate(d2.tolist(), quality.KEEP)]
            models[g] = near.mean(axis=0), quality.CONSISTENCY * np.cov(near.T, bias=True).reshape(5, 5) + floors
            moved |= abs(np.linalg.slogdet(models[g][1])[1] - np.linalg.slogdet(scatter)[1]) / 2 > quality.SETTLED
        if step and not moved:
            break
    return models


def distances(x, centre, scatter):
    d = x - centre
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d)


def brute_quality(docs):
    stats = {d[0]: statistics(d[1]) for d in docs}
    members = collections.defaultdict(list)
    for d in docs:
        if not stats[d[0]][0]:
            members[d[2], d[3]].append(stats[d[0]][1])
    models = robust({g: np.array(v) for g, v in members.items()})
    return [d for d in docs if not stats[d[0]][0] and distances(np.array([stats[d[0]][1]]), *models[d[2], d[3]])[0] <= quality.LIMIT]


def brute_lines(docs):
    places = [(d[0], k, linededup.normal(line)) for d in docs for k, line in enumerate((d[1] or "").split("\n"))]
    places = [p for p in places if p[2]]
    lines = list(dict.fromkeys(p[2] for p in places))
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g] if j > k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    at = {x: k for k, x in enumerate(lines)}
    first: dict = {}
    for i, k, x in places:
        r = find(at[x])
        first[r] = min(first.get(r, (i, k)), (i, k))
    gone = collections.defaultdict(set)
    for i, k, x in places:
        if first[find(at[x])] != (i, k):
            gone[i].add(k)
    out = []
    for d in docs:
        if d[0] in gone:
            text = "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d[0]])
            if text.strip():
                out.append((d[0], text, d[2], d[3], len(text)))
        else:
            out.append(d)
    return out


def brute_clean(docs, items):
    low = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for _, t in items:
        w = low(t)
        n = min(10, len(w))
        if n:
            windows[n].update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))

    def hit(text):
        w = low(text)
        return any(tuple(w[s : s + n]) in held for n, held in windows.items() for s in range(len(w) - n + 1))

    return [d for d in docs if not hit(d[1])]


def test_every_stage_against_brute_force(spark, folder):
    read = lambda t: duckdb.sql(f"select * from '{folder}/{t}.parquet' order by 1").fetchall()
    docs = read("documents")
    items = read("benchmark")
    want = [brute_quality(docs)]
    want.append(brute_lines(want[-1]))
    groups = brute_groups(want[-1])
    want.append([d for d in want[-1] if groups[d[0]][1] == d[0]])
    want.append(brute_clean(want[-1], items))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        now = corpus_pipeline.stash(stage(spark, now, folder), name)
        assert now.columns == columns, name
        assert sorted(map(tuple, now.collect())) == sorted(expected), name
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(columns, map(list, zip(*want[-1]))))))
    mix = {r[0]: r for r in con.sql(mixing.SQL).fetchall()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(mix)
    assert all((r["size"], r["source_size"], r["taken"]) == (mix[r["doc_id"]][1], mix[r["doc_id"]][2], mix[r["doc_id"]][4]) for r in got)


def test_stages_on_empty_tables(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stash(stage(spark, now, folder), name)
        assert now.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] and os.path.isdir(folder)
