"""Distributed union-find: local forests, then smallest-root hooking with pointer jumping.

Each task first replaces its edges by a forest that joins the same ends, at
most one edge an end.  What is left after that, and after each round, is
finished by one task if it is at most FINISH_EDGES edges, a fixed bound of
memory.  While it is more, a round hooks every root that has a smaller
neighbour to the smallest one, shortens the resulting trees until all point at
roots, and contracts the edges.  Nothing is collected, and every table is
written so that lost executors only cost a reread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean
from .shared import empty, forget, measured, stash

#: Edges that one task finishes: 16 bytes each as they come, some ten times that at work.
FINISH_EDGES = 2_000_000
#: Edges that a task takes into its forest at once.
HELD = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, roots): every distinct end of the edges and the smallest end that it is joined with."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while len(x):
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    return ends, ends[root]


def _forests(edges: DataFrame) -> DataFrame:
    """(a, b): for the edges of each task a forest that joins the same ends; b is no larger, and equal at roots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, before = 0, 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(v) for v in zip(*held)))

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size >= HELD + 2 * before:  # the forest so far and as much again
                held = [joined()]
                size = before = len(held[0][0])
                if before > 4 * HELD:  # a partition of too many ends: what it has goes out as it is
                    yield pa.record_batch([pa.array(v) for v in held[0]], names=["a", "b"])
                    held, size, before = [], 0, 0
        if size:
            yield pa.record_batch([pa.array(v) for v in joined()], names=["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").mapInArrow(lean(run), "a long, b long")


def _finished(edges: DataFrame) -> DataFrame:
    """(ent, root) of edges that one task can hold; written files are read by it without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
        if a:
            yield pa.record_batch([pa.array(v) for v in forest(np.concatenate(a), np.concatenate(b))], names=["ent", "root"])

    return edges.coalesce(1).mapInArrow(lean(run), "ent long, root long")


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the edges of a smaller graph, where each end went): one hooking and all the jumps after it."""
    hooks = stash(left.groupBy("a").agg(F.min("b").alias("p")), "hooks")
    while True:
        up = hooks.select(F.col("a").alias("p"), F.col("p").alias("p2"))
        once = hooks.join(up, "p", "left").select("a", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved"))
        twice = once.join(up, "p", "left").select("a", F.coalesce("p2", "p").alias("p"), "moved")
        jumped = stash(twice, "jumped")
        forget(hooks)
        hooks = jumped
        if jumped.where("moved").isEmpty():
            break
    a, b = hooks.select("a", F.col("p").alias("pa")), hooks.select(F.col("a").alias("b"), F.col("p").alias("pb"))
    moved = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
    return moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), hooks


def components(edges: DataFrame, finish: int = FINISH_EDGES) -> DataFrame:
    """(ent, root) for every end of an edge (a, b): root is the smallest id reachable.

    Edges may repeat, run both ways or start and end at the same id; rows with
    a null end are no edges.  No edges give no rows.
    """
    left = stash(_forests(edges), "forests")
    if measured(left)[0] <= finish:
        labels = stash(_finished(left), "labels")
        forget(left)
        return labels
    labels = stash(left.select(F.explode(F.array("a", "b")).alias("ent")).distinct().withColumn("root", F.col("ent")), "labels")
    first, left = left, stash(left.where("a <> b").distinct(), "edges")
    forget(first)
    while not empty(left):
        if measured(left)[0] <= finish:
            to = stash(_finished(left), "finished").select(F.col("ent").alias("root"), F.col("root").alias("to"))
            return stash(labels.join(to, "root", "left").select("ent", F.coalesce("to", "root").alias("root")), "labels")
        contracted, hooks = _round(left)
        smaller = stash(contracted, "edges")
        to = hooks.select(F.col("a").alias("root"), F.col("p").alias("to"))
        relabelled = stash(labels.join(to, "root", "left").select("ent", F.coalesce("to", "root").alias("root")), "labels")
        forget(left, labels, hooks)
        left, labels = smaller, relabelled
    return labels
