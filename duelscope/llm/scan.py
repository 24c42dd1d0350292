"""Running counts and totals in groups of any size, without bringing a group into one task.

Rows are dealt out in ranges of (group, order), so a group of a third of all
rows lies in many neighbouring tasks.  Every task runs through its range once
and keeps what it has summed of its first and its last group: two rows a task.
Groups that go on in the next range begin there with what was summed before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import lean
from .shared import stash


def ranged(df: DataFrame, *columns: str) -> DataFrame:
    """The rows sorted and dealt out in as many ranges as shuffles have partitions; nulls come first."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)


def _wrapped(x: int) -> int:
    """A sum as 64 bits hold it."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _offsets(ends: list, sums: list[str]) -> dict[int, list[int]]:
    """What the first group of each range had before it, where it began in an earlier range."""
    before: dict[int, list[int]] = {}
    key, total = None, [0] * (1 + len(sums))
    for row in sorted(ends, key=lambda r: (r["__part"], not r["__lead"])):
        own = [row["__n"], *[row[f"sum_{c}"] for c in sums]]
        if row["__lead"]:
            if key is not None and row["__key"] == key[0]:
                before[row["__part"]] = total
                own = [_wrapped(a + b) for a, b in zip(total, own)]
            key, total = (row["__key"],), own
        else:
            key, total = (row["__key"],), own
    return before


def running(df: DataFrame, by: str, order: list[str], sums: list[str], name: str) -> DataFrame:
    """The rows with ``place``, from 1 on in the group of their ``by``, and ``sum_x`` of all rows up to it for each x of ``sums``.

    by and sums are longs without nulls; sums wrap at 64 bits.  Equal rows are
    numbered in some order.  The result is a stashed table.
    """
    spark = df.sparkSession
    rows = ranged(df, by, *order).withColumn("__part", F.spark_partition_id())
    extra = [T.StructField("place", T.LongType()), *[T.StructField(f"sum_{c}", T.LongType()) for c in sums], T.StructField("__lead", T.BooleanType()), T.StructField("__kind", T.IntegerType()), T.StructField("__key", T.LongType()), T.StructField("__n", T.LongType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *extra])
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, had, lead, part = None, [0] * (1 + len(sums)), True, 0

        def end() -> pa.RecordBatch:
            """What the group that has just ended comes to in this range."""
            values = {"__part": part, **{f"sum_{c}": v for c, v in zip(sums, had[1:])}, "__lead": lead, "__kind": 1, "__key": key, "__n": had[0]}
            return pa.record_batch([pa.array([values.get(f.name)], type=t.type) for f, t in zip(schema.fields, arrow)], schema=arrow)

        arrow = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if arrow is None:
                kinds = {"place": pa.int64(), "__lead": pa.bool_(), "__kind": pa.int32(), "__key": pa.int64(), "__n": pa.int64()}
                arrow = pa.schema([*[pa.field(c, batch.schema.field(c).type) for c in columns], *[pa.field(f.name, kinds.get(f.name, pa.int64())) for f in extra]])
                part = batch.column("__part")[0].as_py()
            keys = batch.column(by).to_numpy()
            m = len(keys)
            starts = np.flatnonzero(np.r_[key is None or int(keys[0]) != key, keys[1:] != keys[:-1]])
            at = np.arange(m, dtype=np.int64)
            begins = np.zeros(m, dtype=np.int64)  # the place of the first row of each row's group; 0 before the first start
            begins[starts] = starts
            np.maximum.accumulate(begins, out=begins)
            goes_on = at < (starts[0] if len(starts) else m)  # rows of the group that was open
            leads = goes_on & lead if key is not None else at < (starts[1] if len(starts) > 1 else m)
            out = [at - begins + 1 + np.where(goes_on, had[0], 0)]
            for k, c in enumerate(sums, 1):
                total = np.r_[np.int64(0), np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))]
                out.append(total[1:] - total[begins] + np.where(goes_on, np.int64(had[k]), np.int64(0)))
            if key is not None and lead and len(starts):
                if starts[0] > 0:
                    had = [int(v[starts[0] - 1]) for v in out]
                yield end()
                lead = False
            if key is None and len(starts) > 1:
                key, had = int(keys[0]), [int(v[starts[1] - 1]) for v in out]
                yield end()
                lead = False
            key, had = int(keys[-1]), [int(v[-1]) for v in out]
            none = pa.nulls(m, pa.int64())
            yield pa.record_batch([*[batch.column(c) for c in columns], *[pa.array(v) for v in out], pa.array(leads), pa.array(np.zeros(m, np.int32)), none, none], schema=arrow)
        if key is not None:
            yield end()

    found = stash(rows.mapInArrow(lean(run), schema), name, by="__kind")
    fields = ["__part", "__key", "__n", "__lead", *[f"sum_{c}" for c in sums]]
    before = _offsets(found.where("__kind = 1").select(*fields).collect(), sums)  # two rows a range
    have = found.where("__kind = 0").drop("__kind", "__key", "__n")
    if not before:
        return have.drop("__part", "__lead")
    moved = ["place", *[f"sum_{c}" for c in sums]]

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, leads = batch.column("__part").to_numpy(), batch.column("__lead").to_numpy(zero_copy_only=False)
            add = np.zeros((len(moved), batch.num_rows), dtype=np.int64)
            for p in np.unique(parts[leads]):
                if int(p) in before:
                    add[:, leads & (parts == p)] = np.array(before[int(p)], dtype=np.int64)[:, None]
            cols = {c: batch.column(c) for c in batch.schema.names if c not in ("__part", "__lead")}
            for k, c in enumerate(moved):
                cols[c] = pa.array(cols[c].to_numpy() + add[k])
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return have.mapInArrow(lean(shifted), T.StructType([f for f in have.schema.fields if f.name not in ("__part", "__lead")]))
