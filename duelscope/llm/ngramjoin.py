"""Similarity join of documents on word n-grams, and the groups it makes.

Rare-first prefix filtering: every set of shingles is ordered from rare to
frequent, and two sets that reach the similarity share one of the first
``n - ceil(0.8 n) + 1`` elements.  Buckets of those elements are joined with
length and positional filters, pairs are thinned by parity maps and a suffix
filter, and each remaining pair is compared once (see ``linkage``).

The order is by the count of a shingle's hash class over all documents.  The
classes are a fixed number, so their table has a proven bound and is sent to
all executors; equal counts go by the hash, which keeps the order total.

Defined cases: null text and text without words have an empty set, are linked
with nothing and form their own group; fewer than ``width`` words are one
shingle; equal sets are one entity however often they occur; a repeated doc_id
gives a row for each of its rows, each with the group of its own text; a row
with a null doc_id has the group of its text, null if no row of the group has
an id; very long texts are one set as any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Recent, identity, lean, parity, shingle_sets
from .linkage import linked, shared_only
from .shared import empty, keyed, row_key, rows_but, sent, stash, unused

#: Hash classes whose counts order the shingles: 2 ** CLASS_BITS of 4 bytes.
CLASS_BITS = 19
SLICES = 64
PER_SLICE = (1 << CLASS_BITS) // SLICES


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _described(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: a row per document, and counts of hash classes in slices (kind 1)."""
    schema = "kind int, doc_id long, key long, n int, ent long, bits binary"
    names = ["kind", "doc_id", "key", "n", "ent", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, dtype=np.int64)
        for batch in batches:
            sets = shingle_sets(_texts(batch), width)
            if not sets:
                continue
            for lo in range(0, len(sets), 512):
                counts += np.bincount(np.concatenate([s >> np.uint64(64 - CLASS_BITS) for s in sets[lo : lo + 512]]).astype(np.int64), minlength=len(counts))
            yield pa.record_batch([pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), batch.column("key"), pa.array(np.array([len(s) for s in sets], np.int32)), pa.array([identity(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())], names=names)
        used = [k for k in range(SLICES) if counts[k * PER_SLICE : (k + 1) * PER_SLICE].any()]
        packed = [zlib.compress(counts[k * PER_SLICE : (k + 1) * PER_SLICE].astype(np.uint32).tobytes(), 1) for k in used]
        none = np.zeros(len(used), np.int64)
        yield pa.record_batch([pa.array(np.ones(len(used), np.int32)), pa.array(used, pa.int64()), pa.array(none), pa.array(none.astype(np.int32)), pa.array(none), pa.array(packed, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs, "text").alias("key"), "text").mapInArrow(lean(run), schema)


def _class_counts(described: DataFrame) -> np.ndarray:
    """The counts of all hash classes: SLICES rows of a fixed size reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("doc_id").to_pylist(), batch.column("bits").to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(1 << CLASS_BITS, dtype=np.uint32)
    slices = described.where("kind = 1").select("doc_id", "bits").repartition(SLICES, "doc_id").mapInArrow(lean(run), "slice long, counts binary")
    for row in slices.collect():
        out[row["slice"] * PER_SLICE : (row["slice"] + 1) * PER_SLICE] = np.frombuffer(row["counts"], np.uint32)
    return out


#: Texts that have a shingle of a class, and times the mean of all classes, from which its buckets count as common.
COMMON, TIMES = 50_000, 8


def common_classes(counts: np.ndarray) -> int:
    """The count above which a class holds a token that many texts have."""
    return max(COMMON, TIMES * int(counts.mean(dtype=np.float64)))


def _rare_first(counts: Broadcast):
    def order(s: np.ndarray) -> np.ndarray:
        return np.lexsort((s, counts.value[(s >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]))

    return order


def _prefixes(docs: DataFrame, order, counts: Broadcast, most: int, width: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Recent()
        for batch in batches:
            token, ent, n, pos, common = [], [], [], [], []
            for s in shingle_sets(_texts(batch), width):
                if not len(s) or not sent.new(e := identity(s)):
                    continue
                k = len(s) - -(-percent * len(s) // 100) + 1
                first = s[order(s)[:k]]
                token.append(first.view(np.int64))
                common.append(counts.value[(first >> np.uint64(64 - CLASS_BITS)).astype(np.int64)] > most)
                ent.append(np.full(k, e, np.int64))
                n.append(np.full(k, len(s), np.int32))
                pos.append(np.arange(k, dtype=np.int32))
            if token:
                yield pa.record_batch([pa.array(np.concatenate(v)) for v in (token, ent, n, pos, common)], names=["token", "ent", "n", "pos", "common"])

    return docs.select("text").mapInArrow(lean(run), "token long, ent long, n int, pos int, common boolean")


def _fetcher(docs: DataFrame, width: int):
    """The sets of entities (ent, key), read again from the rows with these keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for lo in range(0, len(texts), 512):
                sets = shingle_sets(texts[lo : lo + 512], width)
                yield pa.record_batch([pa.array([identity(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["ent", "members"])

    own = docs.select("doc_id", row_key(docs, "text").alias("key"), "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def fetch(ends: DataFrame) -> DataFrame:
        wanted = sent(ends).select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
        return own.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("text").mapInArrow(lean(run), "ent long, members binary")

    return fetch


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row per document: doc_id, key (of its text), n, and root, which is equal for a group and null for empty sets."""
    described = stash(_described(docs, width), "described", by="kind")
    rows = described.where("kind = 0").select("doc_id", "key", "n", "ent", "bits")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    info = stash(rows.where("n > 0").groupBy("ent").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("ent", "at.doc_id", "at.key", "n", "bits"), "entities")
    of_classes = _class_counts(described)
    counts = docs.sparkSession.sparkContext.broadcast(of_classes)
    order = _rare_first(counts)
    buckets = stash(shared_only(_prefixes(docs, order, counts, common_classes(of_classes), width, percent)), "buckets")
    roots = linked(buckets, info, _fetcher(docs, width), percent=percent, order=order)
    counts.destroy()
    own = rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("ent")).alias("ent"))
    return keyed(own, roots, ["ent"], "left").select("doc_id", "key", "n", F.coalesce("root", "ent").alias("root"))


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document, the smallest doc_id that links reach."""
    rows = stash(_grouped(docs, width, percent), "grouped")
    smallest = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).where("many > 1")
    out = keyed(rows, stash(smallest.select("root", "first"), "firsts"), ["root"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose group has an earlier one: by doc_id, null last, and then by a hash of the text.

    Documents without words are kept.  Of rows that are equal in both only one is.
    """
    rows = stash(_grouped(docs, width, percent).where("root is not null"), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = stash(rows.groupBy("root").agg(F.min(place).alias("at"), F.count("*").alias("many")).where("many > 1").select("root", F.col("at.doc_id").alias("d"), F.col("at.key").alias("k")), "firsts")
    members = rows.join(sent(firsts), "root")
    first = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    members = stash(members.groupBy("doc_id", "key").agg(F.max(first).alias("first"), F.count("*").alias("copies")), "members")
    kept = rows_but(docs, stash(members.where("not first").select("doc_id", "key"), "gone"), "text")
    again = stash(members.where("first and copies > 1").select("doc_id", "key"), "again")
    if empty(again):
        return kept
    key = unused(docs, "__key")
    told = kept.withColumn(key, row_key(kept, "text"))
    other = sent(again).select(F.col("doc_id").alias(f"{key}d"), F.col("key").alias(f"{key}k"))
    same = (F.col(key) == F.col(f"{key}k")) & F.col("doc_id").eqNullSafe(F.col(f"{key}d"))
    once = told.join(other, same, "left_semi").dropDuplicates(["doc_id", key])
    return told.join(other, same, "left_anti").unionByName(once).drop(key)


#: The same groups in DuckDB's SQL: all pairs that share a shingle, then everything that links reach.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
l as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select a, b from l union all select b, a from l),
reach(id, r) as (select doc_id, doc_id from documents union select reach.id, edges.b from reach join edges on edges.a = reach.r),
first as (select id, min(r) as component_id from reach group by id)
select s.doc_id, len(s.s)::bigint as n_shingles, first.component_id from s join first on first.id = s.doc_id
"""
