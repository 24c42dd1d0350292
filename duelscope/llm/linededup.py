"""Fuzzy line deduplication by MinHash.

Lines are compared as sets of character shingles, case and runs of white
space aside.  Each distinct line gets a signature; lines that agree in a whole
band of it are candidates.  BANDS bands of ROWS hashes find a pair of
similarity 0.8 with probability 1 - (1 - 0.8 ** 4) ** 10, over 99.4 %.  The
candidates' exact Jaccard similarity decides (see ``linkage``), union-find
joins what is similar, and of each component the first line stays: by doc_id,
null last, then a hash of the document's text, then place.

Lines without a character other than white space are neither compared nor
removed.  Equal lines are one entity however often they occur.

Defined cases: null text has no lines and stays null; a text loses lines only,
the others keep their spelling and order; rows that share a doc_id or have none
are told apart by their text and lose lines of their own; rows that are equal
in both lose the same lines; very long lines and texts are compared whole; an
empty table gives no rows; other columns pass through (n_chars, where there is
one, follows the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Recent, character_shingles, distinct, lean, minhashes, mix, parity, steps
from .linkage import linked, paired
from .shared import keyed, row_key, sent, stash, unused

WIDTH = 8
BANDS = 10
ROWS = 4
#: Characters that one vectorised step takes together.
STEP = 200_000


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def line_id(line: str) -> int:
    """An unsigned 64-bit id of a normalised line."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def signed(ids: list[int]) -> np.ndarray:
    return np.array(ids, dtype=np.uint64).view(np.int64)


def _read(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One pass over the texts.

    Every line that is not blank gives a row (token, ent, doc_id, line) with the
    document's key as token; every distinct line of a task, or now and then a
    repeated one, gives a row for each band, with line -1 and the band's hash as
    token.
    """
    names = ["token", "ent", "doc_id", "line"]

    def banded(lines: list[str], ids: list[int]) -> pa.RecordBatch:
        table = minhashes(*character_shingles(lines, width), bands * rows).astype(np.uint64)
        tokens = []
        for b in range(bands):
            token = np.full(len(lines), np.uint64(b + 1), dtype=np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                token = mix(token * np.uint64(0x9E3779B97F4A7C15) + table[:, k])
            tokens.append(token.view(np.int64))
        n = bands * len(lines)
        return pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.tile(signed(ids), bands)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1, np.int32))], names=names)

    def placed(token: list[int], ent: list[int], doc: list[int | None], place: list[int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(token, pa.int64()), pa.array(signed(ent)), pa.array(doc, pa.int64()), pa.array(place, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Recent()
        for batch in batches:
            seen: dict[str, int] = {}
            token, ent, doc, place = [], [], [], []
            for d, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                for k, line in enumerate((text or "").lower().split("\n")):
                    x = " ".join(line.split())
                    if x:
                        e = seen.get(x)
                        if e is None:
                            e = seen[x] = line_id(x)
                        token.append(key)
                        ent.append(e)
                        doc.append(d)
                        place.append(k)
                if len(ent) > 100_000:
                    yield placed(token, ent, doc, place)
                    token, ent, doc, place = [], [], [], []
            if ent:
                yield placed(token, ent, doc, place)
            lines = [x for x, e in seen.items() if sent.new(e)]
            ids = [seen[x] for x in lines]
            for lo, hi in steps([len(x) for x in lines], STEP):
                yield banded(lines[lo:hi], ids[lo:hi])

    return docs.mapInArrow(lean(run), "token long, ent long, doc_id long, line int")


def _gathered(rows: DataFrame) -> DataFrame:
    """The rows of lines as they are, and of the bands those that two distinct lines share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from paired(batches, "line")

    # lines are dealt by themselves: the rows of one text, or of one line, may be a third of all
    dealt = rows.repartition(F.when(F.col("line") < 0, F.col("token")).otherwise(F.xxhash64("ent", "doc_id", "line")))
    return dealt.sortWithinPartitions("token", "ent").mapInArrow(lean(run), "token long, ent long, doc_id long, line int")


def _wanted(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """For lines (doc_id, key, line): ent, their set's size and parity map, and their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, None] = {}
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                own = (text or "").split("\n")
                texts.update((normal(own[k]), None) for k in places if k < len(own))
            lines = [x for x in texts if x]
            for lo, hi in steps([len(x) for x in lines], STEP):
                part = lines[lo:hi]
                sets = _sets(part, width)
                yield pa.record_batch([pa.array(signed([line_id(x) for x in part])), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary()), pa.array([x.encode("utf-8", "surrogatepass") for x in part], pa.binary())], names=["ent", "n", "bits", "members"])

    per_doc = stash(found.groupBy("doc_id", "key").agg(F.collect_set("line").alias("places")), "places")
    return _at(docs, per_doc, "inner").select("text", "places").mapInArrow(lean(run), "ent long, n int, bits binary, members binary")


def _at(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join documents that have a key of their text with a table of (doc_id, key, more), whose ids are left out."""
    there = sent(other).withColumnsRenamed({"doc_id": "__d", "key": "__k"})
    return docs.join(there, (F.col("key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), how).drop("__d", "__k")


def _sets(lines: list[str], width: int) -> list[np.ndarray]:
    hashes, starts, runs = character_shingles(lines, width)
    return [distinct(hashes[a : a + n]) for a, n in zip(starts, runs)]


def removals(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, percent: int = 80) -> DataFrame:
    """(doc_id, key, removed): the places, from 0, of the lines that a document loses; only documents that lose any. key is of the text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs, "text").alias("key"), "text")
    read = stash(_gathered(_read(own, width, bands, rows)).withColumn("kind", (F.col("line") >= 0).cast("int")), "lines", by="kind")
    zero = F.lit(0)
    buckets = read.where("kind = 0").select("token", "ent", zero.alias("n"), zero.alias("pos"))
    every = read.where("kind = 1").select("doc_id", F.col("token").alias("key"), "line", "ent")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")
    firsts = every.groupBy("ent").agg(F.min(place).alias("at"), F.count("*").alias("copies"))
    shared = buckets.select("ent", F.lit(True).alias("shared")).distinct()
    # of all lines only those that repeat or share a band matter from here on
    known = stash(firsts.join(shared, "ent", "left").where("copies > 1 or shared").select("ent", "copies", "shared", "at"), "known")
    info = stash(_wanted(own, known.where("shared").select("at.doc_id", "at.key", "at.line"), width).dropDuplicates(["ent"]), "described")
    decode = lambda members: _sets([m.decode("utf-8", "surrogatepass") for m in members], width)
    roots = linked(buckets, info, None, decode, percent)
    of = keyed(known, roots, ["ent"], "left").where("copies > 1 or root is not null").select("ent", F.coalesce("root", "ent").alias("of"), "at")
    number = lambda c: F.xxhash64(F.col(f"{c}doc_id").isNull(), F.col(f"{c}doc_id"), F.col(f"{c}key"), F.col(f"{c}line"))
    first = of.groupBy("of").agg(F.min("at").alias("first")).select("of", number("first.").alias("first"))
    of = stash(of.select("ent", "of").join(first, "of").select("ent", "first"), "of")
    gone = keyed(every, of, ["ent"], "inner").where(number("") != F.col("first"))
    return stash(gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")


def deduplicated(docs: DataFrame, places: str = "removed_lines", **parameters) -> DataFrame:
    """The documents with their columns, text without its duplicate lines, and the places removed (null where none are).

    The last column is named ``places``, with underscores before it if the table has such a column.
    """
    key, places = unused(docs, "__key"), unused(docs, places)
    gone = removals(docs, **parameters)
    there = sent(gone).select(F.col("doc_id").alias(f"{key}d"), F.col("key").alias(f"{key}k"), F.col("removed").alias(places))
    told = docs.withColumn(key, row_key(docs, "text"))
    joined = told.join(there, (F.col(key) == F.col(f"{key}k")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{key}d")), "left").drop(key, f"{key}d", f"{key}k")
    changed, lines = F.col(places).isNotNull(), unused(docs, "__lines")
    # a column of its own, and read twice, so that a text is divided once and not for each line
    joined = joined.withColumn(lines, F.when(changed, F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    out = joined.withColumn("text", F.when(changed, left).otherwise(F.col("text"))).drop(lines)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without duplicate lines; those that lose their last line that is not blank go."""
    places, text = unused(docs, "__removed"), unused(docs, "__text")
    # lines that are not blank, of the text as it was: a filter on the new text would make it anew for the filter
    told = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S")))
    out = deduplicated(docs.withColumn(text, F.col("text")), places, **parameters)
    emptied = F.col(places).isNotNull() & (told <= F.size(places))
    return out.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])
