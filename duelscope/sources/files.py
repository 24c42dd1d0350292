"""File sources: raw contest files with row numbers, manifests, workbooks and tolerant CSV.

Bytes are read by Spark's ``binaryFile`` source, so files can lie in any store;
verification, discovery and parsing run on the executors.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.probability import decimal_price
from ..schemas import RAW_COLUMNS
from . import xls

NAME = r"(atp|wta)_matches_(\d{4})\.csv$"
#: First bytes of the two workbook formats (fixed values).
OLE2, ZIP = "D0CF11E0A1B11AE1", "504B0304"
TRUE_WORDS = ("1", "true", "t", "yes")


class SourceError(ValueError):
    """A file or manifest that is not what it should be."""


def safe_path(root: str, relative: str) -> Path:
    """A path below the root; absolute paths, parent steps and links that leave it are refused."""
    pure = PurePosixPath(relative)
    if pure.is_absolute() or ".." in pure.parts or not pure.parts:
        raise SourceError(f"unsafe path: {relative}")
    base = Path(root).resolve()
    full = (base / relative).resolve()
    if not full.is_relative_to(base):
        raise SourceError(f"path leaves its folder: {relative}")
    return full


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """(path, tour, year) of the raw files of a folder, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder).select("path")
    named = files.where(F.col("path").rlike(NAME))
    return named.select("path", F.upper(F.regexp_extract("path", NAME, 1)).alias("tour"), F.regexp_extract("path", NAME, 2).cast("int").alias("year")).orderBy("path")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open after this line, if one was (or none) before it: quotes open where a value begins and close before a comma."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, at = False, line.find(",", at + 1) + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(",", at) + 1
        if not at:
            return False


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[str], bool]]:
    """(values of the columns, lines, whether the block begins) for runs of lines of one block of a file."""
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        lines = batch.column("value").to_pylist()
        lo = 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi][:2] != keys[lo][:2]:
                yield keys[lo], lines[lo:hi], keys[lo][:2] != last
                last, lo = keys[lo][:2], hi


def _blank(line: str) -> bool:
    return not line.rstrip("\r")


def csv_records(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, record, text) of the CSV files of a folder; the header is record 0, blank lines are none.

    Files are read in blocks by several tasks, and twice.  Whether a block
    begins inside a quoted value depends on all blocks before it, so the first
    pass says of each what it would end with and how many records it would
    begin for either case; a running composition of those says where each
    really stands.  Records that blocks cut are put together by their number.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, [False, True], [0, 0]
        row = lambda: pa.record_batch([[key[0]], [key[1]], [state[0]], [state[1]], [begun[0]], [begun[1]]], names=["path", "block", "end_0", "end_1", "n_0", "n_1"])
        for now, texts, new in _blocks(batches, ["path", "block"]):
            if new and key is not None:
                yield row()
            if new:
                key, state, begun = now, [False, True], [0, 0]
            for text in texts:
                for k in (0, 1):
                    if not state[k] and not _blank(text):
                        begun[k] += 1
                    if state[k] or '"' in text:
                        state[k] = ends_inside(text, state[k])
        if key is not None:
            yield row()

    blocks = lines.mapInArrow(told, "path string, block long, end_0 boolean, end_1 boolean, n_0 long, n_1 long")
    here = F.struct("block", "end_0", "end_1", "n_0", "n_1")
    first = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("records"), F.array().cast("array<struct<block:bigint,inside:boolean,records:bigint>>").alias("all"))

    def composed(acc: Column, b: Column) -> Column:
        at = F.struct(b["block"].alias("block"), acc["inside"].alias("inside"), acc["records"].alias("records"))
        return F.struct(F.when(acc["inside"], b["end_1"]).otherwise(b["end_0"]).alias("inside"), (acc["records"] + F.when(acc["inside"], b["n_1"]).otherwise(b["n_0"])).alias("records"), F.concat(acc["all"], F.array(at)).alias("all"))

    # one row of a few numbers for each block of a file
    starts = blocks.groupBy("path").agg(F.aggregate(F.sort_array(F.collect_list(here)), first, composed, lambda acc: acc["all"]).alias("all")).select("path", F.explode("all").alias("at")).select("path", "at.*")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, inside, number, held, whole = None, False, 0, [], True

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(v)) for v in zip(*out)], names=["path", "record", "block", "text", "whole"])

        for (path, block, starts_inside, before), texts, new in _blocks(batches, ["path", "block", "inside", "records"]):
            if new:
                if held:
                    out.append((key[0], number, key[1], "\n".join(held), whole and not inside))
                key, inside, number, held, whole = (path, block), starts_inside, before - 1, [], not starts_inside
            for text in texts:
                if not inside:
                    if held:
                        out.append((path, number, block, "\n".join(held), whole))
                        held = []
                    if _blank(text):
                        continue
                    number, whole = number + 1, True
                held.append(text)
                if inside or '"' in text:
                    inside = ends_inside(text, inside)
            if len(out) >= 10_000:
                yield batch_of()
                out.clear()
        if held:
            out.append((key[0], number, key[1], "\n".join(held), whole and not inside))
        if out:
            yield batch_of()

    placed = lines.join(F.broadcast(starts), ["path", "block"])
    found = placed.select("value", "path", "block", "inside", "records").mapInArrow(records, "path string, record long, block long, text string, whole boolean")
    cut = found.where("not whole").groupBy("path", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return found.where("whole").select("path", "record", "text").unionByName(cut)


def raw_rows(spark: SparkSession, folder: str, pins: DataFrame | None = None) -> DataFrame:
    """Rows of all raw contest files as text, with 1-based row numbers.

    Quoted line ends and a byte-order mark are read as CSV says; values beyond
    the header are kept in ``overflow``.  pins: (source_file, repository,
    commit) of files whose rows are to be referred to there.
    """
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in RAW_COLUMNS], T.StructField("overflow", T.StringType()), T.StructField("source_row_number", T.LongType()), T.StructField("path", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        headers: dict[str, list[str]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for path, number, header, values in zip(batch["path"], batch["record"], batch["header"], csv.reader(batch["text"])):
                if header not in headers:
                    headers[header] = next(csv.reader([header.removeprefix("\ufeff")]))
                names = headers[header]
                row = dict(zip(names, values))
                rows.append((*[row.get(c) for c in RAW_COLUMNS], ",".join(values[len(names) :]) or None if len(values) > len(names) else None, number, path))
            yield pd.DataFrame(rows, columns=schema.names)

    records = csv_records(spark, folder, "*_matches_*.csv")
    headers = records.where("record = 0").select("path", F.col("text").alias("header"))
    found = records.where("record > 0").join(F.broadcast(headers), "path").mapInPandas(run, schema)  # a header for each file
    relative = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    none = F.lit(None).cast("string")
    rows = found.select(*RAW_COLUMNS, "overflow", "source_row_number", relative.alias("source_file"), F.upper(F.regexp_extract("path", NAME, 1)).alias("tour"), F.regexp_extract("path", NAME, 2).cast("int").alias("year"))
    rows = rows.join(F.broadcast(pins), "source_file", "left") if pins is not None else rows.withColumns({"repository": none, "commit": none})
    return rows.withColumn("source_ref", source_ref(F.col("repository"), F.col("commit"), F.col("source_file"), F.col("source_row_number"))).select(*RAW_COLUMNS, "overflow", "source_row_number", "source_file", "tour", "year", "source_ref")


def source_ref(repository: Column, commit: Column, path: Column, row: Column) -> Column:
    """Where a row comes from: a pinned line of a repository, or a local file."""
    line = F.concat(F.lit("#L"), (row + 1).cast("string"))
    return F.coalesce(F.concat(F.lit("https://github.com/"), repository, F.lit("/blob/"), commit, F.lit("/"), path, line), F.concat(F.lit("local:"), path, line))


#: Bytes of a file that are held while it is read through.
PIECE = 1 << 20


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files of a folder.

    Files that lie in folders of the executors' own systems are read through
    in pieces; those of other stores come whole by Spark's reader.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as source:
                    while piece := source.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                yield pa.record_batch([[path], pa.array([size], pa.int64()), [digest.hexdigest()]], names=["path", "bytes", "sha256"])

    return files.select("path").mapInArrow(run, "path string, bytes bigint, sha256 string")


def manifest_gaps(manifest: DataFrame, expected: DataFrame, keys: tuple[str, ...], compared: tuple[str, ...]) -> DataFrame:
    """What a manifest has too much, too little, twice or different, as (keys, problem)."""
    keyed = list(keys)
    twice = manifest.groupBy(*keyed).count().where("count > 1").select(*keyed, F.lit("duplicate").alias("problem"))
    a = manifest.select(*keyed, F.struct(*compared).alias("a"))
    b = expected.select(*keyed, F.struct(*compared).alias("b"))
    both = a.join(b, keyed, "full")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return both.select(*keyed, problem.alias("problem")).where("problem is not null").unionByName(twice)


def verify(manifest: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("path",), compared: tuple[str, ...] = ("bytes", "sha256")) -> None:
    """Raise unless every listed file is there, byte for byte, and no other."""
    first = manifest_gaps(manifest, found, keys, compared).first()
    if first:
        raise SourceError(f"the manifest does not describe the files: {first.asDict()}")


def workbook_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, ok): whether the first bytes of each workbook fit its name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").option("recursiveFileLookup", "true").load(folder)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith(OLE2), "xls").when(head.startswith(ZIP), "xlsx")
    return files.select("path", kind.alias("kind"), F.coalesce(F.lower("path").endswith(F.concat(F.lit("."), kind)), F.lit(False)).alias("ok"))


def workbook_rows(rows: list[list], first_row: int = 2) -> list[dict]:
    """Rows of a sheet as dictionaries: blank headers get names, repeated ones are refused, blank rows are left out."""
    first = [*rows[0], *[None] * (max(map(len, rows)) - len(rows[0]))]
    header = [str(h).strip() if h is not None and str(h).strip() else f"_blank_{i}" for i, h in enumerate(first)]
    if len(set(header)) < len(header):
        raise SourceError("a header is given twice")
    out = []
    for n, row in enumerate(rows[1:], first_row):
        padded = list(row) + [None] * (len(header) - len(row))
        if any(v is not None and str(v).strip() for v in padded):
            out.append({**dict(zip(header, padded)), "_row": n})
    return out


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes) -> list[list]:
    """The rows of the first sheet of a workbook of either format, row 1 first; texts, numbers and truth values as they are."""
    if content[:8] == xls.MAGIC:
        try:
            return xls.sheet_rows(content)
        except (xls.WorkbookError, struct.error, IndexError) as e:
            raise SourceError(f"a damaged workbook: {e}") from e
    if content[:4].hex().upper() != ZIP:
        raise SourceError("not a workbook")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        texts: list[str] = []
        if "xl/sharedStrings.xml" in names:
            texts = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")).get(_LINK)
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[first]
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: list[list] = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells: list = []
        for c in row.iter(f"{_SHEET}c"):
            at = 0
            for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(letter) - 64
            at = at - 1 if at else len(cells)
            value, kind = c.find(f"{_SHEET}v"), c.get("t", "n")
            if kind == "inlineStr":
                found: object = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            elif value is None or value.text is None:
                found = None
            elif kind == "s":
                found = texts[int(value.text)]
            elif kind == "b":
                found = value.text == "1"
            elif kind == "n":
                number = float(value.text)
                found = int(number) if number.is_integer() else number
            else:
                found = value.text
            cells += [None] * (at + 1 - len(cells))
            cells[at] = found
        number = int(row.get("r", len(rows) + 1))
        rows += [[] for _ in range(number - 1 - len(rows))]
        rows.append(cells)
    return rows


def workbooks(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Rows of the first sheets of all workbooks of a folder: these columns as text, source_file and source_row_number."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("source_file", T.StringType()), T.StructField("source_row_number", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                text = lambda v: None if v is None or not str(v).strip() else str(v)
                rows = sheet_rows(bytes(content))
                if rows:
                    yield pd.DataFrame([(*[text(r.get(c)) for c in columns], path.rpartition("/")[2], r["_row"]) for r in workbook_rows(rows)], columns=schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInPandas(run, schema)


def price_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Priced rows from CSV with a declared schema; for those of workbooks see ``workbooks``."""
    return spark.read.schema(schema).option("header", True).csv(path)


def truth(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUE_WORDS)


def declared_csv(spark: SparkSession, path: str, schema: str, booleans: tuple[str, ...] = ()) -> DataFrame:
    """A CSV of declared types; words of truth become booleans."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumns({b: truth(F.col(b)) for b in booleans}) if booleans else rows


def aliases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tour string, start_year int, end_year int, odds_name string, canonical_player_id bigint, canonical_name string, reason string, reviewed_on date").option("header", True).csv(path)


SLAM_TOURNAMENTS = {"Australian Open": "Australian Open", "French Open": "Roland Garros", "Wimbledon": "Wimbledon", "US Open": "US Open"}
ROUND_NAMES = {"1st Round": "R128", "2nd Round": "R64", "3rd Round": "R32", "4th Round": "R16", "Quarterfinals": "QF", "Semifinals": "SF", "The Final": "F"}


def slam_prices(rows: DataFrame) -> DataFrame:
    """Priced rows of the Slams under canonical names; unknown rounds become null."""
    named = lambda c, names: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.trim(c))
    return rows.withColumns({"slam": named(F.col("Tournament"), SLAM_TOURNAMENTS), "round": named(F.col("Round"), ROUND_NAMES)}).where("slam is not null")


def field_audit(rows: DataFrame, fields: list[str], by: str = "source_file") -> DataFrame:
    """Per file how many rows have a usable price in each field."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.count(decimal_price(F.col(f"`{f}`"))).alias(f) for f in fields])
