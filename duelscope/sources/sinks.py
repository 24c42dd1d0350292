"""Sinks: Parquet in total order, small CSV with stable bytes, content digests."""

from __future__ import annotations

import bisect
import csv
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.contracts import ContractError


def parquet(df: DataFrame, path: str, partitions: tuple[str, ...] = (), order: list[Column | str] | None = None) -> None:
    """Overwrite a Parquet table; Spark commits it as a whole."""
    rows = df.orderBy(*order) if order else df
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def _moved(spark: SparkSession, staged: str, path: str | None) -> None:
    """Put a staged table in the place of another, or delete it."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    store = of(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    if path is None:
        store.delete(of(staged), True)
        return
    store.delete(of(path), True)
    store.mkdirs(of(path).getParent())
    if not store.rename(of(staged), of(path)):
        raise OSError(f"{staged} cannot be moved to {path}")


def committed(df: DataFrame, path: str, gates: dict[str, Column], partitions: tuple[str, ...] = (), order: list[Column | str] | None = None, drop: tuple[str, ...] = ()) -> dict[str, int]:
    """Write a table beside its place, count the rows that break a contract while it is written, and move it only if none does.

    gates: what makes a row break each contract; null counts as broken.  A
    broken contract raises and leaves what stood at the path.  drop: columns
    that only gates read.  Returns rows and the counters.
    """
    spark, staged, seen = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", Observation("gates")
    rows = df.withColumns({f"__{n}": F.coalesce(c, F.lit(True)) for n, c in gates.items()})  # a gate may look at other rows, a counter may not
    rows = rows.orderBy(*order) if order else rows
    counters = [F.count_if(f"__{n}").alias(n) for n in gates]
    try:
        parquet(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counters).drop(*drop, *[f"__{n}" for n in gates]), staged, partitions)
        found = seen.get
        if bad := {n: found[n] for n in gates if found[n]}:
            raise ContractError(f"{path} is not written: rows that break a contract: {bad}")
    except BaseException:
        _moved(spark, staged, None)
        raise
    _moved(spark, staged, path)
    return found


def positions(written: DataFrame) -> DataFrame:
    """The rows of a Parquet table with ``position``: their place when its files are read one after the other by name."""
    columns = written.columns
    rows = written.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each file
    return rows.join(F.broadcast(before.select("__file", "__before")), "__file").select(*columns, (F.col("__before") + F.col("__at") + 1).alias("position"))


def with_panels(df: DataFrame, panels: dict[str, DataFrame], id_column: str = "match_id") -> DataFrame:
    """The rows with a flag for each panel of ids: whether their id is in it.  One join, on one row of flags per id."""
    flags = list(panels)
    marks = None
    for name, ids in panels.items():
        own = ids.select(id_column, *[F.lit(f == name).alias(f) for f in flags])
        marks = own if marks is None else marks.unionByName(own)
    marks = marks.groupBy(id_column).agg(*[F.max(f).alias(f) for f in flags])
    return df.join(marks, id_column, "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns of a declared table: missing ones are typed nulls, others are cast."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def csv_text(df: DataFrame, order: list[Column | str], limit: int = 1_000_000) -> str:
    """A small ordered table as CSV with LF ends; larger ones are refused, they belong in Parquet."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in r] for r in rows)
    return out.getvalue()


def write_text(path: str, text: str) -> None:
    """Replace a file at once."""
    write_bytes(path, text.encode())


def write_bytes(path: str, content: bytes) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    temporary = at.with_suffix(at.suffix + ".tmp")
    temporary.write_bytes(content)
    temporary.replace(at)


def content_digest(df: DataFrame) -> str:
    """SHA-256 of what a table holds, whatever its order and files.

    Rows are hashed as JSON; the sorted hashes of a bucket, named by their
    first six digits, are hashed together, the buckets of three digits
    likewise, and then those.  Nothing but the last hash reaches the driver.
    """
    return content_digests(df).first()["digest"]


def content_digests(df: DataFrame) -> DataFrame:
    """(rows, digest) in one row; an empty table has the digest of an empty text."""
    of = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    rows = df.select(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    leaves = rows.groupBy(F.substring("h", 1, 6).alias("at")).agg(F.count("*").alias("n"), of("h").alias("h"))
    named = F.concat("at", "h")
    inner = leaves.groupBy(F.substring("at", 1, 3).alias("at")).agg(F.sum("n").alias("n"), of(named).alias("h"))
    return inner.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), of(named).alias("digest"))


def csv_files(df: DataFrame, folder: str, file: str = "file", order: tuple[str, ...] = ()) -> DataFrame:
    """Write a CSV with LF ends for each value of ``file``; the manifest (file, rows, bytes, sha256) of what was written.

    A file is one task's work and is written as its rows come, sorted by the JVM:
    no more than a batch of them is held.  Rows stand in the order of the columns
    ``order``, which are not written themselves.
    """
    columns = [c for c in df.columns if c != file and c not in order]
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, rows, size, digest = None, None, 0, 0, hashlib.sha256()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(text: str) -> None:
            nonlocal size
            content = text.encode()
            sink.write(content)
            digest.update(content)
            size += len(content)

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.record_batch([[name], pa.array([rows], pa.int64()), pa.array([size], pa.int64()), [digest.hexdigest()]], names=["file", "rows", "bytes", "sha256"])

        for batch in batches:
            names, lines = batch.column("__file").to_pylist(), batch.column("__line").to_pylist()
            lo = 0
            while lo < len(names):
                hi = bisect.bisect_right(names, names[lo], lo)
                if names[lo] != name:
                    if sink is not None:
                        yield closed()
                    name, rows, size, digest = names[lo], 0, 0, hashlib.sha256()
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    put(head.getvalue())
                put("\n".join(lines[lo:hi]) + "\n")
                rows, lo = rows + hi - lo, hi
        if sink is not None:
            yield closed()

    # sorted by the bytes of their names, as they are compared above
    text = df.select(F.coalesce(F.col(file).cast("string"), F.lit("None")).alias("__file"), csv_line(*[F.col(c).cast("string") for c in columns]).alias("__line"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(order)])
    dealt = text.repartition("__file").sortWithinPartitions("__file", *[F.col(f"__{k}").asc_nulls_last() for k in range(len(order))])
    manifest = dealt.select("__file", "__line").mapInArrow(run, "file string, rows bigint, bytes bigint, sha256 string")
    manifest.write.parquet(f"{folder}-manifest")
    return df.sparkSession.read.parquet(f"{folder}-manifest")


def csv_line(*values: Column) -> Column:
    """A line of CSV as Python's writer makes it: quotes only where they are needed, null as nothing."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    shown = [F.when(v.rlike('[",\r\n]'), quoted(v)).otherwise(F.coalesce(v, F.lit(""))) for v in values]
    if len(shown) == 1:  # else it would be a blank line
        return F.when(shown[0] == "", '""').otherwise(shown[0])
    return F.concat_ws(",", *shown)


def united(tables: list[DataFrame]) -> DataFrame:
    """Tables one after the other under the union of their columns, in the order in which they are first seen."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet of texts and numbers."""
    def cell(v: object, at: str) -> str:
        if v is None:
            return ""
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def name(k: int) -> str:
        return (name(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    body = "".join(f'<row r="{n}">' + "".join(cell(v, f"{name(k)}{n}") for k, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
    main, office, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, content in parts.items():
            z.writestr(zipfile.ZipInfo(path), f'<?xml version="1.0" encoding="UTF-8"?>{content}')
    return out.getvalue()
