"""WARC archives: a writer with duplicate detection and a sequential reader.

Writing: payload digests are counted in the JVM; of equal payloads the one
with the smallest page_id becomes a response, the others revisits without
payload.  Each task writes its archives, one gzip member per record, straight
to the shared folder and returns their names; a task that runs again writes
files of its own, and only those of the attempt that succeeded are listed.

Reading: an archive is read from front to back in pieces.  Each member is
decompressed incrementally, the record is framed by its Content-Length, the
payload is hashed as it passes and checked against its digest.  Memory does
not depend on the size of a record or archive unless payloads are asked for.

Archives of others: records about the crawl (warcinfo, request, metadata and
types not named here) are framed and passed over; a block that is no HTTP
message is the payload itself.  A payload without a digest of its own gets its
SHA-1, digests may stand in hex, those of other kinds are not checked; length
and digest of a record that says it is truncated are those of what is there.
Bodies are taken as they are stored, whatever their transfer encoding.

Defined cases: null html is an empty payload; null url leaves out the target
URI, and line ends in a url are percent-encoded; a null page_id leaves out
the page number and reads back as null, and null is no smallest page_id; rows
that repeat page_id and payload are responses alike; a broken frame or
digest raises; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, kept_until_end, keyed, stash

DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
#: The longest head of an HTTP message that is read.
HEAD_BYTES = 1 << 20
#: Types of records with a payload: those that may begin with the head of an HTTP message, and those that do not (fixed values).
WITH_HEAD, BARE = ("response", "revisit"), ("resource", "conversion")
#: Payloads of at least so many bytes are looked up for equal ones.
MIN_BYTES = 0
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BrokenArchive(ValueError):
    """A record that is not framed, compressed or digested as it says."""


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1 of a string's UTF-8 bytes: each five hex digits are four base32 digits."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), base32_sha1(html).alias("digest"))
    sized = own.where(F.octet_length("html") >= min_bytes)
    first = stash(sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    joined = keyed(own, first, ["digest"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("first") != F.coalesce(F.col("page_id"), F.col("first") + 1), F.col("first")).alias("refers_to"))


def header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"), ("WARC-Date", DATE)]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if url is not None:
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return header(lines) + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives of all pages; the manifest (path, records, bytes) of those that hold them.

    Without a folder they stand in the shared one until the process ends, with
    those that failed attempts of a task have left; the manifest names neither.
    """
    folder = folder or kept_until_end(pages.sparkSession, fresh(pages.sparkSession, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            html = batch.column("html").cast(pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = fs.open_output_stream(path, compression=None), 0, 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                cell = lambda name: batch.column(name)[i].as_py()  # noqa: E731, B023
                member = packer.compress(record(cell("page_id"), cell("url"), html[i].as_py(), cell("digest"), cell("refers_to"))) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    yield pa.record_batch([pa.array([path]), pa.array([records]), pa.array([size])], names=["path", "records", "bytes"])
                    out = None
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([records]), pa.array([size])], names=["path", "records", "bytes"])

    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    manifest = planned(pages, min_bytes).mapInArrow(run, MANIFEST)
    return stash(manifest.withColumn("path", F.concat(F.lit(scheme), "path")), "manifest")


class Member:
    """The bytes of one gzip member at a time, from a source of pieces."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.ahead = read, b""

    def begin(self) -> bool:
        """Start the next member; false at the end of the archive."""
        if not self.ahead:
            self.ahead = self.read(CHUNK)
        self.unpack, self.held = zlib.decompressobj(31), b""
        return bool(self.ahead)

    def piece(self) -> bytes:
        """Some more bytes of the member, at most CHUNK; none at its end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.unpack.eof:
            source = self.unpack.unconsumed_tail or self.ahead or self.read(CHUNK)
            if not source:
                raise BrokenArchive("the archive ends within a member")
            if not self.unpack.unconsumed_tail:
                self.ahead = b""
            try:
                out = self.unpack.decompress(source, CHUNK)
            except zlib.error as e:
                raise BrokenArchive(f"a member cannot be decompressed: {e}") from e
            if self.unpack.eof:
                self.ahead = self.unpack.unused_data
            if out:
                return out
        return b""

    def until(self, end: bytes, most: int = 1 << 20) -> bytes:
        """What comes before ``end``, which is passed over."""
        got = b""
        while (at := got.find(end)) < 0:
            more = self.piece()
            if not more or len(got) > most:
                raise BrokenArchive(f"no {end!r} in a head")
            got += more
        self.held = got[at + len(end) :]
        return got[:at]

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            more = self.piece()
            if not more:
                raise BrokenArchive("a record is shorter than its Content-Length")
            self.held = more[n:]
            more = more[:n]
            n -= len(more)
            yield more


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def sha1_digest(stated: str) -> str | None:
    """The digest of a header as bare base32, which may stand there in hex; null if it is of another kind."""
    kind, _, digest = stated.partition(":")
    if kind.lower() != "sha1" or not digest:
        return None
    try:
        return base64.b32encode(bytes.fromhex(digest)).decode() if len(digest) == 40 else digest.upper()
    except ValueError:
        return None


def records(read: Callable[[int], bytes], payloads: bool = False) -> Iterator[dict]:
    """The responses, revisits, resources and conversions of one archive in order; with their payloads only if asked for."""
    member = Member(read)
    while member.begin():
        head = member.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise BrokenArchive("a member does not begin with a WARC version")
        of = fields(head)
        if not of.get("content-length", "").isdecimal():
            raise BrokenArchive("a record without Content-Length")
        kind, stated = of.get("warc-type"), sha1_digest(of.get("warc-payload-digest", ""))
        message = kind in WITH_HEAD and of.get("content-type", "").lower().startswith("application/http")
        http, kept, size, declared, sha = b"" if message else None, [], 0, None, hashlib.sha1()
        for more in member.exactly(int(of["content-length"])):
            if kind not in WITH_HEAD + BARE:
                continue
            if http is not None:
                http += more
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    if len(http) > HEAD_BYTES:
                        raise BrokenArchive("an HTTP head without an end")
                    continue
                length = fields(http[:at]).get("content-length", "")
                declared = int(length) if length.isdecimal() else None
                more, http = http[at + 4 :], None
            sha.update(more)
            size += len(more)
            if payloads:
                kept.append(more)
        rest = b""
        while len(rest) <= 4 and (more := member.piece()):
            rest += more
        if rest != b"\r\n\r\n" or (http is not None and (http or kind == "response")):
            raise BrokenArchive("a record does not end where its Content-Length says")
        if kind not in WITH_HEAD + BARE:
            continue
        digest = base64.b32encode(sha.digest()).decode()
        if kind == "revisit":
            digest, size = stated, declared
        elif "warc-truncated" not in of and (stated not in (None, digest) or declared not in (None, size)):
            raise BrokenArchive(f"the payload of page {of.get('x-page-id')} is not what its digest and length say")
        number = lambda name: int(of[name]) if name in of else None  # noqa: E731, B023
        yield {"page_id": number("x-page-id"), "url": of.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), **({"payload": b"".join(kept)} if payloads else {})}


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all archives of a manifest, a row each; ``payload`` too if asked for."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        def batch_of(rows):
            return pa.record_batch([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for r in records(source.read, payloads):
                        rows.append(r)
                        size += 200 + len(r.get("payload", b""))
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    spark = manifest.sparkSession
    files = manifest.select("path")
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path").mapInArrow(run, schema)


#: What the archives say, from the pages themselves, in DuckDB's SQL.
SQL = """
with own as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
dig as (
  select page_id, strlen(html)::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (k // 4) + 1)::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int + 1, 1)), 'string_agg', '') as payload_digest
  from own),
first as (select *, min(page_id) over (partition by payload_digest) as first from dig)
select page_id, payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from first
"""
