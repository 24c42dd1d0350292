"""The older workbook format: a container of sector chains (OLE2), in it a stream of records (BIFF8).

Only what a table of prices holds is read: texts, numbers, truth values and
the stored results of formulas on the first sheet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
#: Ids of records (fixed values).
BOF, EOF, SHEET, TEXTS, MORE, TEXT_AT, NUMBER, SHORT, SHORTS, LABEL, TRUTH, FORMULA, RESULT = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x205, 0x06, 0x207
#: Streams below this size lie in the small sectors of the root's stream (fixed value).
SMALL = 4096
LAST = 0xFFFFFFFE


class WorkbookError(ValueError):
    """Bytes that are not a workbook of this format, or a damaged one."""


class Container:
    """Streams by name."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC or len(content) < 512:
            raise WorkbookError("not a workbook of the older format")
        self.content, self.size = content, 1 << struct.unpack_from("<H", content, 30)[0]
        first_directory, first_small, first_more, more = (struct.unpack_from("<I", content, at)[0] for at in (48, 60, 68, 72))
        tables = [s for s in struct.unpack_from("<109I", content, 76) if s < LAST - 1]
        for _ in range(more):
            part = struct.unpack(f"<{self.size // 4}I", self.sector(first_more))
            tables += [s for s in part[:-1] if s < LAST - 1]
            first_more = part[-1]
        self.next = [n for s in tables for n in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        small = b"".join(self.chain(first_small)) if first_small < LAST - 1 else b""
        self.next_small = struct.unpack(f"<{len(small) // 4}I", small)
        directory, self.streams = b"".join(self.chain(first_directory)), {}
        root = b""
        for at in range(0, len(directory) - 127, 128):
            length, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<II", directory, at + 116)
            if kind == 5:
                root = b"".join(self.chain(start))[:size] if size else b""
            elif kind == 2:
                self.streams[directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (start, size)
        self.root = root

    def sector(self, s: int) -> bytes:
        part = self.content[(s + 1) * self.size : (s + 2) * self.size]
        if not part:
            raise WorkbookError("a sector lies beyond the file")
        return part.ljust(self.size, b"\0")

    def chain(self, s: int) -> Iterator[bytes]:
        for _ in range(len(self.next) + 1):
            if s >= LAST - 1:
                return
            yield self.sector(s)
            if s >= len(self.next):
                raise WorkbookError("a chain leaves the table of sectors")
            s = self.next[s]
        raise WorkbookError("a chain of sectors has no end")

    def stream(self, *names: str) -> bytes:
        start, size = next((self.streams[n] for n in names if n in self.streams), (0, -1))
        if size < 0:
            raise WorkbookError("the container holds no workbook")
        if size >= SMALL:
            return b"".join(self.chain(start))[:size]
        parts: list[bytes] = []
        while start < LAST - 1 and len(parts) <= len(self.next_small):
            parts.append(self.root[start * 64 : start * 64 + 64])
            if start >= len(self.next_small):
                raise WorkbookError("a chain leaves the table of small sectors")
            start = self.next_small[start]
        return b"".join(parts)[:size]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class Texts:
    """The shared texts: they run on over the ends of records, where a text that is cut says anew how wide its characters are."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise WorkbookError("the shared texts end early")
            piece = self.parts[self.part][self.at : self.at + n]
            self.at, n, out = self.at + len(piece), n - len(piece), out + piece
        return out

    def characters(self, n: int, wide: int) -> str:
        out = ""
        while n:
            if self.at >= len(self.parts[self.part]):
                wide = self.take(1)[0] & 1
            here = min(n, (len(self.parts[self.part]) - self.at) // (1 + wide))
            if not here:
                raise WorkbookError("a character is cut")
            out += self.take(here * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= here
        return out

    def each(self) -> Iterator[str]:
        for _ in range(struct.unpack("<II", self.take(8))[1]):
            count, flags = struct.unpack("<HB", self.take(3))
            runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
            more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
            text = self.characters(count, flags & 1)
            self.take(4 * runs + more)
            yield text


def short(rk: int) -> float:
    """A number of 30 bits, whole or the head of a double, perhaps in hundredths."""
    value = float((rk - (1 << 32) if rk >> 31 else rk) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & ~3) << 32))[0]
    return value / 100 if rk & 1 else value


def sheet_rows(content: bytes) -> list[list]:
    """The rows of the first sheet, row 1 first; texts, numbers and truth values as they are."""
    stream = Container(content).stream("Workbook", "Book")
    start, parts, inside = None, [], False
    for kind, data in records(stream):
        if kind == SHEET and start is None and data[5] == 0:
            start = struct.unpack_from("<I", data)[0]
        if kind == TEXTS or kind == MORE and inside:
            parts.append(data)
        inside = kind == TEXTS or kind == MORE and inside
        if kind == EOF:
            break
    if start is None:
        raise WorkbookError("no sheet")
    texts = list(Texts(parts).each()) if parts else []
    cells: dict[tuple[int, int], object] = {}
    waits: tuple[int, int] | None = None
    whole = lambda x: int(x) if x == x and abs(x) < 1e300 and float(x).is_integer() else x
    for k, (kind, data) in enumerate(records(stream, start)):
        if k == 0 and kind != BOF:
            raise WorkbookError("a sheet does not begin where it should")
        if kind == EOF:
            break
        at = struct.unpack_from("<HH", data) if len(data) >= 4 else None
        if kind == TEXT_AT:
            cells[at] = texts[struct.unpack_from("<I", data, 6)[0]]
        elif kind == NUMBER:
            cells[at] = whole(struct.unpack_from("<d", data, 6)[0])
        elif kind == SHORT:
            cells[at] = whole(short(struct.unpack_from("<I", data, 6)[0]))
        elif kind == SHORTS:
            for i in range((len(data) - 6) // 6):
                cells[at[0], at[1] + i] = whole(short(struct.unpack_from("<I", data, 6 + 6 * i)[0]))
        elif kind == LABEL:
            cells[at] = Texts([data[9:]]).characters(struct.unpack_from("<H", data, 6)[0], data[8] & 1)
        elif kind == TRUTH and not data[7]:
            cells[at] = data[6] == 1
        elif kind == FORMULA:
            if data[12:14] != b"\xff\xff":
                cells[at] = whole(struct.unpack_from("<d", data, 6)[0])
            elif data[6] == 1:
                cells[at] = data[8] == 1
            waits = at if data[12:14] == b"\xff\xff" and data[6] == 0 else None
        elif kind == RESULT and waits:
            cells[waits], waits = Texts([data[3:]]).characters(struct.unpack_from("<H", data)[0], data[2] & 1), None
    rows: list[list] = [[] for _ in range(1 + max((r for r, _ in cells), default=-1))]
    for (r, c), value in sorted(cells.items()):
        rows[r] += [None] * (c + 1 - len(rows[r]))
        rows[r][c] = value
    return rows


def workbook(rows: list[list], limit: int = 8224) -> bytes:
    """A workbook of one sheet in this format.  limit: bytes of a record, after which shared texts go on in the next one."""
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    texts = list(dict.fromkeys(v for row in rows for v in row if isinstance(v, str)))
    parts = [struct.pack("<II", sum(isinstance(v, str) for row in rows for v in row), len(texts))]
    for text in texts:
        wide = not all(ord(ch) < 256 for ch in text)
        units = text.encode("utf-16-le") if wide else text.encode("latin-1")
        if len(parts[-1]) + 3 + 2 > limit:
            parts.append(b"")
        parts[-1] += struct.pack("<HB", len(units) // (1 + wide), wide)
        while units:
            room = (limit - len(parts[-1])) // (1 + wide) * (1 + wide)
            if room <= 0:
                parts.append(bytes([wide]))
                continue
            parts[-1], units = parts[-1] + units[:room], units[room:]
    body = [record(BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))]
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, bool):
                body.append(record(TRUTH, at + bytes([v, 0])))
            elif isinstance(v, str):
                body.append(record(TEXT_AT, at + struct.pack("<I", texts.index(v))))
            elif isinstance(v, int) and abs(v) < 1 << 28:
                body.append(record(SHORT, at + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF)))
            elif v is not None:
                body.append(record(NUMBER, at + struct.pack("<d", v)))
    shared = record(TEXTS, parts[0]) + b"".join(record(MORE, p) for p in parts[1:])
    head = record(BOF, struct.pack("<HHHHII", 0x600, 0x5, 0, 0, 0, 0))
    name = struct.pack("<BB", 6, 0) + b"Sheet1"
    sheet = len(head) + 4 + 6 + len(name) + len(shared) + 4
    stream = head + record(SHEET, struct.pack("<IBB", sheet, 0, 0) + name) + shared + record(EOF, b"") + b"".join(body) + record(EOF, b"")
    size = max(SMALL, len(stream))
    sectors = -(-size // 512)
    tables = 1
    while tables * 128 < sectors + 1 + tables:
        tables += 1
    if tables > 109:
        raise WorkbookError("too large a workbook for its first table of sectors")
    following = [0xFFFFFFFD] * tables + [LAST] + [tables + 2 + i for i in range(sectors - 1)] + [LAST]
    following += [0xFFFFFFFF] * (tables * 128 - len(following))

    def entry(name: str, kind: int, start: int, size: int, child: int = 0xFFFFFFFF) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, LAST, 0, 1) + entry("Workbook", 2, tables + 1, size) + bytes(256)
    header = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, tables, tables, 0, SMALL, LAST, 0, LAST, 0)
    header += struct.pack("<109I", *range(tables), *[0xFFFFFFFF] * (109 - tables))
    return header + struct.pack(f"<{tables * 128}I", *following) + directory + stream.ljust(sectors * 512, b"\0")
