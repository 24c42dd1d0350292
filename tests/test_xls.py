"""Workbooks of the older format: what is written comes back, pieces and damage included."""

import random
import struct

import pytest

from duelscope.sources import files, sinks, xls


def rows_of(rng):
    texts = ["Wimbledon", "é à", "日本語 text", "", "x" * 300, "Ωmega" * 40]
    return [["Tournament", "AvgW", None, "Flag"], *[[rng.choice(texts), rng.choice([1.85, 3, -7, 2**29, 1e-3, None]), None, rng.choice([True, False, None])] for _ in range(120)]]


def trimmed(rows):
    out = []
    for row in rows:
        while row and row[-1] is None:
            row = row[:-1]
        out.append(list(row))
    return out


@pytest.mark.parametrize("limit", [17, 64, 8224])
def test_older_workbooks_come_back(limit):
    rows = rows_of(random.Random(limit))
    assert trimmed(xls.sheet_rows(xls.workbook(rows, limit))) == trimmed(rows)


def test_both_formats_give_equal_rows(spark, tmp_path):
    rows = [r for r in rows_of(random.Random(1)) if r[0]]
    (tmp_path / "a.xls").write_bytes(xls.workbook(rows))
    (tmp_path / "b.xlsx").write_bytes(sinks.workbook(rows))
    got = {"a.xls": [], "b.xlsx": []}
    for r in files.workbooks(spark, str(tmp_path), ["Tournament", "AvgW"]).collect():
        got[r["source_file"]].append((r["source_row_number"], r["Tournament"], r["AvgW"]))
    assert sorted(got["a.xls"]) == sorted(got["b.xlsx"]) and len(got["a.xls"]) == len(rows) - 1
    assert {(r["path"].rpartition("/")[2], r["kind"], r["ok"]) for r in files.workbook_kinds(spark, str(tmp_path)).collect()} == {("a.xls", "xls", True), ("b.xlsx", "xlsx", True)}


def small_container(stream):
    """The stream in the small sectors of the root's stream."""
    n = -(-len(stream) // 64)
    root = stream.ljust(-(-n * 64 // 512) * 512, b"\0")
    sectors = len(root) // 512
    table = [0xFFFFFFFD, xls.LAST, xls.LAST, *[4 + i for i in range(sectors - 1)], xls.LAST]

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1) + bytes(36) + struct.pack("<IQ", start, size)

    header = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 2, 1, xls.LAST, 0)
    header += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    small = [*range(1, n), xls.LAST]
    fill = lambda x: struct.pack("<128I", *x, *[0xFFFFFFFF] * (128 - len(x)))
    return header + fill(table) + (entry("Root Entry", 5, 3, len(root)) + entry("Book", 2, 0, len(stream))).ljust(512, b"\0") + fill(small) + root


def test_small_streams_formulas_and_packed_numbers():
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    at = lambda r, c: struct.pack("<HHH", r, c, 0)
    rk = lambda v: struct.pack("<HI", 0, v)
    cells = [
        record(xls.SHORTS, struct.pack("<HH", 0, 1) + rk(5 << 2 | 2) + rk(185 << 2 | 3) + rk(struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32) + struct.pack("<H", 3)),
        record(xls.FORMULA, at(1, 0) + struct.pack("<d", 2.5) + bytes(8)),
        record(xls.FORMULA, at(1, 1) + bytes([0, 0, 0, 0, 0, 0, 255, 255]) + bytes(8)), record(xls.RESULT, struct.pack("<HB", 2, 0) + b"ab"),
        record(xls.FORMULA, at(1, 2) + bytes([1, 0, 1, 0, 0, 0, 255, 255]) + bytes(8)),
        record(xls.LABEL, at(2, 0) + struct.pack("<HB", 1, 1) + "é".encode("utf-16-le")), record(xls.TRUTH, at(2, 1) + bytes([7, 1])),
    ]
    head = record(xls.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    sheet = len(head) + 4 + 9 + 4
    stream = head + record(xls.SHEET, struct.pack("<IBBBBB", sheet, 0, 0, 1, 0, 65)) + record(xls.EOF, b"") + record(xls.BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)) + b"".join(cells) + record(xls.EOF, b"")
    assert xls.sheet_rows(small_container(stream)) == [[None, 5, 1.85, 0.5], [2.5, "ab", True], ["é"]]


def test_damaged_workbooks_raise():
    good = xls.workbook([["a", 1]])
    for bad in (b"", b"PK\3\4", good[:512], good[:600], xls.MAGIC + bytes(600)):
        with pytest.raises((xls.WorkbookError, struct.error)):
            xls.sheet_rows(bad)
    looped = bytearray(good)
    struct.pack_into("<I", looped, 512 + 4, 1)  # the directory's chain leads to itself
    with pytest.raises(xls.WorkbookError):
        xls.sheet_rows(bytes(looped))
    with pytest.raises(files.SourceError):
        files.sheet_rows(b"text")
