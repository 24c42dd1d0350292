"""CSV files of many blocks: rows, numbers and quoted line ends as one reader of the whole file gives them."""

import collections
import csv
import io
import random

import pytest

from duelscope.schemas import RAW_COLUMNS
from duelscope.sources import files


def contest_file(rng, n):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(RAW_COLUMNS)
    for i in range(n):
        row = [f"{i}-{k}" for k in range(len(RAW_COLUMNS))]
        row[1] = rng.choice(["plain", 'say "hi"', "two\nlines", "a,b", '"', "\n\n", 'many\n"quoted"\nlines, too\n' * 20, "", "é"])
        writer.writerow(row + (["beyond"] if i % 17 == 0 else []))
        if i % 23 == 0:
            out.write("\n")  # a blank line is no row
    return out.getvalue()


def by_one_reader(text):
    rows = []
    for n, row in enumerate(csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline=""), restkey="rest"), 1):
        rows.append((*[row.get(c) for c in RAW_COLUMNS], ",".join(row["rest"]) if row.get("rest") else None, n))
    return rows


@pytest.mark.parametrize("size", [200, 1000, 1 << 27])
def test_blocks_of_any_size_give_the_rows_of_one_reader(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {("atp", 1990 + k): contest_file(rng, 150) for k in range(2)} | {("wta", 1990): "﻿" + contest_file(rng, 40), ("wta", 1991): ",".join(RAW_COLUMNS), ("wta", 1992): ""}
    for (tour, year), text in texts.items():
        (tmp_path / tour).mkdir(exist_ok=True)
        (tmp_path / tour / f"{tour}_matches_{year}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = files.raw_rows(spark, str(tmp_path))
        got = collections.defaultdict(list)
        for r in rows.collect():
            got[r["tour"].lower(), r["year"]].append((*[r[c] for c in RAW_COLUMNS], r["overflow"], r["source_row_number"]))
        if size == 1000:
            lines = spark.read.text(f"{tmp_path}/atp/atp_matches_1990.csv")
            assert lines.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for key, text in texts.items():
        assert sorted(got[key], key=lambda r: r[-1]) == by_one_reader(text), key


def test_pinned_rows_name_their_commit(spark, tmp_path):
    (tmp_path / "atp").mkdir()
    for year in (2001, 2002):
        (tmp_path / "atp" / f"atp_matches_{year}.csv").write_text(",".join(RAW_COLUMNS) + "\n" + "x," * (len(RAW_COLUMNS) - 1) + "y\n")
    pins = spark.createDataFrame([("atp/atp_matches_2001.csv", "some/where", "abc")], "source_file string, repository string, commit string")
    got = {r["year"]: r["source_ref"] for r in files.raw_rows(spark, str(tmp_path), pins).collect()}
    assert got == {2001: "https://github.com/some/where/blob/abc/atp/atp_matches_2001.csv#L2", 2002: "local:atp/atp_matches_2002.csv#L2"}


@pytest.mark.parametrize("line, inside, want", [('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('5\'10",x', False, False), ('b",c', True, False), ('b"",c', True, True), ('b","c', True, True), ("", True, True), ("", False, False), ('"', False, True), ('""', False, False), ('"a"b"c,"d', False, True)])
def test_open_quotes(line, inside, want):
    assert files.ends_inside(line, inside) is want
