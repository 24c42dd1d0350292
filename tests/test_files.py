"""Workbooks, file sinks, contracts and scenario conditions on small tables."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from duelscope.operators import audit, contracts, metrics, resample, scenarios
from duelscope.plans import robustness
from duelscope.sources import files, scratch, sinks


def test_workbooks_come_back_as_written():
    rows = [["a", None, "c"], ["x", 1, None], [], [None, 2.5, " y&<z> "], ["", None, None]]
    assert files.sheet_rows(sinks.workbook(rows)) == [["a", None, "c"], ["x", 1], [], [None, 2.5, " y&<z> "], [""]]
    assert files.workbook_rows(files.sheet_rows(sinks.workbook(rows))) == [{"a": "x", "_blank_1": 1, "c": None, "_row": 2}, {"a": None, "_blank_1": 2.5, "c": " y&<z> ", "_row": 4}]
    with pytest.raises(files.SourceError):
        files.sheet_rows(bytes.fromhex(files.OLE2) + b"old")


def test_workbooks_with_shared_texts_and_gaps():
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="S" sheetId="4" r:id="rId9"/><sheet name="T" sheetId="5" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="/xl/worksheets/first.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>Win</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>',
        "xl/worksheets/first.xml": f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4"><v>1.5</v></c><c r="C4" t="str"><f>A1</f><v>q</v></c><c r="D4"/></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    rows = files.sheet_rows(out.getvalue())
    assert len(rows) == 4 and rows[0] == rows[2] == [] and rows[1][1] == "Win" and rows[1][26] == "two runs" and rows[3] == [True, 1.5, "q", None]


def test_csv_files_and_their_manifest(spark):
    rows = [("b.csv", 2, "x,y", None), ("a.csv", 1, 'say "hi"', 1), ("b.csv", 1, "line\nend", 3)]
    folder = scratch.folder(spark, "csv")
    manifest = {r["file"]: r for r in sinks.csv_files(spark.createDataFrame(rows, "file string, n int, text string, k int"), folder, order=("n",)).collect()}
    text = {f: bytes(spark.read.format("binaryFile").load(f"{folder}/{f}").first()["content"]).decode() for f in manifest}
    assert text == {"a.csv": 'text,k\n"say ""hi""",1\n', "b.csv": 'text,k\n"line\nend",3\n"x,y",\n'} and manifest["b.csv"]["rows"] == 2 and manifest["a.csv"]["bytes"] == len(text["a.csv"])


def test_content_digests_know_content_alone(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("b"))
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy(F.rand(3)).repartition(5)) != sinks.content_digest(df.where("id <> 7"))
    assert sinks.content_digest(df.unionByName(df.limit(1))) != sinks.content_digest(df)
    assert sinks.content_digests(df.limit(0)).first()["rows"] == 0


def test_contracts_of_dates_order_and_coverage(spark):
    one = spark.createDataFrame([(1, "A"), (2, "A")], "match_id int, model string")
    contracts.check_covered(one, one)
    with pytest.raises(contracts.ContractError):
        contracts.check_covered(one, one.where("match_id = 1"))
    games = spark.sql("select 'A' as tour, date'2000-01-01' as event_date, 2000 as year, 'x' as tourney_name, 'F' as round, 1 as winner_id, 2 as loser_id, 'f' as source_file, k as match_id from values (1), (2) as t(k)")
    contracts.check_batch_dates(games, own="event_date")
    contracts.check_representative_order(games)
    with pytest.raises(contracts.ContractError):
        contracts.check_representative_order(games.withColumn("match_id", F.lit(1)))


def test_low_years_leave_one_out_of_the_median(spark):
    rows = [("A", y, i) for y in range(1988, 2026) for i in range(2 if y in (2020, 1990) else 10)] + [("A", 1950, 0)]
    found = {(r["year"], r["severity"]) for r in audit.low_years(spark.createDataFrame(rows, "tour string, year int, i int")).collect()}
    assert found == {(2020, "info"), (1990, "warning")}


def test_paired_differences_against_plain_python(spark):
    rows = [("s", "A", "W", f"e{i % 3}", i, 0.1 * i, 0.2, True, 0.3, i % 2) for i in range(6)] + [("s", "A", "W", "e0", 9, 0.5, 0.1, False, None, None)]
    names = "model string, tour string, slam string, edition_id string, match_id int, brier double, log_loss double, upset_eligible boolean, p_under double, upset int"
    variant = spark.createDataFrame(rows, names)
    primary = variant.withColumns({"model": F.lit("p"), "brier": F.lit(0.1), "p_under": F.lit(0.25), "upset": F.lit(0), "upset_eligible": F.col("match_id") != 1})
    sums = metrics.paired_sums(variant, primary)
    r = metrics.paired_points(sums).first()
    assert (r["score_n"], r["pair_n"], r["primary_ties"], r["variant_ties"], r["ties_created"], r["ties_removed"], r["editions"]) == (7, 5, 1, 1, 1, 1, 3)
    assert r["brier_score"] == pytest.approx((1.5 + 0.5) / 7 - 0.1, abs=1e-6) and r["expected_per_100"] == pytest.approx(5.0) and r["actual_per_100"] == pytest.approx(40.0)
    found = resample.paired_probability_intervals(sums, replicates=200).toPandas().set_index("metric")
    assert found.loc["brier_score", "low"] <= r["brier_score"] + 1e-6 and found.loc["actual_per_100", "point"] == pytest.approx(40.0)


def test_every_scenario_has_its_sql():
    assert set(scenarios.tags()) == set(robustness.CONDITIONS) == set().union(*robustness.FAMILIES.values())


def test_files_are_written_and_read_through_in_pieces(spark, tmp_path):
    """Rows of a file come to its writer in several batches, never as one table; digests do not hold a file."""
    rows = spark.range(5000).select(F.concat(F.lit("f"), F.pmod("id", F.lit(3)).cast("string"), F.lit(".csv")).alias("file"), (5000 - F.col("id")).alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit('a,"'), F.col("id").cast("string"))).alias("text"))
    folder = f"file://{tmp_path}/out"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        manifest = sinks.csv_files(rows, folder, order=("n",))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = {r["path"].rpartition("/")[2]: (r["bytes"], r["sha256"]) for r in files.digests(spark, folder, "f*.csv").collect()}
    assert found == {r["file"]: (r["bytes"], r["sha256"]) for r in manifest.collect()} and sum(r["rows"] for r in manifest.collect()) == 5000
    want = sorted((5000 - i, "" if i % 7 == 0 else f'a,"{i}') for i in range(5000) if i % 3 == 1)
    with open(f"{tmp_path}/out/f1.csv", newline="") as f:
        assert [r[0] for r in csv.reader(f)] == ["text", *[t for _, t in want]]
    assert "sha2(" not in files.digests(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
