"""Queries through files: what a sink writes, a source reads, against the SQL of the rows themselves."""

from __future__ import annotations

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, contracts, metrics, normalize
from ..schemas import MODELS, RAW_COLUMNS
from ..sources import contests as src
from ..sources import files, scratch, sinks, xls
from .catalogue import OBSERVED, SUMMARY, C, cells, matches, observed, query

FILE = "case tour when 'F' then 'atp' else 'wta' end || '_matches_' || year || '.csv'"
RAW = C + f""", raw as (
  select *, {FILE} as file, row_number() over (partition by tour, year order by match_id) as row, case when is_walkover then 'W/O' when is_retirement then '6-4 RET' else '6-4 6-4' end as score from contests)"""


def raw_files(s: SparkSession, d: str, c: DataFrame | None = None) -> tuple[str, DataFrame]:
    """A folder of raw contest files, one per tour and year, and its manifest."""
    c = matches(s, d) if c is None else c
    named = c.withColumns({"file": F.concat(F.when(F.col("tour") == "F", "atp").otherwise("wta"), F.lit("_matches_"), F.col("year").cast("string"), F.lit(".csv")), "tourney_date": F.date_format("event_date", "yyyyMMdd")})
    rows = named.select("file", "match_id", *[(F.col(x) if x in named.columns else F.lit(None)).cast("string").alias(x) for x in RAW_COLUMNS])
    folder = scratch.folder(s, "raw")
    return folder, sinks.csv_files(rows, folder, order=("match_id",))


def read_back(s: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    return files.raw_rows(s, raw_files(s, d, c)[0])


query("snk07_csv_files", f"with {RAW} select file, count(*) as rows from raw group by file")(lambda s, d: raw_files(s, d)[1].select("file", "rows"))
query("src10_discovered", f"with {RAW} select distinct case tour when 'F' then 'ATP' else 'WTA' end as tour, year::int as year, file from raw")(
    lambda s, d: files.discovered(s, raw_files(s, d)[0]).select("tour", "year", F.regexp_extract("path", "[^/]+$", 0).alias("file")))
query("src12_raw_rows", f"with {RAW} select file, row::bigint as source_row_number, winner_name, loser_name, winner_rank::varchar as winner_rank, round, score from raw")(
    lambda s, d: read_back(s, d).select(F.regexp_extract("source_file", "[^/]+$", 0).alias("file"), "source_row_number", "winner_name", "loser_name", F.nullif("winner_rank", F.lit("")).alias("winner_rank"), F.nullif("round", F.lit("")).alias("round"), "score"))


@query("src08_verified_files", f"with {RAW} select file, case when file like '%1996.csv' then 'different' else 'as locked' end as found from (select distinct file from raw)")
def src08(s, d):
    """Every file against the lock of what was written; the files of one year are changed afterwards."""
    folder, manifest = raw_files(s, d)

    def touched(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{base}/{key[0]}", compression=None) as source, store.open_output_stream(f"{base}/{key[0]}.changed", compression=None) as sink:
            last = b""
            while piece := source.read(files.PIECE):
                sink.write(last + piece[:-1])
                last = piece[-1:]
            sink.write(b" ")
        store.move(f"{base}/{key[0]}.changed", f"{base}/{key[0]}")
        return rows[["file"]]

    manifest.where("file like '%1996.csv'").select("file").groupBy("file").applyInPandas(touched, "file string").write.parquet(f"{folder}-touched")
    found = files.digests(s, folder, "*.csv").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "bytes", "sha256")
    gaps = files.manifest_gaps(manifest, found, ("file",), ("bytes", "sha256"))
    return found.select("file").join(gaps, "file", "left").select("file", F.coalesce("problem", F.lit("as locked")).alias("found"))


@query("src07_lock_gaps", f"with {RAW}, f as (select distinct file from raw) select file, case when file like 'atp%' then 'missing' else 'different' end as problem from f where file like 'atp%' or file like '%1995.csv' union all select file, 'duplicate' from f where file = 'wta_matches_1996.csv' union all select 'extra.csv', 'unexpected'")
def src07(s, d):
    """A lock that lacks one tour, says another size of a year, lists a file twice and one that is not there."""
    true = raw_files(s, d)[1].select("file", "rows")
    lock = true.where("file not like 'atp%'").withColumn("rows", F.when(F.col("file").endswith("1995.csv"), F.col("rows") + 1).otherwise(F.col("rows")))
    lock = lock.unionByName(true.where("file = 'wta_matches_1996.csv'")).unionByName(s.createDataFrame([("extra.csv", 1)], "file string, rows bigint"))
    return files.manifest_gaps(lock, true, ("file",), ("rows",)).select("file", "problem").distinct()


QUOTED = ("plain", 'say "hi"', "two\nlines", "a,b", '"', 'ends with\n')


@query("src12_quoted_rows", f"with {RAW} select file, row::bigint as source_row_number, " + "winner_name || ' ' || ['plain', 'say \"hi\"', 'two' || chr(10) || 'lines', 'a,b', '\"', 'ends with' || chr(10)][(match_id % 6 + 1)::int] as winner_name from raw")
def src12_quoted(s, d):
    """Names with quotes, commas and line ends, through files and back."""
    c = matches(s, d)
    odd = F.element_at(F.array(*map(F.lit, QUOTED)), F.pmod("match_id", F.lit(6)).cast("int") + 1)
    return read_back(s, d, c.withColumn("winner_name", F.concat("winner_name", F.lit(" "), odd))).select(F.regexp_extract("source_file", "[^/]+$", 0).alias("file"), "source_row_number", "winner_name")


@query("src13_source_refs", f"with {RAW} select file, row::bigint as source_row_number, case when file like 'atp%' then 'https://github.com/some/where/blob/c' || year || '/' || file || '#L' || (row + 1) else 'local:' || file || '#L' || (row + 1) end as source_ref from raw")
def src13(s, d):
    """Rows of one tour are pinned to a commit for each year, the others are local."""
    folder, manifest = raw_files(s, d)
    there = f"{folder.rstrip('/').rpartition('/')[2]}/"
    pins = manifest.where("file like 'atp%'").select(F.concat(F.lit(there), "file").alias("source_file"), F.lit("some/where").alias("repository"), F.concat(F.lit("c"), F.regexp_extract("file", "[0-9]{4}", 0)).alias("commit"))
    return files.raw_rows(s, folder, pins).select(F.regexp_extract("source_file", "[^/]+$", 0).alias("file"), "source_row_number", F.replace("source_ref", F.lit(there), F.lit("")).alias("source_ref"))


NORMAL = f"""with {RAW} select file, row::bigint as source_row_number, event_date as tourney_date, level as tourney_level, surface, round, winner_id::bigint as winner_id, loser_id::bigint as loser_id, winner_rank::int as winner_rank, best_of::int as best_of,
  winner_seed, winner_entry, is_walkover, is_retirement and not is_walkover as is_retirement, slam from raw"""
query("prj01_normalized_rows", NORMAL)(lambda s, d: normalize.normalize(read_back(s, d)).select(
    F.regexp_extract("source_file", "[^/]+$", 0).alias("file"), "source_row_number", "tourney_date", "tourney_level", "surface", "round", "winner_id", "loser_id", "winner_rank", "best_of", "winner_seed", "winner_entry", "is_walkover", "is_retirement", "slam"))
query("snk08_issue_rows", f"with {RAW} select tour, count(*) as contests, 0::bigint as unread from (select case tour when 'F' then 'ATP' else 'WTA' end as tour from raw) group by tour")(
    lambda s, d: normalize.normalize(read_back(s, d)).groupBy("tour").agg(F.count("*").alias("contests"), F.sum(F.size(F.filter("issues", lambda i: i["issue"] == "not an integer"))).cast("bigint").alias("unread")))

# --- Parquet, JSON, CSV ----------------------------------------------------------------


def through_parquet(s: SparkSession, df: DataFrame, **how) -> DataFrame:
    path = scratch.folder(s, "table")
    sinks.parquet(df, path, **how)
    return s.read.schema(df.schema).parquet(path)


def ordered_back(s: SparkSession, df: DataFrame, order: list) -> DataFrame:
    """The rows as an ordered sink writes them, with the place at which a reader finds each."""
    path = scratch.folder(s, "ordered")
    sinks.parquet(df, path, order=order)
    return sinks.positions(s.read.schema(df.schema).parquet(path))


query("snk03_ordered_parquet", f"with {C} select match_id, tour, year, surface, row_number() over (order by tour, year, match_id)::bigint as position from contests")(lambda s, d: ordered_back(s, src.contests(s, d).select("match_id", "tour", "year", "surface"), ["tour", "year", "match_id"]))


ISSUE_ORDER = "case severity when 'error' then 1 when 'warning' then 2 else 3 end, category, tour nulls first, year nulls first, tourney_id nulls first, tourney_name nulls first, source_file nulls first, source_row_number nulls first, match_id nulls first, field nulls first, value nulls first, detail nulls first"


@query("snk08_ordered_issues", f"""with {C}, i as (select 'info' as severity, 'missing_value' as category, tour, year::int as year, tourney_id, tourney_name, source_file, match_id as source_row_number, match_id::varchar as match_id, unnest([case when round is null then 'round' end, case when winner_rank is null then 'winner_rank' end, case when loser_rank is null then 'loser_rank' end]) as field, null::varchar as value, null::varchar as detail from contests)
select match_id, field, row_number() over (order by {ISSUE_ORDER})::bigint as position from i where field is not null""")
def snk08(s, d):
    """The findings in the total order of their export, with the place at which a reader finds each."""
    found = audit.missing_values(matches(s, d), ("round", "winner_rank", "loser_rank"))
    return ordered_back(s, found, audit.in_order(found)).select(F.col("match_id").cast("string").alias("match_id"), "field", "position")


@query("snk10_detail_flags", f"""with {OBSERVED}, own as (select * from observed where population = 'completed_non_retirement' and score_eligible and slam is not null),
common as (select match_id from own group by match_id having count(distinct model) = 3), early as (select match_id from own where year <= 1997 group by match_id)
select match_id, model, match_id in (select match_id from common) as in_common_panel, match_id in (select match_id from early) as in_early_panel, row_number() over (order by tour, year, match_id, model)::bigint as position from own""")
def snk10(s, d):
    """Detail rows with the panels their contest is in, in total order."""
    own = observed(s, d).where("population = 'completed_non_retirement' and score_eligible and slam is not null")
    flagged = sinks.with_panels(own, {"in_common_panel": contracts.common_panel(own, MODELS), "in_early_panel": own.where("year <= 1997").select("match_id")})
    return ordered_back(s, flagged.select("tour", "year", "match_id", "model", "in_common_panel", "in_early_panel"), ["tour", "year", "match_id", "model"]).drop("tour", "year")


query("src17_pruned_partitions", f"with {C} select match_id, surface from contests where tour = 'F' and year = 1996")(
    lambda s, d: through_parquet(s, src.contests(s, d).select("match_id", "surface", "tour", "year"), partitions=("tour", "year")).where("tour = 'F' and year = 1996").select("match_id", "surface"))
query("snk06_typed_table", "select s_suppkey::varchar as key, s_acctbal::double as balance, null::bigint as rank, null::varchar as note, s_nationkey::int as nation from supplier")(
    lambda s, d: through_parquet(s, sinks.typed(src.table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")), {"key": "string", "balance": "double", "rank": "bigint", "note": "string", "nation": "int"})))


@query("src27_json_lines", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def src27(s, d):
    path, rows = scratch.folder(s, "lines"), src.table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))
    rows.write.json(path)
    return s.read.schema(rows.schema).json(path)


@query("src20_declared_csv", "select c_custkey::bigint as id, c_acctbal > 0 as solvent, c_mktsegment as segment from customer")
def src20(s, d):
    path, words = scratch.folder(s, "csv"), F.element_at(F.array(*map(F.lit, ("1", "TRUE", "t", " yes"))), F.pmod("c_custkey", F.lit(4)).cast("int") + 1)
    rows = src.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, words).otherwise("no").alias("solvent"), F.col("c_mktsegment").alias("segment"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.declared_csv(s, path, "id bigint, solvent string, segment string", ("solvent",))


@query("src23_alias_years", "select 'ATP' as tour, (2000 + n_nationkey % 3 + k.k)::int as year, n_name as odds_name, n_nationkey::bigint as canonical_player_id from nation, range(0, 4) k(k) where k.k <= n_regionkey")
def src23(s, d):
    path, n = scratch.folder(s, "aliases"), src.table(s, d, "nation")
    start = 2000 + F.pmod("n_nationkey", F.lit(3))
    rows = n.select(F.lit("ATP").alias("tour"), start.alias("start_year"), (start + F.least("n_regionkey", F.lit(3))).alias("end_year"), F.col("n_name").alias("odds_name"), F.col("n_nationkey").alias("canonical_player_id"), F.col("n_name").alias("canonical_name"), F.lit("same").alias("reason"), F.lit("2024-01-01").alias("reviewed_on"))
    rows.write.option("header", True).csv(path)
    return files.aliases(s, path).select("tour", F.explode(F.sequence("start_year", "end_year")).alias("year"), "odds_name", "canonical_player_id")


@query("src22_reference_table", f"with {OBSERVED}, {SUMMARY}, a as (select 'maximum_available' as sample, population, tour, slam, model, excess_per_100, null::bigint as score_matches from summaries where model <> 'surface_elo'), b as (select 'common_matched' as sample, population, tour, slam, model, excess_per_100, score_matches from summaries where model = 'surface_elo') select * from a where population = 'completed_non_retirement' union all select * from b where population = 'completed_non_retirement'")
def src22(s, d):
    """Two summaries written as CSV, read with declared types and put one after the other."""
    found = metrics.summaries(cells(s, d))
    types = "population string, tour string, slam string, model string, excess_per_100 double"
    tables = []
    for sample, rows, more in (("maximum_available", found.where("model <> 'surface_elo'"), ""), ("common_matched", found.where("model = 'surface_elo'"), ", score_matches bigint")):
        path = scratch.folder(s, "summary")
        rows.select(*[f.split()[0] for f in (types + more).split(", ")]).write.option("header", True).csv(path)
        tables.append(files.declared_csv(s, path, types + more).withColumn("sample", F.lit(sample)).where("population = 'completed_non_retirement'"))
    return sinks.united(tables)


query("snk07_union_header", "select n_nationkey::bigint as k, n_name as a, null::varchar as b from nation union all select r_regionkey, null, r_name from region")(
    lambda s, d: sinks.united([src.table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("a")), src.table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("b"))]))
query("snk14_content_digest", """with r as (select sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') as h from nation), l as (select h[1:6] as p, count(*) as n, sha256(string_agg(h, '' order by h)) as h from r group by 1),
i as (select p[1:3] as p, sum(n)::bigint as n, sha256(string_agg(p || h, '' order by p || h)) as h from l group by 1) select sum(n)::bigint as rows, sha256(string_agg(p || h, '' order by p || h)) as digest from i""")(lambda s, d: sinks.content_digests(src.table(s, d, "nation").select("n_nationkey", "n_name")))

# --- workbooks ---------------------------------------------------------------------------


def price_books(s: SparkSession, d: str) -> str:
    """A workbook per nation of suppliers, of the older format for every other one, written by the tasks that hold them."""
    folder = scratch.folder(s, "books")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        body = [["Tournament", "Round", "Winner", "AvgW", None], *[[t, r, w, float(a), "x"] for t, r, w, a in rows.sort_values("s_suppkey")[["Tournament", "Round", "Winner", "AvgW"]].itertuples(index=False)]]
        name, made = (f"{key[0]:03d}.xls", xls.workbook) if key[0] % 2 else (f"{key[0]:03d}.xlsx", sinks.workbook)
        with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
            sink.write(made(body))
        return pd.DataFrame({"book": [name]})

    names = F.array(*map(F.lit, ("Wimbledon", "French Open", "Elsewhere", "US Open")))
    rounds = F.array(*map(F.lit, ("1st Round", "The Final", "Odd")))
    own = src.table(s, d, "supplier").select("s_nationkey", "s_suppkey", F.element_at(names, F.pmod("s_suppkey", F.lit(4)).cast("int") + 1).alias("Tournament"), F.element_at(rounds, F.pmod("s_suppkey", F.lit(3)).cast("int") + 1).alias("Round"), F.col("s_name").alias("Winner"), (1 + F.pmod("s_suppkey", F.lit(50)) / 8).alias("AvgW"))
    own.groupBy("s_nationkey").applyInPandas(write, "book string").write.parquet(f"{folder}-books")
    return folder


BOOKS = """rows as (select *, (row_number() over (partition by s_nationkey order by s_suppkey) + 1)::bigint as source_row_number, lpad(s_nationkey::varchar, 3, '0') || case when s_nationkey % 2 = 1 then '.xls' else '.xlsx' end as source_file,
  ['Wimbledon', 'French Open', 'Elsewhere', 'US Open'][(s_suppkey % 4 + 1)::int] as tournament, ['1st Round', 'The Final', 'Odd'][(s_suppkey % 3 + 1)::int] as of_round, 1 + (s_suppkey % 50) / 8 as price from supplier)"""
HEADS = ["Tournament", "Round", "Winner", "AvgW", "_blank_4"]
query("src14_workbook_rows", f"with {BOOKS} select source_file, source_row_number, s_name as winner, price::double as price, 'x' as blank from rows")(
    lambda s, d: files.workbooks(s, price_books(s, d), HEADS).select("source_file", "source_row_number", F.col("Winner").alias("winner"), F.col("AvgW").cast("double").alias("price"), F.col("_blank_4").alias("blank")))
query("src15_slam_prices", f"with {BOOKS} select source_file, source_row_number, case tournament when 'French Open' then 'Roland Garros' else tournament end as slam, case of_round when '1st Round' then 'R128' when 'The Final' then 'F' end as round from rows where tournament <> 'Elsewhere'")(
    lambda s, d: files.slam_prices(files.workbooks(s, price_books(s, d), HEADS)).select("source_file", "source_row_number", "slam", "round"))
query("src15_field_audit", f"with {BOOKS} select source_file, count(*) as rows, count(*) filter (price > 1) as priced from rows group by source_file")(
    lambda s, d: files.field_audit(files.workbooks(s, price_books(s, d), HEADS).withColumn("AvgW", F.col("AvgW").cast("double")), ["AvgW"]).select("source_file", "rows", F.col("AvgW").alias("priced")))
query("src04_workbook_kinds", f"with {BOOKS} select distinct source_file as book, string_split(source_file, '.')[2] as kind, true as ok from rows")(lambda s, d: files.workbook_kinds(s, price_books(s, d)).select(F.regexp_extract("path", "[^/]+$", 0).alias("book"), "kind", "ok"))
