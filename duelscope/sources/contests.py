"""Contest adapters over order and event tables.

``contests`` pairs neighbouring lines of an order and ``event_contests``
neighbouring events; both give the columns of a canonical contest, so that
every operator can run on them.  They are plain column expressions over one
window on the order key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import probability as P
from ..schemas import MODELS, ROUNDS
from . import scratch, sinks

ENTRIES = ("Q", "WC", "LL")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def contests(spark: SparkSession, folder: str) -> DataFrame:
    """Line r (odd) of an order against line r + 1: the dearer one wins."""
    return paired(table(spark, folder, "lineitem"), table(spark, folder, "orders"))


#: What is read of a line and of an order.
LINE = ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
ORDER = ("o_orderkey", "o_orderdate")


def written(spark: SparkSession, folder: str, columns: tuple[str, ...]) -> tuple[DataFrame, str]:
    """These columns of the contests, written once, and where: what reads them often does not pair the lines anew.

    Lines and orders are written in buckets of their orders before, in columns,
    which take a fifth of what their rows take in a shuffle.
    """
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch.folder(spark, "contests")
    named = {t: (f"{t}_{uuid.uuid4().hex}", scratch.folder(spark, t)) for t in ("lineitem", "orders")}
    try:
        for (t, (name, at)), kept in zip(named.items(), (LINE, ORDER)):
            table(spark, folder, t).select(*kept).write.bucketBy(n, kept[0]).option("path", at).option("compression", "zstd").saveAsTable(name)
        sinks.parquet(paired(*[spark.table(name) for name, _ in named.values()]).select(*columns), path)
    finally:
        for name, at in named.values():
            spark.sql(f"drop table if exists {name}")
            scratch.delete(spark, at)
    return spark.read.parquet(path), path


def paired(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The contests of these lines on the dates of their orders."""
    lines = lineitem.select(*LINE)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    side = F.struct(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    pairs = lines.select("l_orderkey", F.row_number().over(order).alias("r"), side.alias("a"), F.lead(side).over(order).alias("b")).where("r % 2 = 1 and b is not null")
    dates = orders.groupBy("o_orderkey").agg(F.min(F.to_date("o_orderdate")).alias("event_date"))
    rows = pairs.join(dates, F.col("l_orderkey") == F.col("o_orderkey"))
    month = F.month("event_date")
    slam = F.when(month == 1, "Australian Open").when(month.isin(5, 6), "Roland Garros").when(month == 7, "Wimbledon").when(month.isin(8, 9), "US Open")
    surface = F.when(F.col("a.quantity") <= 3, "Carpet").when(F.col("a.flag") == "A", "Hard").when(F.col("a.flag") == "N", "Clay").otherwise("Grass")
    first_wins = F.col("a.price") >= F.col("b.price")
    rows = rows.withColumns({"w": F.when(first_wins, F.col("a")).otherwise(F.col("b")), "l": F.when(first_wins, F.col("b")).otherwise(F.col("a")), "slam": slam})
    out = F.col("w.discount") == 0
    walkover = out & (F.col("l.discount") == 0)
    retired = (F.col("w.discount") >= 0.0999) | (F.col("l.discount") >= 0.0999)

    def player(s: str, of: str) -> list:
        part = F.col(f"{s}.part")
        entry = F.element_at(F.array(*map(F.lit, ENTRIES)), F.pmod(part, 11).cast("int") + 1)
        return [
            F.col(f"{s}.id").alias(f"{of}_id"),
            F.concat(F.lit("Player "), F.col(f"{s}.id").cast("string")).alias(f"{of}_name"),
            F.when(F.col(f"{s}.tax") != 0, F.pmod(part, 200) + 1).cast("int").alias(f"{of}_rank"),
            F.when(F.pmod(part, 5) == 0, (F.pmod(part, 32) + 1).cast("string")).alias(f"{of}_seed"),
            F.when(F.pmod(part, 11) < 3, entry).alias(f"{of}_entry"),
            (1.0 + 20.0 * F.col(f"{s}.discount")).alias(f"avg_{of[0]}"),
            (1.0 + 50.0 * F.col(f"{s}.tax")).alias(f"book_{of[0]}"),
        ]

    number = F.floor(F.col("r") / 2)
    return rows.select(
        (F.col("l_orderkey") * 32 + number).alias("match_id"),
        F.col("a.status").alias("tour"),
        "event_date",
        F.year("event_date").alias("year"),
        F.concat(F.lit("T"), month.cast("string")).alias("tourney_id"),
        F.coalesce("slam", F.concat(F.lit("Event "), month.cast("string"))).alias("tourney_name"),
        F.when(F.col("slam").isNotNull(), "G").otherwise("A").alias("level"),
        "slam",
        surface.alias("surface"),
        F.when(F.col("slam").isNotNull(), 128).otherwise(32).alias("draw_size"),
        F.when(F.pmod("a.part", F.lit(97)) != 0, F.element_at(F.array(*map(F.lit, ROUNDS)), F.pmod("a.part", F.lit(7)).cast("int") + 1)).alias("round"),
        F.when(F.col("a.quantity") >= 50, 1).when((F.col("a.status") == "F") & F.col("slam").isNotNull(), 5).otherwise(3).alias("best_of"),
        number.cast("int").alias("match_num"),
        walkover.alias("is_walkover"),
        retired.alias("is_retirement"),
        *player("w", "winner"),
        *player("l", "loser"),
        F.concat(F.lit("lines_"), F.col("a.status"), F.lit("_"), F.year("event_date").cast("string")).alias("source_file"),
    )


#: The same table in DuckDB's SQL.
CONTESTS_SQL = """
numbered as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_shipdate, l_extendedprice) as r from lineitem),
dated as (select o_orderkey, min(cast(o_orderdate as date)) as event_date from orders group by o_orderkey),
paired as (
  select a.l_orderkey, a.r, d.event_date, month(d.event_date) as m, a.l_quantity as qty, a.l_returnflag as flag, a.l_linestatus as status, a.l_partkey as apart,
    a.l_extendedprice >= b.l_extendedprice as fw, a.l_suppkey as a_id, b.l_suppkey as b_id, a.l_partkey as a_part, b.l_partkey as b_part,
    a.l_discount as a_disc, b.l_discount as b_disc, a.l_tax as a_tax, b.l_tax as b_tax
  from numbered a join numbered b on a.l_orderkey = b.l_orderkey and b.r = a.r + 1 join dated d on d.o_orderkey = a.l_orderkey where a.r % 2 = 1),
sided as (
  select *, case when fw then a_id else b_id end as w_id, case when fw then b_id else a_id end as l_id, case when fw then a_part else b_part end as w_part,
    case when fw then b_part else a_part end as l_part, case when fw then a_disc else b_disc end as w_disc, case when fw then b_disc else a_disc end as l_disc,
    case when fw then a_tax else b_tax end as w_tax, case when fw then b_tax else a_tax end as l_tax,
    case when m = 1 then 'Australian Open' when m in (5, 6) then 'Roland Garros' when m = 7 then 'Wimbledon' when m in (8, 9) then 'US Open' end as slam
  from paired),
contests as (
  select l_orderkey * 32 + r // 2 as match_id, status as tour, event_date, year(event_date) as year, 'T' || m as tourney_id,
    coalesce(slam, 'Event ' || m) as tourney_name, case when slam is not null then 'G' else 'A' end as level, slam,
    case when qty <= 3 then 'Carpet' when flag = 'A' then 'Hard' when flag = 'N' then 'Clay' else 'Grass' end as surface,
    case when slam is not null then 128 else 32 end as draw_size,
    case when apart % 97 <> 0 then ['R128', 'R64', 'R32', 'R16', 'QF', 'SF', 'F'][(apart % 7 + 1)::int] end as round,
    case when qty >= 50 then 1 when status = 'F' and slam is not null then 5 else 3 end as best_of, (r // 2)::int as match_num,
    w_disc = 0 and l_disc = 0 as is_walkover, w_disc >= 0.0999 or l_disc >= 0.0999 as is_retirement,
    w_id as winner_id, 'Player ' || w_id as winner_name, case when w_tax <> 0 then w_part % 200 + 1 end as winner_rank,
    case when w_part % 5 = 0 then (w_part % 32 + 1)::varchar end as winner_seed, case w_part % 11 when 0 then 'Q' when 1 then 'WC' when 2 then 'LL' end as winner_entry,
    1.0::double + 20.0::double * w_disc as avg_w, 1.0::double + 50.0::double * w_tax as book_w,
    l_id as loser_id, 'Player ' || l_id as loser_name, case when l_tax <> 0 then l_part % 200 + 1 end as loser_rank,
    case when l_part % 5 = 0 then (l_part % 32 + 1)::varchar end as loser_seed, case l_part % 11 when 0 then 'Q' when 1 then 'WC' when 2 then 'LL' end as loser_entry,
    1.0::double + 20.0::double * l_disc as avg_l, 1.0::double + 50.0::double * l_tax as book_l,
    'lines_' || status || '_' || year(event_date) as source_file
  from sided)"""


def tours(spark: SparkSession, folder: str) -> DataFrame:
    """The same contests on two tours, of which one plays best of five: at Slams, and in late rounds elsewhere."""
    c = contests(spark, folder)
    five = (F.col("tour") == "F") & (F.col("slam").isNotNull() | F.coalesce(F.col("round").isin("SF", "F"), F.lit(False)))
    return c.withColumns({"tour": F.when(F.col("tour") == "F", "ATP").otherwise("WTA"), "best_of": F.when(F.col("best_of") == 1, 1).when(five, 5).otherwise(3)})


TOURS_SQL = CONTESTS_SQL + """,
tours as (
  select * replace (case tour when 'F' then 'ATP' else 'WTA' end as tour,
    case when best_of = 1 then 1 when tour = 'F' and (slam is not null or coalesce(round in ('SF', 'F'), false)) then 5 else 3 end as best_of) from contests)"""


def event_contests(spark: SparkSession, folder: str) -> DataFrame:
    """Event 2k against event 2k + 1 of another user: the larger value wins."""
    e = table(spark, folder, "events").select("event_id", F.to_date("ts").alias("event_date"), "user_id", "event_type", "value")
    pair = F.floor(F.col("event_id") / 2)
    even = e.where("event_id % 2 = 0").withColumn("pair", pair)
    odd = e.where("event_id % 2 = 1").select(pair.alias("pair"), F.col("user_id").alias("user_2"), F.col("event_type").alias("surface"), F.col("value").alias("value_2"))
    rows = even.join(odd, "pair").where("user_id <> user_2")
    wins = F.col("value") >= F.col("value_2")
    return rows.select(
        F.col("event_id").alias("match_id"),
        F.when(F.col("event_type").isin("view", "click"), "A").otherwise("B").alias("tour"),
        "event_date",
        "surface",
        F.when(wins, F.col("user_id")).otherwise(F.col("user_2")).alias("winner_id"),
        F.when(wins, F.col("user_2")).otherwise(F.col("user_id")).alias("loser_id"),
    )


EVENTS_SQL = """
event_contests as (
  select a.event_id as match_id, case when a.event_type in ('view', 'click') then 'A' else 'B' end as tour, cast(a.ts as date) as event_date, b.event_type as surface,
    case when a.value >= b.value then a.user_id else b.user_id end as winner_id, case when a.value >= b.value then b.user_id else a.user_id end as loser_id
  from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0 and a.user_id <> b.user_id)"""


def skill(id_, surface=None):
    """A fixed rating of a player, for forecasts that need no history."""
    base = 1300.0 + F.pmod(id_ * 7919, 400).cast("double")
    if surface is None:
        return base
    shift = F.when(surface == "Hard", 1).when(surface == "Clay", 2).otherwise(3)
    return base + F.pmod(id_ * 104729 + shift * 31, 300).cast("double") - 150.0


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """The long prediction table over ``contests``: three models by fixed ratings, with exclusions and prior counts."""
    return forecast(contests(spark, folder))


def forecast(c: DataFrame) -> DataFrame:
    """The three models' predictions of these contests."""
    rows = _seen_from_player_1(c).withColumn("of", F.explode(F.array(*_models()))).withColumns({"model": F.col("of.model"), "p1": F.col("of.p"), "p2": 1.0 - F.col("of.p")}).drop("of")
    rows = rows.withColumn("exclusion", _excluded(F.col("model")))
    return rows.withColumns({"format_conflict": _conflict(), "eligible": F.col("exclusion").isNull(), "edition_id": _edition()})


def predicted(c: DataFrame) -> tuple[DataFrame, list[Column]]:
    """These contests, and the predictions of ``forecast`` as columns of their row."""
    one = lambda x: F.struct(x["model"].alias("model"), x["p"].alias("p1"), (1.0 - x["p"]).alias("p2"), _excluded(x["model"]).alias("exclusion"), _conflict().alias("format_conflict"), F.col("winner_is_player_1").alias("winner_is_player_1"))
    return _seen_from_player_1(c).withColumn("edition_id", _edition()), [one(x) for x in _models()]


def _seen_from_player_1(c: DataFrame) -> DataFrame:
    return c.withColumns({"winner_is_player_1": F.col("winner_id") <= F.col("loser_id"), "id_1": F.least("winner_id", "loser_id"), "id_2": F.greatest("winner_id", "loser_id")})


def _models() -> list[Column]:
    """The models' (model, p) by fixed ratings."""
    overall = [skill(F.col(f"id_{k}")) for k in (1, 2)]
    surface = [skill(F.col(f"id_{k}"), F.col("surface")) for k in (1, 2)]
    blend = [0.75 * a + 0.25 * b for a, b in zip(overall, surface)]
    return [F.struct(F.lit(name).alias("model"), P.elo(*r).alias("p")) for name, r in zip(MODELS, (overall, surface, blend))]


def _excluded(model: Column) -> Column:
    base = F.when(F.col("id_1") == F.col("id_2"), "identical_players").when(F.col("is_walkover"), "walkover").when(F.col("best_of") == 1, "unsupported_format")
    return F.coalesce(base, F.when((model != "overall_elo") & (F.col("surface") == "Carpet"), "unsupported_surface"))


def _conflict() -> Column:
    return F.col("slam").isNotNull() & (F.col("best_of") != F.when(F.col("tour") == "F", 5).otherwise(3))


def _edition() -> Column:
    return F.concat_ws(":", F.col("year").cast("string"), "tourney_id")


FORECASTS_SQL = CONTESTS_SQL + """,
oriented as (
  select *, winner_id <= loser_id as winner_is_player_1, least(winner_id, loser_id) as id_1, greatest(winner_id, loser_id) as id_2,
    case surface when 'Hard' then 1 when 'Clay' then 2 else 3 end as shift
  from contests),
rated as (
  select *, 1300.0::double + (id_1 * 7919) % 400 as o1, 1300.0::double + (id_2 * 7919) % 400 as o2,
    1300.0::double + (id_1 * 7919) % 400 + (id_1 * 104729 + shift * 31) % 300 - 150.0::double as s1,
    1300.0::double + (id_2 * 7919) % 400 + (id_2 * 104729 + shift * 31) % 300 - 150.0::double as s2
  from oriented),
modelled as (
  select *, 'overall_elo' as model, 1.0::double / (1.0::double + pow(10.0::double, (o2 - o1) / 400.0::double)) as p1 from rated
  union all select *, 'surface_elo', 1.0::double / (1.0::double + pow(10.0::double, (s2 - s1) / 400.0::double)) from rated
  union all select *, 'surface_adjusted_elo', 1.0::double / (1.0::double + pow(10.0::double, ((0.75::double * o2 + 0.25::double * s2) - (0.75::double * o1 + 0.25::double * s1)) / 400.0::double)) from rated),
forecasts as (
  select *, 1.0::double - p1 as p2, case when id_1 = id_2 then 'identical_players' when is_walkover then 'walkover' when best_of = 1 then 'unsupported_format'
      when model <> 'overall_elo' and surface = 'Carpet' then 'unsupported_surface' end as exclusion,
    slam is not null and best_of <> case when tour = 'F' then 5 else 3 end as format_conflict,
    (case when id_1 = id_2 then 'x' when is_walkover then 'x' when best_of = 1 then 'x' when model <> 'overall_elo' and surface = 'Carpet' then 'x' end) is null as eligible,
    year || ':' || tourney_id as edition_id
  from modelled)"""
