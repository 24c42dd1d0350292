"""How much history players bring: appearances, strict-prior counts and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMITS = (1, 5, 10, 20)


def appearances(c: DataFrame) -> DataFrame:
    """Two rows per contest, one for each side, from a single scan."""
    keep = ["match_id", "tour", "event_date", "year", "slam", "is_walkover"]
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("player_id"), F.col(f"{s}_rank").alias("rank"), F.col(f"{s}_entry").alias("entry"))
    return c.select(*keep, F.explode(F.array(side("winner"), side("loser"))).alias("p")).select(*keep, "p.*")


def played_by_date(a: DataFrame) -> DataFrame:
    return a.where("player_id is not null and not is_walkover").groupBy("tour", "player_id", "event_date").agg(F.count("*").alias("played"))


def prior_counts(a: DataFrame) -> DataFrame:
    """Contests played strictly before each date on which a player appears."""
    dates = a.where("player_id is not null").select("tour", "player_id", "event_date").distinct()
    daily = dates.join(played_by_date(a), ["tour", "player_id", "event_date"], "left")
    before = Window.partitionBy("tour", "player_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("prior", F.coalesce(F.sum("played").over(before), F.lit(0))).drop("played")


def entry_bucket(entry: Column) -> Column:
    e = F.upper(F.trim(entry))
    return F.when(e.isNull() | (e == ""), "DIRECT_OR_MISSING").when(e.isin("Q", "WC", "LL", "SE", "PR"), e).otherwise(F.concat(F.lit("OTHER:"), e))


def era(year: Column, edges: tuple[int, ...] = (1999, 2009, 2019)) -> Column:
    names = ("1988-1999", "2000-2009", "2010-2019", "2020-2025")
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(year <= edge, name).otherwise(out)
    return out


def entrants(c: DataFrame) -> DataFrame:
    """Appearances at Slams with prior counts and entry buckets; unknown players have none."""
    a = appearances(c)
    joined = a.where("slam is not null").join(prior_counts(a), ["tour", "player_id", "event_date"], "left")
    return joined.withColumns({"prior": F.coalesce("prior", F.lit(0)), "bucket": entry_bucket(F.col("entry")), "unranked": F.col("rank").isNull()})


def match_rollup(e: DataFrame) -> DataFrame:
    """One row per contest: least and most prior contests, and whether a side is unranked."""
    return e.groupBy("match_id", "tour", "slam", "year").agg(F.min("prior").alias("min_prior"), F.max("prior").alias("max_prior"), F.bool_or("unranked").alias("any_unranked"))


def _thresholds(column: str) -> list[Column]:
    n = F.count("*")
    out = [n.alias("n")]
    for limit in LIMITS:
        under = F.count_if(F.col(column) < limit)
        out += [under.alias(f"under_{limit}"), F.round(100.0 * under / n, 6).alias(f"pct_{limit}")]
    return out


def match_thresholds(rollup: DataFrame) -> DataFrame:
    """Contests under each threshold: overall, by tour, by tour, Slam and era, and by year; one pass over grouping sets."""
    rows = rollup.withColumn("era", era(F.col("year")))
    sets = [[], ["tour"], ["tour", "slam", "era"], ["tour", "slam", "year"]]
    cols = ["tour", "slam", "era", "year"]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.grouping_id().cast("int").alias("gid"), *_thresholds("min_prior"))


def entrant_thresholds(e: DataFrame) -> DataFrame:
    return e.withColumn("era", era(F.col("year"))).groupBy("tour", "slam", "era", "bucket", "unranked").agg(*_thresholds("prior"))
