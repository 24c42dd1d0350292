"""Sensitivity scenarios as data: each row is tagged with the scenarios it is in, and one aggregate serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import elo
from .coldstart import era
from .metrics import BASE, SUMS, metrics, row_sums
from .observations import EXTREME

EARLY, LATE = ("R128", "R64", "R32"), ("R16", "QF", "SF", "F")


PRIMARY, INCLUSIVE = "completed_non_retirement", "retirement_inclusive"
ERAS = ("1988-1999", "2000-2009", "2010-2019", "2020-2025")
REGIMES = ("no_seeds", "16_seeds", "32_seeds")
MIN_PRIOR = (1, 5, 20)
#: What conditions read beside population, tour, Slam and model; of min_prior only which of MIN_PRIOR it reaches.
TOLD = ("year", "round", "regime", "min_prior", "flagged", "both_surface", "common", "extreme", "latest", "latest_common", "top10")


def tags() -> dict[str, Column]:
    """Scenario name to the condition of its rows.

    ``maximum`` scenarios hold what each model can score, ``common`` ones the
    contests that all models can.  All but one are of the primary population.
    """
    c = F.col
    primary = c("population") == PRIMARY
    common = primary & c("common")
    wimbledon_2022 = (c("slam") == "Wimbledon") & (c("year") == 2022)
    return {
        "maximum_available_primary": primary,
        "common_primary": common,
        "common_retirement_inclusive": (c("population") == INCLUSIVE) & c("common"),
        "common_exclude_flagged_overround": common & ~c("flagged"),
        **{f"common_min_prior_{n}": common & (c("min_prior") >= n) for n in MIN_PRIOR},
        "common_both_players_surface_history": common & c("both_surface"),
        "common_exclude_2020_2022": common & ~c("year").between(2020, 2022),
        "common_exclude_wimbledon_2022": common & ~wimbledon_2022,
        "common_early_rounds": common & c("round").isin(*EARLY),
        "common_late_rounds": common & c("round").isin(*LATE),
        **{f"{name}_seed_field_regime_{r}": of & (c("regime") == r) for name, of in (("maximum", primary), ("common", common)) for r in REGIMES},
        **{f"{name}_era_{e}": of & (era(c("year")) == e) for name, of in (("maximum", primary), ("common", common)) for e in ERAS},
        "maximum_latest_five_editions": primary & c("latest"),
        "common_latest_five_editions": common & c("latest_common"),
        "common_latest_five_exclude_wimbledon_2022": common & c("latest_common") & ~wimbledon_2022,
        "common_exclude_extreme_favorites": common & ~c("extreme"),
        "common_remove_top10_positive_residuals": common & ~c("top10"),
    }


def with_flags(observed: DataFrame, models: int = 3) -> DataFrame:
    """Adds what the conditions look at.

    common: all models score the contest; extreme: a side is below 0.05 by any
    of them (both are kept where they are there already); top10 positive residuals of the common panel; latest editions of
    each sample.  Contexts (min_prior, flagged, both_surface, regime) come with
    the rows.
    """
    rows = observed
    if not {"common", "extreme"} <= set(rows.columns):
        by_match = Window.partitionBy("population", "match_id")
        scored = F.col("score_eligible").cast("int")
        rows = rows.withColumns({"common": F.sum(scored).over(by_match) == models, "extreme": F.coalesce(F.min("p_under").over(by_match) < EXTREME, F.lit(False))})
    residual = F.when(F.col("upset_eligible") & F.col("common"), F.col("upset") - F.col("p_under"))
    rows = rows.withColumn("residual", F.when(residual > 0, residual))
    base = ["population", "tour", "slam", "model"]
    # a group is a large share of all rows: only its ten greatest residuals and its editions are put in order
    place = F.row_number().over(Window.partitionBy(*base).orderBy(F.col("residual").desc(), F.col("match_id").desc()))
    top = rows.where("residual is not null").select(*base, "match_id", "residual").withColumn("__place", place).where("__place <= 10")
    rows = _marked(rows, top.select(*base, "match_id").distinct(), [*base, "match_id"], "__top")
    rows = rows.withColumn("top10", F.col("residual").isNotNull() & F.col("__top")).drop("__top")
    newest = Window.partitionBy(*base).orderBy(F.col("year").desc(), F.col("edition_id").desc())
    editions = rows.groupBy(*base, "year", "edition_id").agg(F.max(F.coalesce("score_eligible", F.lit(False))).alias("__scored"), F.max(F.coalesce("common", F.lit(False))).alias("__common"))
    for name, flag, of in (("latest", "score_eligible", "__scored"), ("latest_common", "common", "__common")):
        five = editions.where(of).withColumn("__place", F.dense_rank().over(newest)).where("__place <= 5").select(*base, "year", "edition_id")
        rows = _marked(rows, five, [*base, "year", "edition_id"], "__five").withColumn(name, F.col("__five") & F.col(flag)).drop("__five")
    return rows


def _marked(rows: DataFrame, few: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """The rows with whether their keys, nulls included, are among a few."""
    other = few.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias(mark))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(F.broadcast(other), same, "left").drop(*[f"__{k}" for k in keys]).withColumn(mark, F.coalesce(mark, F.lit(False)))


def surface_history(contests: DataFrame) -> DataFrame:
    """(match_id, both_surface): whether both sides played on this surface before the day."""
    keys = ["tour", "player_id", "surface"]
    sides = [contests.where("not is_walkover").select("tour", F.col(f"{w}_id").alias("player_id"), "surface", "event_date") for w in ("winner", "loser")]
    first = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.min("event_date").alias("since"))
    rows = contests.select("match_id", "tour", "surface", "event_date", "winner_id", "loser_id")
    for w in ("winner", "loser"):
        rows = rows.withColumn("player_id", F.col(f"{w}_id")).join(first.withColumnRenamed("since", f"{w}_since"), keys, "left").drop("player_id")
    return rows.select("match_id", F.coalesce((F.col("winner_since") < F.col("event_date")) & (F.col("loser_since") < F.col("event_date")), F.lit(False)).alias("both_surface"))


def histories(contests: DataFrame) -> DataFrame:
    """(match_id, min_prior, both_surface) of Slam contests: the fewer of both sides' contests before the day, and whether both had played on the surface.

    The same as ``coldstart.match_rollup`` and ``surface_history``, from one
    shuffle of the sides to their players.  A side that is unknown, or on no
    tour, has no history.
    """
    slam, day = F.col("slam").isNotNull(), F.unix_date("event_date")
    played = ~F.coalesce("is_walkover", F.lit(True)) & day.isNotNull()
    rows = contests.select("tour", "surface", F.when(slam, F.col("match_id")).alias("match_id"), day.alias("day"), played.alias("played"), F.explode(F.array("winner_id", "loser_id")).alias("player_id"))
    rows = rows.where("player_id is not null and tour is not null and (played or match_id is not null)")
    own = Window.partitionBy("tour", "player_id")
    before = own.orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.when(F.col("day").isNotNull(), F.count(F.when(F.col("played"), 1)).over(before)).otherwise(0))
    rows = rows.withColumn("since", F.min(F.when(F.col("played"), F.col("day"))).over(Window.partitionBy("tour", "player_id", "surface")))
    had = F.coalesce((F.col("since") < F.col("day")) & F.col("surface").isNotNull(), F.lit(False))
    both = F.count("*") >= 2
    return rows.where("match_id is not null").groupBy("match_id").agg(F.when(both, F.min("prior")).otherwise(0).alias("min_prior"), (both & F.bool_and(had)).alias("both_surface"))


def scenario_summaries(flagged: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Metrics of every scenario, population, tour, Slam and model from one pass.

    Conditions read the columns of TOLD, so rows that are equal in these are
    summed before any condition is looked at and before they are dealt out to
    scenarios: a row is in a dozen, but such groups are few at any size.
    """
    at = F.col("min_prior")
    step = F.when(at.isNotNull(), F.coalesce(*[F.when(at >= n, F.lit(n)) for n in sorted(MIN_PRIOR, reverse=True)], F.lit(0)))
    rows = flagged.where("score_eligible").withColumn("min_prior", step)
    cells = rows.groupBy(*BASE, "edition_id", *TOLD).agg(*row_sums())
    names = F.array_compact(F.array(*[F.when(cond, name) for name, cond in conditions.items()]))
    keys = ("scenario", *BASE)
    sums = cells.withColumn("scenario", F.explode(names)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], F.count_distinct("edition_id").cast("bigint").alias("editions"))
    return sums.select(*keys, "editions", *metrics())


def deltas(summaries: DataFrame, reference: str = "common_primary") -> DataFrame:
    """Every scenario less the reference scenario of the same cell."""
    keys = ["population", "tour", "slam", "model"]
    ref = summaries.where(F.col("scenario") == reference).select(*keys, F.col("excess_per_100").alias("reference"))
    return summaries.join(ref, keys).withColumn("delta", F.round(F.col("excess_per_100") - F.col("reference"), 6)).select("scenario", *keys, "excess_per_100", "reference", "delta")


def seed_regimes(contests: DataFrame) -> DataFrame:
    """Per edition the largest seed and the regime it means."""
    number = lambda c: F.regexp_extract(F.col(c), "[0-9]+", 0).try_cast("int")
    rows = contests.where("slam is not null").groupBy("tour", "slam", "year", "tourney_id").agg(F.max(F.greatest(F.coalesce(number("winner_seed"), F.lit(0)), F.coalesce(number("loser_seed"), F.lit(0)))).alias("max_seed"))
    return rows.withColumn("regime", F.when(F.col("max_seed") > 16, "32_seeds").when(F.col("max_seed") > 0, "16_seeds").otherwise("no_seeds"))


def surface_blends(rows: DataFrame, weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Recombined probabilities at each weight from frozen ratings; no replay."""
    out = rows.withColumn("blend_weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    mix = lambda k: (1.0 - F.col("blend_weight")) * F.col(f"overall_{k}") + F.col("blend_weight") * F.col(f"surface_{k}")
    return out.withColumn("p", elo(mix("w"), mix("l")))


def rank_seed_descriptive(contests: DataFrame) -> DataFrame:
    """How often the better ranked and the better seeded side loses, over all rounds, by era and by round."""
    number = lambda c: F.regexp_extract(F.col(c), "[0-9]+", 0).try_cast("int")
    rows = contests.where("slam is not null and not is_walkover").withColumns({"ws": number("winner_seed"), "ls": number("loser_seed"), "era": era(F.col("year"))})
    dims = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), F.struct(F.lit("era").alias("dimension"), (F.col("era")).alias("value")), F.struct(F.lit("round").alias("dimension"), F.coalesce("round", F.lit("missing")).alias("value")))
    rows = rows.withColumn("d", F.explode(dims))
    ranked = F.col("winner_rank").isNotNull() & F.col("loser_rank").isNotNull()
    seeded = F.col("ws").isNotNull() | F.col("ls").isNotNull()
    return rows.groupBy("tour", "slam", F.col("d.dimension").alias("dimension"), F.col("d.value").alias("value")).agg(
        F.count("*").alias("matches"), F.count_if(ranked).alias("ranked"), F.count_if(ranked & (F.col("winner_rank") > F.col("loser_rank"))).alias("rank_upsets"),
        F.count_if(ranked & (F.col("winner_rank") == F.col("loser_rank"))).alias("rank_ties"), F.count_if(seeded).alias("seeded"),
        F.count_if(F.col("ls").isNotNull() & F.col("ws").isNull()).alias("unseeded_beats_seeded"), F.count_if(~F.col("winner_entry").eqNullSafe(F.col("loser_entry"))).alias("entries_differ"))


def upsets_by_regime(contests: DataFrame) -> DataFrame:
    """How often the better ranked and the seeded side lose under each regime of seeds."""
    rows = contests.where("slam is not null and not is_walkover").join(seed_regimes(contests).select("tour", "slam", "year", "tourney_id", "regime"), ["tour", "slam", "year", "tourney_id"])
    return rows.groupBy("tour", "slam", "regime").agg(
        F.count("*").alias("matches"), F.count_if(F.coalesce(F.col("winner_rank") > F.col("loser_rank"), F.lit(False))).alias("rank_upsets"),
        F.count_if(F.col("loser_seed").isNotNull() & F.col("winner_seed").isNull()).alias("unseeded_beats_seeded"))
