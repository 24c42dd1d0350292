"""Predictions as observations: populations, orientation to the less likely side, exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import clamp, log_loss
from ..schemas import POPULATIONS

TOLERANCE = 1e-12
#: What an observation adds to its contest.
OBSERVED = ("model", "p1", "p2", "exclusion", "format_conflict", "winner_is_player_1", "population", "common", "extreme", "population_exclusion", "orientation_reason", "score_eligible", "upset_eligible", "p_under", "p_favorite", "upset", "brier", "log_loss")
#: A side below is an extreme underdog (fixed value).
EXTREME = 0.05


def orientation(p1: Column | None = None, p2: Column | None = None, won: Column | None = None) -> Column:
    """Who is the underdog, as a struct; ``reason`` says why a row has none.

    Proper scores need valid probabilities and an outcome only; an exact tie
    keeps them but has no underdog.
    """
    p1, p2, won = (F.col(c) if x is None else x for x, c in ((p1, "p1"), (p2, "p2"), (won, "winner_is_player_1")))
    bad = lambda p: F.isnan(p) | (p < 0) | (p > 1)
    invalid = F.coalesce(bad(p1) | bad(p2), F.lit(False))
    score_reason = F.coalesce(
        F.when(p1.isNull() | p2.isNull(), "missing_probability"),
        F.when(invalid, "invalid_probability"),
        F.when(F.abs(p1 + p2 - 1.0) > TOLERANCE, "probabilities_do_not_sum_to_one"),
        F.when(won.isNull(), "missing_outcome"),
    )
    reason = F.coalesce(score_reason, F.when(p1 == p2, "exact_probability_tie"))
    under = reason.isNull()
    return F.struct(
        reason.alias("reason"),
        score_reason.isNull().alias("scored"),
        under.alias("oriented"),
        F.when(under, F.least(p1, p2)).alias("p_under"),
        F.when(under, F.greatest(p1, p2)).alias("p_favorite"),
        F.when(under, ((p1 < p2) == won).cast("int")).alias("upset"),
    )


def primary_exclusions(exclusion: Column | None = None, conflict: Column | None = None) -> Column:
    """Sorted distinct reasons that keep a prediction out of the primary population."""
    exclusion, conflict = (F.col(c) if x is None else x for x, c in ((exclusion, "exclusion"), (conflict, "format_conflict")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.when(F.coalesce(exclusion, F.lit("")) != "", F.split(exclusion, ";")).otherwise(F.array().cast("array<string>")),
        F.array(F.when(F.col("is_retirement"), "retirement"), F.when(F.col("is_walkover"), "walkover"), F.when(conflict, "format_conflict")),
    ))))


def _left(exclusions: Column) -> Column:
    """The exclusions that the row's population does not forgive."""
    return F.when(F.col("population") == POPULATIONS[1], F.array_remove(exclusions, "retirement")).otherwise(exclusions)


def _statistics(o: Column, exclusions: Column, p1: Column, won: Column) -> list[Column]:
    """The additive statistics of a prediction in the row's population, from its orientation and exclusions."""
    out = F.nullif(F.array_join(_left(exclusions), ";"), F.lit(""))
    score, upset, won = out.isNull() & o["scored"], out.isNull() & o["oriented"], won.cast("int")
    return [
        out.alias("population_exclusion"), o["reason"].alias("orientation_reason"),
        score.alias("score_eligible"), upset.alias("upset_eligible"),
        F.when(upset, o["p_under"]).alias("p_under"), F.when(upset, o["p_favorite"]).alias("p_favorite"), F.when(upset, o["upset"]).alias("upset"),
        F.when(score, (p1 - won) * (p1 - won)).alias("brier"), F.when(score, log_loss(clamp(p1), won)).alias("log_loss"),
    ]


def observations(predictions: DataFrame) -> DataFrame:
    """One row per population and prediction, with the additive statistics of a row.

    The second population forgives retirements and nothing else.
    """
    rows = predictions.withColumns({"exclusions": primary_exclusions(), "o": orientation()})
    rows = rows.withColumn("population", F.explode(F.array(*map(F.lit, POPULATIONS))))
    return rows.select(*[c for c in predictions.columns], "population", *_statistics(F.col("o"), F.col("exclusions"), F.col("p1"), F.col("winner_is_player_1")))


def panels(contests: DataFrame, predictions: list[Column]) -> DataFrame:
    """The observations of contests whose predictions are columns of their row, with what all of them together say of a contest.

    predictions: structs (model, p1, p2, exclusion, format_conflict,
    winner_is_player_1).  common: all can be scored; extreme: one of them sees
    a side below 0.05.  Nothing is shuffled.
    """
    own = ("model", "p1", "p2", "exclusion", "format_conflict", "winner_is_player_1")
    kept = [F.col(c) for c in contests.columns if c not in own]
    rows = contests.select("*", *[x[c].alias(f"__{c}_{k}") for k, x in enumerate(predictions) for c in own])  # columns: what is read often is made once
    value = lambda c, k: F.col(f"__{c}_{k}")
    made = range(len(predictions))
    rows = rows.withColumns({f"__o_{k}": orientation(*[value(c, k) for c in ("p1", "p2", "winner_is_player_1")]) for k in made} | {f"__exclusions_{k}": primary_exclusions(value("exclusion", k), value("format_conflict", k)) for k in made})
    of = [F.struct(*[value(c, k).alias(c) for c in (*own, "exclusions", "o")]) for k in made]
    rows = rows.select(*kept, F.array(*of).alias("__of")).withColumn("population", F.explode(F.array(*map(F.lit, POPULATIONS))))
    each = [F.col("__of")[k] for k in made]
    here = [F.size(_left(x["exclusions"])) == 0 for x in each]
    under = [F.when(h & x["o"]["oriented"], x["o"]["p_under"]) for h, x in zip(here, each)]
    rows = rows.withColumns({
        "common": reduce(Column.__and__, [h & x["o"]["scored"] for h, x in zip(here, each)]),
        "extreme": F.coalesce(F.array_min(F.array(*under)) < EXTREME, F.lit(False)),
    }).withColumn("__one", F.explode("__of"))
    one = F.col("__one")
    return rows.select(*kept, *[one[c].alias(c) for c in own], "population", "common", "extreme", *_statistics(one["o"], one["exclusions"], one["p1"], one["winner_is_player_1"]))


def exclusion_counts(observed: DataFrame) -> DataFrame:
    """Rows left out, by population, tour, Slam, model and reason."""
    reason = F.coalesce("population_exclusion", F.when(~F.col("upset_eligible"), F.col("orientation_reason")))
    return observed.withColumn("reason", reason).where("reason is not null").groupBy("population", "tour", "slam", "model", "reason").agg(F.count("*").alias("n"))


def odds_universe(predictions: DataFrame, years: tuple[int, int], since: dict[str, int], model: str = "overall_elo") -> DataFrame:
    """Slam contests that prices can be linked to, each tour from its first priced year on, with their place in order."""
    own = F.lit(False)
    for tour, year in since.items():
        own = own | ((F.col("tour") == tour) & (F.col("year") >= year))
    place = F.row_number().over(Window.partitionBy("tour").orderBy("year", "slam", F.col("round").asc_nulls_first(), "match_id"))
    rows = predictions.where((F.col("model") == model) & F.col("slam").isNotNull() & F.col("year").between(*years) & own)
    return rows.select("match_id", "tour", "year", "slam", "round", place.cast("bigint").alias("place"))


def in_scope(predictions: DataFrame, years: tuple[int, int], tours: tuple[str, ...], models: tuple[str, ...]) -> DataFrame:
    """Slam predictions of these years, tours and models; all conditions reach the scan."""
    return predictions.where(F.col("slam").isNotNull() & F.col("year").between(*years) & F.col("tour").isin(*tours) & F.col("model").isin(*models))


def prefixed(version: str, samples: dict[str, DataFrame]) -> DataFrame:
    """The samples one after the other, each row under its version and sample."""
    out = None
    for name, rows in samples.items():
        named = rows.withColumns({"version": F.lit(version), "sample": F.lit(name)})
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def of_winner(one: str, two: str) -> Column:
    """The value of the side that won, from those of player 1 and 2."""
    return F.when(F.col("winner_is_player_1"), F.col(one)).otherwise(F.col(two))
