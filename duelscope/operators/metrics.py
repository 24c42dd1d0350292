"""Additive statistics and what is read off them.

``cube`` sums the statistics of rows once per edition, round and model; every
metric, rolling window, contrast and resample reads those few rows.  Three
denominators stay apart: scored, with an underdog, and calibrated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coldstart import era

SUMS = ("score_n", "brier_sum", "log_loss_sum", "upset_n", "expected", "actual", "variance")
BASE = ("population", "tour", "slam", "model")
CELL = (*BASE, "edition_id", "year", "round")


def row_sums() -> list[Column]:
    p = F.col("p_under")
    return [
        F.sum(F.col("score_eligible").cast("bigint")).alias("score_n"),
        F.sum("brier").alias("brier_sum"),
        F.sum("log_loss").alias("log_loss_sum"),
        F.sum(F.col("upset_eligible").cast("bigint")).alias("upset_n"),
        F.sum(p).alias("expected"),
        F.sum(F.col("upset").cast("bigint")).alias("actual"),
        F.sum(p * (1.0 - p)).alias("variance"),
    ]


def cube(observed: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    return observed.where("score_eligible").groupBy(*keys).agg(*row_sums())


def metrics() -> list[Column]:
    """The metrics of a row of sums; null where their denominator is zero."""
    n, excess = F.col("upset_n"), F.col("actual") - F.col("expected")
    per = lambda x: F.round(F.try_divide(100.0 * x, n), 6)
    return [
        F.col("score_n").cast("bigint").alias("score_matches"),
        n.cast("bigint").alias("upset_matches"),
        F.round(F.coalesce("expected", F.lit(0.0)), 6).alias("expected_upsets"),
        F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual_upsets"),
        per(F.col("expected")).alias("expected_per_100"),
        per(F.col("actual")).alias("actual_per_100"),
        per(excess).alias("excess_per_100"),
        F.round(F.when(F.col("variance") > 0, excess / F.sqrt(F.when(F.col("variance") > 0, F.col("variance")))), 6).alias("standardized_excess"),
        F.round(F.try_divide(F.col("brier_sum"), F.col("score_n")), 6).alias("brier_score"),
        F.round(F.try_divide(F.col("log_loss_sum"), F.col("score_n")), 6).alias("log_loss_score"),
    ]


def total(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return cells.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS], F.count_distinct(F.when(F.col("upset_n") > 0, F.col("edition_id"))).cast("bigint").alias("editions"))


def summaries(cells: DataFrame, keys: tuple[str, ...] = BASE) -> DataFrame:
    return total(cells, keys).select(*keys, "editions", *metrics())


def dimensions(cells: DataFrame) -> DataFrame:
    """Metrics of all rows and by round, era and year, in one aggregate over grouping sets."""
    rows = cells.withColumns({"round": F.coalesce("round", F.lit("missing")), "era": era(F.col("year")), "year": F.col("year").cast("string")})
    base = [F.col(c) for c in BASE]
    dims = ("round", "era", "year")
    sets = [base, *[[*base, F.col(d)] for d in dims]]
    out = rows.groupingSets(sets, *base, *[F.col(d) for d in dims]).agg(*[F.sum(s).alias(s) for s in SUMS], F.count_distinct("edition_id").cast("bigint").alias("editions"))
    which = F.coalesce(*[F.when(F.col(d).isNotNull(), d) for d in dims], F.lit("all"))
    return out.select(*BASE, which.alias("dimension"), F.coalesce(*dims, F.lit("all")).alias("value"), "editions", *metrics())


def calibration(observed: DataFrame) -> DataFrame:
    """Favourites by probability in five bins of [0.5, 1], the last one closed."""
    p = F.col("p_favorite")
    bin_ = F.when(p >= 0.9, 4).when(p >= 0.8, 3).when(p >= 0.7, 2).when(p >= 0.6, 1).otherwise(0)
    rows = observed.where("upset_eligible").withColumn("bin", bin_)
    return rows.groupBy(*BASE, "bin").agg(F.count("*").alias("n"), F.round(F.avg("p_favorite"), 6).alias("mean_probability"), F.round(F.avg(1.0 - F.col("upset")), 6).alias("won"))


def deciles(predictions: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    rows = predictions.where("eligible and p1 is not null").withColumn("decile", F.least(F.lit(9), F.floor(F.col("p1") * 10).cast("int")))
    return rows.groupBy(*keys, "decile").agg(F.count("*").alias("n"), F.round(F.avg("p1"), 6).alias("mean_p"), F.round(F.avg(F.col("winner_is_player_1").cast("double")), 6).alias("observed"))


def rolling(cells: DataFrame, size: int = 5) -> DataFrame:
    """Metrics over every run of ``size`` consecutive editions of a cell."""
    editions = cells.groupBy(*BASE, "year", "edition_id").agg(*[F.sum(s).alias(s) for s in SUMS])
    run = Window.partitionBy(*BASE).orderBy("year", "edition_id").rowsBetween(-(size - 1), 0)
    held = editions.select(*BASE, *[F.sum(s).over(run).alias(s) for s in SUMS], F.count("*").over(run).alias("in_run"), F.first("edition_id").over(run).alias("first_edition"), F.last("edition_id").over(run).alias("last_edition"))
    return held.where(F.col("in_run") == size).select(*BASE, "first_edition", "last_edition", *metrics())


def latest_editions(cells: DataFrame, size: int = 5) -> DataFrame:
    """The cells of the latest editions per tour, Slam and model."""
    place = F.dense_rank().over(Window.partitionBy("tour", "slam", "model").orderBy(F.col("year").desc(), F.col("edition_id").desc()))
    return cells.withColumn("place", place).where(F.col("place") <= size).drop("place")


def contrasts(cells: DataFrame, one: str = "Wimbledon") -> DataFrame:
    """One Slam minus the mean of the three others, per metric; null unless all four have it."""
    rows = summaries(cells)
    out = []
    for m in ("expected_per_100", "actual_per_100", "excess_per_100"):
        own, other = F.max(F.when(F.col("slam") == one, F.col(m))), F.when(F.col("slam") != one, F.col(m))
        out.append(F.round(F.when(F.count(other) == 3, own - F.avg(other)), 6).alias(m))
    return rows.where("slam is not null").groupBy("population", "tour", "model").agg(*out)


def influence(cells: DataFrame) -> DataFrame:
    """Per cell the edition whose absence moves the excess per 100 most, by totals less that edition."""
    editions = cells.groupBy(*BASE, "edition_id").agg(*[F.sum(s).alias(s) for s in ("upset_n", "expected", "actual")])
    whole = Window.partitionBy(*BASE)
    rate = lambda n, a, e: F.try_divide(100.0 * (a - e), n)
    rows = editions.withColumns({f"t_{c}": F.sum(c).over(whole) for c in ("upset_n", "expected", "actual")})
    full = rate(F.col("t_upset_n"), F.col("t_actual"), F.col("t_expected"))
    without = rate(F.col("t_upset_n") - F.col("upset_n"), F.col("t_actual") - F.col("actual"), F.col("t_expected") - F.col("expected"))
    rows = rows.withColumn("delta", F.round(without - full, 6)).where("delta is not null")
    return rows.groupBy(*BASE).agg(F.max_by("edition_id", F.struct(F.abs("delta"), "delta", "edition_id")).alias("edition_id"), F.max_by("delta", F.struct(F.abs("delta"), "delta", "edition_id")).alias("delta"))


def largest_residuals(observed: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """How much of a cell's positive residual its largest rows hold."""
    rows = observed.where("upset_eligible").withColumn("residual", F.col("upset") - F.col("p_under")).where("residual > 0")
    place = F.row_number().over(Window.partitionBy(*BASE).orderBy(F.col("residual").desc(), F.col("match_id").desc()))
    rows = rows.withColumn("place", place)
    return rows.groupBy(*BASE).agg(F.round(F.sum("residual"), 6).alias("positive"), *[F.round(F.sum(F.when(F.col("place") <= k, F.col("residual"))), 6).alias(f"top_{k}") for k in ks])


def diagnostics(predictions: DataFrame) -> DataFrame:
    """Scores by model overall and by surface, format, era and experience, in one aggregate over exploded dimensions."""
    rows = predictions.where("eligible and p1 is not null")
    dims = F.array(
        F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("surface").alias("dimension"), (F.coalesce("surface", F.lit("missing"))).alias("value")),
        F.struct(F.lit("format").alias("dimension"), (F.coalesce(F.col("best_of").cast("string"), F.lit("missing"))).alias("value")),
        F.struct(F.lit("year").alias("dimension"), (F.col("year").cast("string")).alias("value")),
        F.struct(F.lit("round").alias("dimension"), (F.coalesce("round", F.lit("missing"))).alias("value")),
    )
    won = F.col("winner_is_player_1").cast("int")
    p = F.greatest(F.lit(1e-12), F.when(F.col("winner_is_player_1"), F.col("p1")).otherwise(1.0 - F.col("p1")))
    rows = rows.withColumns({"d": F.explode(dims), "b": F.pow(F.col("p1") - won, 2), "l": -F.log(p), "a": ((F.col("p1") > 0.5) == F.col("winner_is_player_1")).cast("double")})
    return rows.groupBy("model", "tour", F.col("d.dimension").alias("dimension"), F.col("d.value").alias("value")).agg(F.count("*").alias("n"), F.round(F.avg("b"), 6).alias("brier"), F.round(F.avg("l"), 6).alias("log_loss"), F.round(F.avg("a"), 6).alias("accuracy"))


def paired_differences(observed: DataFrame, a: str, b: str) -> DataFrame:
    """Sums of the differences of two models on the contests that both have, by edition."""
    side = lambda m, s: observed.where((F.col("model") == m) & F.col("score_eligible")).select("population", "tour", "slam", "match_id", *([F.col("edition_id")] if s == "a" else []), *[F.col(c).alias(f"{c}_{s}") for c in ("brier", "log_loss", "p_under", "upset")])
    rows = side(a, "a").join(side(b, "b"), ["population", "tour", "slam", "match_id"])
    both = F.col("upset_a").isNotNull() & F.col("upset_b").isNotNull()
    excess = F.when(both, (F.col("upset_a") - F.col("p_under_a")) - (F.col("upset_b") - F.col("p_under_b")))
    return rows.groupBy("population", "tour", "slam", "edition_id").agg(F.count("*").alias("n"), F.count(excess).alias("oriented"), F.sum(F.col("brier_a") - F.col("brier_b")).alias("brier"), F.sum(F.col("log_loss_a") - F.col("log_loss_b")).alias("log_loss"), F.sum(excess).alias("excess"))


def identity_changes(observed: DataFrame, a: str, b: str) -> DataFrame:
    """Contests whose underdog two models see differently: flipped, or a tie made or resolved."""
    side = lambda m, s: observed.where((F.col("model") == m) & F.col("score_eligible")).select("population", "tour", "slam", "match_id", F.when(F.col("p1") == F.col("p2"), 0).when(F.col("p1") < F.col("p2"), 1).otherwise(2).alias(s))
    rows = side(a, "x").join(side(b, "y"), ["population", "tour", "slam", "match_id"]).where("x <> y")
    change = F.when(F.col("x") == 0, "tie_removed").when(F.col("y") == 0, "tie_created").otherwise("flip")
    return rows.withColumn("change", change).groupBy("population", "tour", "slam", "change").agg(F.count("*").alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """Per cell which model scores best and in how many the excess is positive; ties go to the smaller name."""
    rows = summaries(cells)
    return rows.groupBy("population", "tour", "slam").agg(F.min_by("model", F.struct("brier_score", "model")).alias("best_brier"), F.min_by("model", F.struct("log_loss_score", "model")).alias("best_log_loss"), F.count_if(F.col("excess_per_100") > 0).alias("positive"), F.count_if(F.col("excess_per_100") < 0).alias("negative"))


def identity_change_grid(observed: DataFrame, a: str, b: str) -> DataFrame:
    """The changes of ``identity_changes`` on a full grid of populations, tours, Slams and kinds, with zero cells."""
    kinds = F.explode(F.array(*map(F.lit, ("flip", "tie_created", "tie_removed"))))
    grid = observed.where("score_eligible and slam is not null").select("population", "tour", "slam").distinct().withColumn("change", kinds)
    found = identity_changes(observed, a, b)
    return grid.join(found, ["population", "tour", "slam", "change"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_metadata(observed: DataFrame, metadata: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds columns of the rating models' rows; the market model borrows those of overall ratings."""
    lookup = metadata.select("match_id", F.col("model").alias("lookup_model"), *columns)
    rows = observed.withColumn("lookup_model", F.when(F.col("model") == "market_odds", "overall_elo").otherwise(F.col("model")))
    return rows.join(lookup, ["match_id", "lookup_model"], "left").drop("lookup_model")


#: Sums of a paired comparison, per edition.
PAIR_SUMS = ("score_n", "pair_n", "brier", "log_loss", "expected", "actual", "primary_ties", "variant_ties", "ties_created", "ties_removed")


def paired_sums(variant: DataFrame, primary: DataFrame) -> DataFrame:
    """Per model, tour, Slam and edition: variant less primary on the same contests.

    Scores count all contests, upset rates those that neither side calls a tie.
    """
    keep = ["match_id", "brier", "log_loss", "upset_eligible", "p_under", "upset"]
    b = primary.select(*[F.col(c).alias(c if c == "match_id" else f"b_{c}") for c in keep])
    rows = variant.select("model", "tour", "slam", "edition_id", *keep).join(b, "match_id")
    both = F.col("upset_eligible") & F.col("b_upset_eligible")
    less = lambda c: F.col(c) - F.col(f"b_{c}")
    count = lambda cond: F.count_if(cond).cast("bigint")
    return rows.groupBy("model", "tour", "slam", "edition_id").agg(
        F.count("*").alias("score_n"), count(both).alias("pair_n"), F.sum(less("brier")).alias("brier"), F.sum(less("log_loss")).alias("log_loss"),
        F.coalesce(F.sum(F.when(both, less("p_under"))), F.lit(0.0)).alias("expected"), F.coalesce(F.sum(F.when(both, less("upset"))), F.lit(0)).cast("double").alias("actual"),
        count(~F.col("b_upset_eligible")).alias("primary_ties"), count(~F.col("upset_eligible")).alias("variant_ties"),
        count(F.col("b_upset_eligible") & ~F.col("upset_eligible")).alias("ties_created"), count(~F.col("b_upset_eligible") & F.col("upset_eligible")).alias("ties_removed"))


def paired_points(sums: DataFrame) -> DataFrame:
    """The five differences of every model, tour and Slam, with the counts that they rest on."""
    total = sums.groupBy("model", "tour", "slam").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS], F.count("*").alias("editions"))
    per = lambda x, n, scale: F.round(F.try_divide(scale * x, F.col(n).cast("double")), 6)
    return total.select(
        "model", "tour", "slam", "editions", "score_n", "pair_n", "primary_ties", "variant_ties", "ties_created", "ties_removed",
        per(F.col("expected"), "pair_n", 100.0).alias("expected_per_100"), per(F.col("actual"), "pair_n", 100.0).alias("actual_per_100"),
        per(F.col("actual") - F.col("expected"), "pair_n", 100.0).alias("excess_per_100"), per(F.col("brier"), "score_n", 1.0).alias("brier_score"), per(F.col("log_loss"), "score_n", 1.0).alias("log_loss"))


def over_dimensions(observed: DataFrame, keys: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """Metrics of the keys within each value of each dimension, from one pass."""
    of = F.array(*[F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in values.items()])
    rows = observed.withColumn("__of", F.explode(of)).withColumns({"dimension": F.col("__of.dimension"), "value": F.col("__of.value")})
    named = (*keys, "dimension", "value")
    return rows.groupBy(*named).agg(*row_sums()).select(*named, *metrics())
