"""The stages of a whole project: each reads tables, writes tables and returns a small summary."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, chosen, coldstart, contracts, linkage, market, metrics, normalize, observations, publication, replay, resample, scenarios
from ..schemas import MODELS
from ..sources import files, sinks
from . import figure

MATCH_ORDER = ("tour", "year", "source_file", "source_row_number", "match_id")


@dataclass(frozen=True)
class Bundle:
    """The result tables of an upset analysis."""

    observed: DataFrame
    summaries: DataFrame
    dimensions: DataFrame
    calibration: DataFrame
    rolling: DataFrame
    exclusions: DataFrame


def build_matches(spark: SparkSession, raw: str, out: str) -> dict:
    """Raw files to the canonical table and its issues."""
    rows = normalize.normalize(files.raw_rows(spark, raw)).persist()
    overflow = files.raw_rows(spark, raw).where("overflow is not null").select("source_file", "source_row_number", "tour", "year", F.lit("_row").alias("field"), F.col("overflow").alias("raw_value"), F.lit("values beyond the header").alias("issue"))
    sinks.parquet(rows.drop("issues"), f"{out}/matches", order=list(MATCH_ORDER))
    sinks.parquet(normalize.issues(rows).unionByName(overflow), f"{out}/issues", order=["source_file", "source_row_number", "field", "issue"])
    summary = rows.agg(F.count("*").alias("matches"), F.countDistinct("source_file").alias("files")).first().asDict()
    summary["issues"] = spark.read.parquet(f"{out}/issues").count()
    rows.unpersist()
    return summary


def run_audit(spark: SparkSession, built: str, out: str) -> dict:
    matches, issues = spark.read.parquet(f"{built}/matches"), spark.read.parquet(f"{built}/issues")
    found = audit.issue_table(matches, issues)
    sinks.parquet(found, f"{out}/audit_issues", order=[F.col(c).asc_nulls_first() for c in audit.ISSUE])
    kinds = {r["category"]: r["n"] for r in found.groupBy("category").agg(F.count("*").alias("n")).collect()}
    return {"categories": dict(sorted(kinds.items())), "primary_period_ready": audit.verdict(matches, issues).first()["ready"]}


def contests_of(matches: DataFrame) -> DataFrame:
    """Canonical matches under the names that the replay reads."""
    return matches.withColumn("event_date", F.col("tourney_date"))


def cold_start(spark: SparkSession, built: str, out: str) -> dict:
    entrants = coldstart.entrants(contests_of(spark.read.parquet(f"{built}/matches")))
    rollup = coldstart.match_rollup(entrants)
    sinks.parquet(entrants, f"{out}/player_experience", order=["tour", "event_date", "match_id", "side"])
    sinks.parquet(coldstart.match_thresholds(rollup), f"{out}/match_thresholds")
    sinks.parquet(coldstart.entrant_thresholds(entrants), f"{out}/entrant_thresholds")
    return {"matches": rollup.count()}


def select_parameters(spark: SparkSession, built: str, out: str, first: tuple[int, int] = (1978, 1982), second: tuple[int, int] = (1983, 1987), variants: list[replay.Variant] | None = None, rolling: bool = False) -> dict:
    """Overall parameters from the grid, then the surface weight, per tour; written as ``selected`` and returned for the configuration."""
    contests = contests_of(spark.read.parquet(f"{built}/matches"))
    grid = [replay.Variant(**{**v.__dict__, "variant": f"current/{v.variant}"}) for v in variants or replay.GRID]
    sinks.parquet(replay.selection(contests, first, second, grid), f"{out}/selection", order=["tour", "window", "variant"])
    windows = ("second",) if rolling else ("first", "second")
    own = chosen.selected(contests, chosen.candidates(spark, grid), first, second, windows, spark.read.parquet(f"{out}/selection"))
    sinks.committed(own, f"{out}/selected", {"weight": ~F.col("v.weight").isin(*chosen.WEIGHTS), "tours": F.count("*").over(Window.partitionBy("policy", "tour")) > 1}, order=["tour"])
    return {r["tour"]: r["v"].asDict() for r in spark.read.parquet(f"{out}/selected").collect()}  # a row for each tour


def broken_predictions() -> dict[str, Column]:
    """What makes a row of predictions break its contract."""
    chances = ~F.col("p1").between(0, 1) | (F.abs(F.col("p1") + F.col("p2") - 1) > 1e-12)
    return {"probability": F.when(F.col("eligible"), chances).otherwise(F.lit(False)), "reason": F.col("eligible") != F.col("exclusion").isNull()}


def build_predictions(spark: SparkSession, built: str, out: str, selected: dict[str, dict] | None = None) -> dict:
    contests = contests_of(spark.read.parquet(f"{built}/matches"))
    parts = []
    for tour, v in (selected or {}).items():
        parts.append(replay.replay(contests.where(F.col("tour") == tour), [replay.Variant(**{**v, "variant": "base"})]))
    rows = parts[0] if parts else replay.replay(contests)
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sinks.committed(predicted(rows), f"{out}/predictions", broken_predictions(), partitions=("tour", "year"))
    written = spark.read.parquet(f"{out}/predictions")
    return written.groupBy("model").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible")).orderBy("model").toPandas().to_dict("records")


def predicted(replayed: DataFrame) -> DataFrame:
    """The long form with what the analysis reads besides."""
    conflict = F.col("slam").isNotNull() & (F.col("best_of") != replay.effective_best_of())
    edition = F.concat_ws(":", F.col("year").cast("string"), F.coalesce(F.col("tourney_id"), F.col("event_date").cast("string")))
    return replay.long_form(replayed).withColumns({"format_conflict": F.coalesce(conflict, F.lit(False)), "edition_id": edition})


def analyze(predictions: DataFrame) -> Bundle:
    """Upset tables of Slam predictions; the cube is computed once."""
    observed = observations.observations(predictions.where("slam is not null"))
    cube = metrics.cube(observed)
    return Bundle(observed, metrics.summaries(cube), metrics.dimensions(cube), metrics.calibration(observed), metrics.rolling(cube), observations.exclusion_counts(observed))


def analyze_slams(spark: SparkSession, predictions: str, out: str, replicates: int = resample.REPLICATES) -> dict:
    found = analyze(spark.read.parquet(predictions))
    for name, df in (("summaries", found.summaries), ("dimensions", found.dimensions), ("calibration", found.calibration), ("rolling", found.rolling), ("exclusions", found.exclusions)):
        contracts.check_no_identities(df)
        sinks.parquet(df, f"{out}/{name}")
    cube = metrics.cube(found.observed)
    sinks.parquet(resample.intervals(cube, replicates=replicates), f"{out}/intervals")
    sinks.parquet(resample.joint_contrast(cube, replicates=replicates), f"{out}/contrasts")
    return {"summaries": found.summaries.count()}


def market_benchmark(odds: DataFrame, predictions: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Linked prices as a fourth model, on all contests it has and on those that all models share."""
    canonical = predictions.where((F.col("model") == MODELS[0]) & F.col("slam").isNotNull())
    sides = canonical.select("match_id", "tour", "year", "slam", "round", "winner_is_player_1", *[F.when(F.col("winner_is_player_1") == w, F.col(f"winner_{x}")).otherwise(F.col(f"loser_{x}")).alias(f"player_{k}_{x}") for k, w in ((1, True), (2, False)) for x in ("id", "name")])
    if aliases is not None:
        players = sides.select("tour", F.col("player_1_id").alias("player_id"), F.col("player_1_name").alias("name")).unionByName(sides.select("tour", F.col("player_2_id").alias("player_id"), F.col("player_2_name").alias("name")))
        linkage.check_aliases(aliases, players)
    linked = linkage.linked(odds, sides, aliases)
    priced = market.consensus(linked.withColumn("pairs", market.book_inventory(odds.columns)))
    own = priced.where("match_id is not null and p_winner is not null").select("match_id", "p_winner", "p_loser")
    base = canonical.join(own, "match_id").drop("model", "p1", "p2", "exclusion")
    one = F.col("winner_is_player_1")
    p1 = F.when(one, F.col("p_winner")).otherwise(F.col("p_loser"))
    rows = base.withColumns({"model": F.lit("market_odds"), "p1": p1, "p2": 1.0 - p1, "exclusion": F.lit(None).cast("string")}).drop("p_winner", "p_loser")
    every = predictions.where("slam is not null").unionByName(rows, allowMissingColumns=True)
    scored = observations.observations(every).where("population = 'completed_non_retirement' and score_eligible")
    panel = scored.groupBy("match_id").agg(F.count_distinct("model").alias("k")).where(F.col("k") == len(MODELS) + 1).select("match_id")
    return {"linked": linked, "maximum": every, "common": every.join(panel, "match_id", "left_semi")}


def robustness(observed: DataFrame) -> dict[str, DataFrame]:
    """All scenarios and their distance from the primary one; needs min_prior, flagged, both_surface and regime."""
    found = scenarios.scenario_summaries(scenarios.with_flags(observed), scenarios.tags())
    return {"scenarios": found, "deltas": scenarios.deltas(found)}


#: The history policies that are compared (fixed values); the first is the control.
HISTORY = (replay.Variant("current"), replay.Variant("half_retirements", retirement=0.5), replay.Variant("no_retirement_delta", retirement=0.0), replay.Variant("strict", skip_retirements=True), replay.Variant("skip_duplicates", duplicates="skip_all"), replay.Variant("keep_one", duplicates="keep_one"))


def rating_history(contests: DataFrame) -> DataFrame:
    """Summaries of the Slam forecasts under each history policy, all replays side by side."""
    observed = observations.observations(predicted(replay.replay(contests, list(HISTORY), replay.PREDICTED, replay.FORECASTS, "slam is not null")))
    cube = metrics.cube(observed, ("variant", *metrics.CELL))
    return metrics.summaries(cube, ("variant", *metrics.BASE))


def under_history(contests: DataFrame, selected: DataFrame, policies: tuple[replay.Variant, ...] = HISTORY) -> DataFrame:
    """Rated contests under each history policy with the selected parameters (tour, v) of their tour."""
    each = F.array(*[chosen.named(F.col("v"), F.lit(p.variant), retirement=p.retirement, skip_retirements=p.skip_retirements, duplicates=p.duplicates) for p in policies])
    parameters = selected.select("tour", F.explode(each).alias("v"))
    return chosen.replayed(contests, parameters, [*contests.columns, "duplicate"]).withColumn("exclusion", F.lit(None).cast("string"))


def write_rating_history(contests: DataFrame, frozen: DataFrame, out: str, policies: tuple[replay.Variant, ...] = HISTORY, model: str = "surface_adjusted_elo", selected: DataFrame | None = None) -> dict:
    """Replays on exactly the contests of the frozen predictions, and their summaries; nothing is left if a gate does not hold.

    Targets are the Slam contests without retirement, conflict and probable
    duplicate that the frozen predictions rate.  Every policy has to cover
    each of them once, the control has to give the frozen probabilities, and
    where one of a group of duplicates is kept, it must be told which.
    """
    if any(p.duplicates == "keep_one" for p in policies):
        contracts.check_representative_order(contests)
    clean = f"model = '{model}' and slam is not null and eligible and not is_retirement and not format_conflict and not duplicate"
    targets = frozen.where(clean).select("match_id", F.col("p1").alias("frozen_p1"))
    replayed = replay.replay(contests, list(policies)) if selected is None else under_history(contests, selected, policies)
    rows = predicted(replayed).where(F.col("model") == model)
    panel = contracts.exact_panel(rows, targets).join(targets, "match_id")
    control = (F.col("variant") == policies[0].variant) & (F.abs(F.col("p1") - F.col("frozen_p1")) > 1e-12)
    gates = {"uncovered": F.col("uncovered") | ~F.coalesce("eligible", F.lit(False)), "repeated": F.coalesce(F.col("copies") > 1, F.lit(False)), "control": F.coalesce(control, F.lit(False))}
    found = sinks.committed(panel, f"{out}/history_detail", gates, drop=("uncovered", "copies"))
    detail = contests.sparkSession.read.parquet(f"{out}/history_detail")
    summaries = metrics.summaries(metrics.cube(observations.observations(detail), ("variant", *metrics.CELL)), ("variant", *metrics.BASE))
    contracts.check_no_identities(summaries)
    sinks.parquet(summaries, f"{out}/history_summaries", order=["variant", *metrics.BASE])
    return found


def shared_policies(priced: DataFrame) -> DataFrame:
    """The contests that all policies price, once per policy, as predictions."""
    rows = market.under_policies(priced)
    panel = rows.where("p_winner is not null").groupBy("match_id").agg(F.count("*").alias("k")).where(F.col("k") == len(market.POLICIES)).select("match_id")
    return market.market_predictions(rows.join(panel, "match_id", "left_semi")).withColumn("format_conflict", F.lit(False))


def market_sensitivities(priced: DataFrame) -> DataFrame:
    """Summaries of the market model under each probability policy on the contests that all of them price."""
    cube = metrics.cube(observations.observations(shared_policies(priced)), ("policy", *metrics.CELL))
    return metrics.summaries(cube, ("policy", *metrics.BASE))


def write_market_sensitivities(priced: DataFrame, frozen: DataFrame, out: str) -> dict:
    """The same, written: the first policy has to give the frozen probabilities (match_id, p_winner) of every contest it shares, and probabilities have to be complete."""
    rows = shared_policies(priced).join(frozen.select("match_id", F.col("p_winner").alias("frozen_p")), "match_id", "left")
    control = (F.col("policy") == market.POLICIES[0].policy) & (F.col("frozen_p").isNull() | (F.abs(F.col("p_winner") - F.col("frozen_p")) > 1e-12))
    gates = {"control": control, "probability": ~F.col("p_winner").between(0, 1) | (F.abs(F.col("p_winner") + F.col("p_loser") - 1) > 1e-9), "policies": F.count("*").over(Window.partitionBy("match_id")) != len(market.POLICIES)}
    found = sinks.committed(rows.drop("pairs"), f"{out}/policy_detail", gates, drop=("frozen_p",))
    detail = priced.sparkSession.read.parquet(f"{out}/policy_detail")
    summaries = metrics.summaries(metrics.cube(observations.observations(detail), ("policy", *metrics.CELL)), ("policy", *metrics.BASE))
    contracts.check_no_identities(summaries)
    sinks.parquet(summaries, f"{out}/policy_summaries", order=["policy", *metrics.BASE])
    return found


def publish(summaries: DataFrame, contrast: DataFrame, out: str) -> dict:
    """Figure data as CSV, the figure as SVG, PDF and PNG, and a digest of each file."""
    rows = publication.figure_data(summaries, contrast)
    return _published(rows, ["panel", "tour", "slam", "model", "metric"], [r.asDict() for r in rows.limit(figure.LIMIT + 1).collect()], out)


def publish_panels(rows: DataFrame, out: str, wanted: dict[str, int] | None = None) -> dict:
    """The same of the five panels in the order of their places; with ``wanted`` only if each panel has that many rows."""
    if wanted:
        publication.check_panels(rows, wanted)
    return _published(rows, ["place"], [r.asDict() for r in rows.orderBy("place").limit(figure.LIMIT + 1).collect()], out)


def _published(rows: DataFrame, order: list[str], shown: list[dict], out: str) -> dict:
    contracts.check_no_identities(rows)
    scene = figure.scene_of("Upsets per 100 contests", shown)
    made = {"figure_data.csv": sinks.csv_text(rows, order).encode(), "figure.svg": figure.svg(scene).encode(), "figure.pdf": figure.pdf(scene), "figure.png": figure.png(scene)}
    for name, content in made.items():
        sinks.write_bytes(f"{out}/{name}", content)
    files_made = {name: hashlib.sha256(content).hexdigest() for name, content in made.items()}
    sinks.write_text(f"{out}/figure.json", json.dumps({"rows": len(shown), "files": files_made}, indent=2, sort_keys=True))
    return {"rows": len(shown), "files": files_made}


#: The order of a whole reproduction.
ORDER = ("build-matches", "audit", "rating-readiness", "select-elo", "build-predictions", "analyze-slams", "publish-figure")


def reproduce(spark: SparkSession, raw: str, out: str, replicates: int = resample.REPLICATES, steps: dict | None = None) -> dict:
    """All stages from raw files in fixed order; ``steps`` can replace one."""
    found: dict = {}
    own = {
        "build-matches": lambda: build_matches(spark, raw, out),
        "audit": lambda: run_audit(spark, out, out),
        "rating-readiness": lambda: cold_start(spark, out, out),
        "select-elo": lambda: select_parameters(spark, out, out),
        "build-predictions": lambda: build_predictions(spark, out, out, found.get("select-elo")),
        "analyze-slams": lambda: analyze_slams(spark, f"{out}/predictions", out, replicates),
        "publish-figure": lambda: publish(spark.read.parquet(f"{out}/summaries").where("population = 'completed_non_retirement'"), metrics.contrasts(metrics.cube(analyze(spark.read.parquet(f"{out}/predictions")).observed)).where("population = 'completed_non_retirement'"), out),
    } | (steps or {})
    for name in ORDER:
        found[name] = own[name]()
    return found
