"""Commands; each prints its summary as JSON with sorted keys."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from .operators import market, replay, scenarios
from .plans import artifacts, project
from .plans.replays import ALTERNATIVES
from .session import session
from .sources import books, fetch, files

COMMANDS = ("fetch", "fetch-odds", "build-matches", "audit", "pipeline", "rating-readiness", "select-elo", "build-predictions", "ratings", "analyze-slams", "analyze-odds", "robustness", "rating-history-sensitivities", "market-probability-sensitivities", "publish-figure", "reproduce")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("duelscope")
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("--raw", default="data/raw")
    out.add_argument("--out", default="artifacts")
    out.add_argument("--config", default="config/sources.toml")
    out.add_argument("--lock", default="config/sources.lock.json")
    out.add_argument("--odds-config", default="config/odds_sources.toml")
    out.add_argument("--odds-lock", default="config/odds_sources.lock.json")
    out.add_argument("--odds-raw", default="data/raw/odds")
    out.add_argument("--odds", default="data/odds.csv")
    out.add_argument("--odds-schema", default="odds_row_id string, tour string, year int, slam string, round string, odds_winner_name string, odds_loser_name string, AvgW double, AvgL double")
    out.add_argument("--aliases")
    out.add_argument("--replicates", type=int, default=2000)
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "fetch":
        print(json.dumps(fetch.fetch(fetch.specs(a.config), a.raw, a.lock), sort_keys=True))
        return 0
    if a.command == "fetch-odds":
        found, about = books.sources(a.odds_config)
        print(json.dumps(fetch.fetch(found, a.odds_raw, a.odds_lock, check=books.workbook, about=about), sort_keys=True))
        return 0
    spark = session()
    predictions = lambda: spark.read.parquet(f"{a.out}/predictions")
    contests = lambda: project.contests_of(spark.read.parquet(f"{a.out}/matches"))
    odds = lambda: files.price_rows(spark, a.odds, a.odds_schema)

    def selected():
        """The parameters that the predictions were made with, if any were selected."""
        return spark.read.parquet(f"{a.out}/selected") if os.path.exists(f"{a.out}/selected") else None

    def ratings() -> dict:
        chosen = project.select_parameters(spark, a.out, a.out)
        return {"selected": chosen, "predictions": project.build_predictions(spark, a.out, a.out, chosen)}

    def benchmark() -> dict:
        found = project.market_benchmark(odds(), predictions(), files.aliases(spark, a.aliases) if a.aliases else None)
        market_rows = found["maximum"].where("model = 'market_odds'")
        write("market_consensus", market_rows.select("match_id", F.when(F.col("winner_is_player_1"), F.col("p1")).otherwise(F.col("p2")).alias("p_winner")))
        return {name: project.analyze(found[name]).summaries.count() for name in ("maximum", "common")} | {r["match_status"]: r["count"] for r in found["linked"].groupBy("match_status").count().collect()}

    def write(name: str, df) -> dict:
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        return {name: spark.read.parquet(f"{a.out}/{name}").count()}

    def scenario_tables() -> dict:
        if not a.odds:
            raise SystemExit("robustness needs --odds: a scenario leaves out contests of suspicious prices")
        found = project.market_benchmark(odds(), predictions(), files.aliases(spark, a.aliases) if a.aliases else None)
        linked = found["linked"].where("match_id is not null")
        priced = market.consensus(linked.withColumn("pairs", market.book_inventory(odds().columns)))
        odd = priced.select("match_id", F.coalesce("suspicious", F.lit(False)).alias("flagged"))
        regimes = scenarios.seed_regimes(contests()).select("tour", "slam", "year", "tourney_id", "regime")
        rows = found["maximum"].join(odd, "match_id", "left").join(regimes, ["tour", "slam", "year", "tourney_id"], "left")
        context = {"min_prior": F.coalesce(F.least("prior_w", "prior_l"), F.lit(0)), "both_surface": F.coalesce(F.least("surface_prior_w", "surface_prior_l") >= 1, F.lit(False)), "flagged": F.coalesce("flagged", F.lit(False)), "regime": F.coalesce("regime", F.lit("no_seeds"))}
        seen = project.observations.observations(rows.withColumns(context))
        replays = project.predicted(replay.replay(contests(), ALTERNATIVES)).where("model = 'surface_adjusted_elo' and slam is not null").withColumn("model", F.col("variant"))
        known = F.when(F.col("p_winner").isNull(), "missing_probability").otherwise("observed_probability").alias("odds_availability")
        status = predictions().where("model = 'overall_elo' and slam is not null").select("match_id", "tour", "slam").join(priced.select("match_id", "p_winner"), "match_id", "left").select("match_id", "tour", "slam", known)
        return artifacts.write_robustness(seen, predictions().where("model = 'overall_elo' and slam is not null"), replays, ALTERNATIVES, status, contests(), a.out, a.replicates)

    run = {
        "build-matches": lambda: project.build_matches(spark, a.raw, a.out),
        "audit": lambda: project.run_audit(spark, a.out, a.out),
        "pipeline": lambda: {"build": project.build_matches(spark, a.raw, a.out), "audit": project.run_audit(spark, a.out, a.out)},
        "rating-readiness": lambda: project.cold_start(spark, a.out, a.out),
        "select-elo": lambda: project.select_parameters(spark, a.out, a.out),
        "build-predictions": lambda: project.build_predictions(spark, a.out, a.out),
        "ratings": ratings,
        "analyze-slams": lambda: project.analyze_slams(spark, f"{a.out}/predictions", a.out, a.replicates),
        "analyze-odds": benchmark,
        "robustness": scenario_tables,
        "rating-history-sensitivities": lambda: project.write_rating_history(contests(), predictions(), a.out, selected=selected()),
        "market-probability-sensitivities": lambda: project.write_market_sensitivities(contests().join(odds().withColumn("pairs", market.book_inventory(odds().columns)).select("match_id", "pairs"), "match_id"), spark.read.parquet(f"{a.out}/market_consensus"), a.out),
        "publish-figure": lambda: project.publish(spark.read.parquet(f"{a.out}/summaries"), project.metrics.contrasts(project.metrics.cube(project.analyze(predictions()).observed)), a.out),
        "reproduce": lambda: project.reproduce(spark, a.raw, a.out, a.replicates),
    }[a.command]
    print(json.dumps(run(), sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
