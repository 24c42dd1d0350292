"""The robustness build at size: lines are paired once, a contest's rows are made where it is, shuffle files go with their job."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from duelscope.operators import coldstart, observations, scenarios
from duelscope.plans import artifacts
from duelscope.sources import contests as src
from duelscope.sources import scratch


class Stopped(Exception):
    pass


def test_lines_are_paired_once(spark, folder, tmp_path, monkeypatch):
    paired, plans = src.paired, []

    def counted(*tables):
        plans.append(paired(*tables))
        return plans[-1]

    def stop(*given, **_):
        assert not any("lineitem" in df._jdf.queryExecution().optimizedPlan().toString() or "l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString() for df in given if hasattr(df, "_jdf"))
        raise Stopped

    monkeypatch.setattr(src, "paired", counted)
    monkeypatch.setattr(src, "contests", None)
    monkeypatch.setattr(artifacts, "write_robustness", stop)
    with pytest.raises(Stopped):
        artifacts.built(spark, folder, str(tmp_path / "out"))
    assert len(plans) == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("lineitem_", "orders_"))]


def test_bucketed_lines_are_not_shuffled(spark, folder, monkeypatch):
    paired, plans = src.paired, []

    def seen(*tables):
        df = paired(*tables)
        plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(src, "paired", seen)
    found, _ = src.written(spark, folder, artifacts.CONTEST)
    assert "hashpartitioning(l_orderkey" not in plans[0] and "Bucketed: true" in plans[0]
    wanted = src.contests(spark, folder).select(*artifacts.CONTEST)
    assert found.count() == wanted.count() > 0 and found.exceptAll(wanted).isEmpty()


def odd_contests(spark):
    rows = [
        (k, (None, "A", "B")[k % 3 if k % 11 == 0 else 1 + k % 2], None if k % 13 == 0 else f"2020-01-{1 + k % 9:02d}", 2020, "Wimbledon" if k % 2 or k % 7 == 0 else None, ("Clay", "Hard", None)[k % 5 % 3], k % 17 == 0, None if k % 19 == 0 else k % 7, (k * 3 + 1) % 7)
        for k in range(400)
    ]
    c = spark.createDataFrame(rows, "match_id long, tour string, day string, year int, slam string, surface string, is_walkover boolean, winner_id long, loser_id long")
    return c.withColumns({"event_date": F.to_date("day"), **{f"{s}_{x}": F.lit(None).cast("string") for s in ("winner", "loser") for x in ("rank", "entry")}})


@pytest.mark.parametrize("odd", [False, True])
def test_histories_are_those_of_both_operators(spark, folder, odd):
    c = odd_contests(spark) if odd else src.contests(spark, folder)
    slams = c.where("slam is not null").select("match_id")
    prior = coldstart.match_rollup(coldstart.entrants(c)).select("match_id", "min_prior")
    wanted = slams.join(prior, "match_id", "left").join(scenarios.surface_history(c), "match_id", "left").select("match_id", F.coalesce("min_prior", F.lit(0)), "both_surface")
    found = slams.join(scenarios.histories(c), "match_id", "left").select("match_id", F.coalesce("min_prior", F.lit(0)), F.coalesce("both_surface", F.lit(False)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert len({r[1:] for r in found.collect()}) > 2


def test_panels_are_observations_with_their_flags(spark, folder):
    c = src.contests(spark, folder).where("slam is not null")
    rows, rated = src.predicted(c)
    # a model that sees a side below 0.05, is odd, or has no probability
    other = F.struct(F.lit("other").alias("model"), *[F.when(F.col("match_id") % 4 == 0, F.lit(0.01 if x == "p1" else 0.99)).when(F.col("match_id") % 4 == 1, 0.5).when(F.col("match_id") % 4 == 2, 0.7).alias(x) for x in ("p1", "p2")], F.lit(None).cast("string").alias("exclusion"), F.lit(False).alias("format_conflict"), F.lit(True).alias("winner_is_player_1"))
    models = [rated[0], rated[2], other]
    panel = observations.panels(rows, models)
    plan = panel._jdf.queryExecution().executedPlan().toString().split("Window", 1)[0]
    assert "Exchange" not in plan  # above the pairing of the lines
    kept = ["match_id", "tour", "slam", "year", "edition_id", "is_retirement", "is_walkover"]
    long = rows.select(*kept, F.inline(F.array(*models)))
    wanted = scenarios.with_flags(observations.observations(long), 3)
    columns = [*kept, *observations.OBSERVED, "top10", "latest", "latest_common"]
    found = scenarios.with_flags(panel, 3).select(*columns)
    assert found.count() == wanted.count() > 0 and found.exceptAll(wanted.select(*columns)).isEmpty()
    assert found.select("common").distinct().count() == found.select("extreme").distinct().count() == 2


def test_shuffle_files_go_with_their_job(spark, tmp_path):
    name, base = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    before, held = spark.conf.get(name), lambda: {f for d in base for f in glob.glob(os.path.join(d, "**", "shuffle_*.data"), recursive=True)}
    old = held()
    with scratch.tidy(spark):
        spark.range(10_000).withColumn("k", F.col("id") % 97).groupBy("k").agg(F.collect_list("id")).write.parquet(str(tmp_path / "rows"))
    assert not held() - old and spark.conf.get(name) == before


def test_scenarios_sum_equal_rows_before_they_are_dealt_out(spark):
    """Rows meet no scenario before they are summed, and each scenario holds the rows of its condition."""
    names = "population string, tour string, slam string, model string, edition_id string, year int, round string, regime string, min_prior int, flagged boolean, both_surface boolean, common boolean, extreme boolean, latest boolean, latest_common boolean, top10 boolean, score_eligible boolean, upset_eligible boolean, p_under double, upset int, brier double, log_loss double"
    rows = [(scenarios.PRIMARY, "A", "W", "x", f"e{i % 4}", 2000 + i % 4, (None, "R64", "QF")[i % 3], "no_seeds", None if i % 23 == 0 else i % 25, False, True, i % 5 > 0, False, True, True, i % 7 == 0, i % 11 > 0, True, 0.3, i % 2, 0.1, 0.2) for i in range(300)]
    wanted = ("common_primary", "common_min_prior_5", "common_min_prior_20", "common_late_rounds", "common_remove_top10_positive_residuals")
    found = scenarios.scenario_summaries(spark.createDataFrame(rows, names), {n: c for n, c in scenarios.tags().items() if n in wanted})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate explode") :]
    got = {r["scenario"]: (r["score_matches"], r["actual_upsets"], r["editions"]) for r in found.collect()}
    common = [r for r in rows if r[16] and r[11]]
    own = {"common_primary": common, **{f"common_min_prior_{n}": [r for r in common if r[8] is not None and r[8] >= n] for n in (5, 20)}, "common_late_rounds": [r for r in common if r[6] == "QF"], "common_remove_top10_positive_residuals": [r for r in common if not r[15]]}
    assert got == {n: (len(of), sum(r[19] for r in of), len({r[4] for r in of})) for n, of in own.items()}
