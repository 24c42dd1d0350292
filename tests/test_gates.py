"""Contracts that keep a table from being written, and replays that tables of parameters feed."""

import os
from dataclasses import asdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelscope.functions import probability as P
from duelscope.operators import carried, chosen, contracts, market, replay
from duelscope.plans import project
from duelscope.sources import contests as src
from duelscope.sources import sinks


def of(folder):
    return sorted(x for x in os.listdir(folder)) if os.path.isdir(folder) else []


def test_a_broken_gate_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/table"
    good = spark.range(100).withColumn("p", F.lit(0.5))
    assert sinks.committed(good, path, {"inside": ~F.col("p").between(0, 1)}) == {"rows": 100, "inside": 0}
    bad = spark.range(50).withColumn("p", F.when(F.col("id") == 7, 2.0).otherwise(0.5))
    with pytest.raises(contracts.ContractError, match="inside"):
        sinks.committed(bad, path, {"inside": ~F.col("p").between(0, 1)}, order=["id"])
    with pytest.raises(contracts.ContractError, match="inside"):  # unknown counts as broken
        sinks.committed(bad.withColumn("p", F.lit(None).cast("double")), path, {"inside": ~F.col("p").between(0, 1)})
    assert spark.read.parquet(path).count() == 100 and of(tmp_path) == ["table"]
    sinks.committed(bad.where("id <> 7"), path, {"inside": ~F.col("p").between(0, 1)}, drop=("p",))
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 49


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    fails = spark.range(10).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        sinks.committed(fails, f"{tmp_path}/table", {"none": F.lit(False)})
    assert of(tmp_path) == []


@pytest.fixture(scope="module")
def tours(spark, folder):
    return src.tours(spark, folder).where("year <= 1995").withColumn("edition_id", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def frozen(spark, tours, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('frozen')}/predictions"
    project.predicted(replay.replay(tours.drop("edition_id"))).write.parquet(path)
    return spark.read.parquet(path)


POLICIES = project.HISTORY[:3]


def test_history_is_written_if_the_control_holds(spark, tours, frozen, tmp_path):
    found = project.write_rating_history(tours.drop("edition_id"), frozen, str(tmp_path), POLICIES)
    detail = spark.read.parquet(f"{tmp_path}/history_detail")
    assert found["rows"] == detail.count() > 0 and not found["control"]
    assert detail.groupBy("variant").count().select("count").distinct().count() == 1
    assert spark.read.parquet(f"{tmp_path}/history_summaries").select("variant").distinct().count() == 3


@pytest.mark.parametrize("broken", ["control", "uncovered"])
def test_history_with_a_broken_gate_leaves_no_output(spark, tours, frozen, tmp_path, broken):
    contests, other = tours.drop("edition_id"), frozen
    if broken == "control":
        other = frozen.withColumn("p1", F.col("p1") + F.when(F.col("slam") == "Wimbledon", 1e-9).otherwise(0.0))
    else:
        contests = contests.where("not (slam = 'Wimbledon' and round = 'F')")
    with pytest.raises(contracts.ContractError, match=broken):
        project.write_rating_history(contests, other, str(tmp_path), POLICIES[:1])
    assert of(tmp_path) == []


def prices(spark, folder):
    from duelscope.plans.catalogue import priced
    return priced(spark, folder).withColumn("edition_id", F.lit(None).cast("string"))


def test_market_policies_are_written_if_the_control_holds(spark, folder, tmp_path):
    rows = prices(spark, folder)
    frozen = market.consensus(rows).select("match_id", "p_winner")
    assert project.write_market_sensitivities(rows, frozen, str(tmp_path))["rows"] % len(market.POLICIES) == 0
    assert of(tmp_path) == ["policy_detail", "policy_summaries"]
    with pytest.raises(contracts.ContractError, match="control"):
        project.write_market_sensitivities(rows, frozen.withColumn("p_winner", F.col("p_winner") + 1e-9), f"{tmp_path}/other")
    with pytest.raises(contracts.ContractError, match="control"):
        project.write_market_sensitivities(rows, frozen.limit(3), f"{tmp_path}/other")
    assert of(f"{tmp_path}/other") == []


def test_tied_duplicates_stop_a_policy_that_keeps_one(spark, tours, frozen, tmp_path):
    contests = tours.drop("edition_id")
    twice = contests.unionByName(contests.where("not is_walkover").limit(1))
    with pytest.raises(contracts.ContractError, match="order"):
        project.write_rating_history(twice, frozen, str(tmp_path), (project.HISTORY[0], project.HISTORY[5]))
    assert of(tmp_path) == []


def test_broken_predictions_are_not_written(spark, tours, tmp_path, monkeypatch):
    tours.drop("edition_id").withColumn("tourney_date", F.col("event_date")).write.parquet(f"{tmp_path}/matches")
    assert project.build_predictions(spark, str(tmp_path), str(tmp_path))[0]["n"] > 0
    before = spark.read.parquet(f"{tmp_path}/predictions").count()
    real = project.predicted
    monkeypatch.setattr(project, "predicted", lambda rows: real(rows).withColumn("p2", F.when(F.col("round") == "F", 0.9).otherwise(F.col("p2"))))
    with pytest.raises(contracts.ContractError, match="probability"):
        project.build_predictions(spark, str(tmp_path), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == before and of(tmp_path) == ["matches", "predictions"]


def test_batches_of_other_dates_raise(spark):
    rows = spark.createDataFrame([("A", "2020-01-01", "2020-01-01"), ("A", "2020-01-02", "2020-01-03"), ("B", "2020-01-02", None)], "tour string, event_date string, own_date string")
    assert sorted(tuple(r) for r in contracts.batch_dates(rows).collect()) == [("A", 2, 1, 1), ("B", 1, 1, 1)]
    with pytest.raises(contracts.ContractError):
        contracts.check_batch_dates(rows)
    contracts.check_batch_dates(rows.where("own_date = event_date"))


@pytest.mark.parametrize("days", [[3, 2], [1, 2, 1]])
def test_streams_that_go_back_in_time_raise(days):
    n = len(days)
    frame = pd.DataFrame({"stream": [0] * n, "tour": ["ATP"] * n, "day": days, "winner_id": range(n), "loser_id": range(10, 10 + n), "winner_rank": [0] * n, "loser_rank": [0] * n, "surface_code": [0] * n, "best_of_five": [False] * n, "retired": [False] * n})
    run = replay.folded([[replay.Variant()]], ["day"], ("p_overall",))
    with pytest.raises(contracts.ContractError):
        list(run(iter([frame])))
    assert len(pd.concat(run(iter([frame.sort_values("day")])))) == n


def test_slices_of_dates_hold_so_many_rows():
    assert carried.cuts([(1, 5), (2, 5), (3, 11), (4, 1), (9, 2)], 10) == [(1, 2), (3, 3), (4, 9)]
    assert carried.cuts([], 10) == []


def test_replays_in_slices_are_those_of_the_whole(spark, tours, monkeypatch):
    v = [replay.Variant("a", k=24.0, by_rank=True, half_life=730.0, convert_tour="ATP", retirement=0.5), replay.Variant("b", weight=0.5, skip_retirements=True, duplicates="keep_one"), replay.Variant("c")]
    columns = ["variant", "match_id", "exclusion", *replay.STATE]

    def rows():
        declared = replay.replay(tours, v).select(*columns).collect()
        table = chosen.replayed(tours, chosen.every_tour(tours, chosen.candidates(spark, v)), ["tour", "match_id"]).select("variant", "match_id", *replay.STATE).collect()
        slam = replay.replay(tours, v, ("match_id",), ("p_blend",), "slam is not null").select("variant", "match_id", "exclusion", "p_blend").collect()
        return [sorted(map(repr, r)) for r in (declared, table, slam)]

    whole, made = rows(), []
    own = carried.cuts
    monkeypatch.setattr(carried, "cuts", lambda days, most: made.append(own(days, 60)) or made[-1])
    assert rows() == whole
    assert all(len(s) > 2 for s in made) and len(made) == 3
    of_slams = tours.where("slam is not null").select("match_id").distinct().count()
    assert len(whole[2]) == 3 * of_slams


# ---- parameters from tables


def test_parameters_from_a_table_replay_as_declared_ones_do(spark, tours):
    v = [replay.Variant("a", k=24.0, by_rank=True, half_life=730.0, convert_tour="ATP", retirement=0.5), replay.Variant("b", weight=0.5, skip_retirements=True, duplicates="keep_one")]
    rows = chosen.replayed(tours, chosen.every_tour(tours, chosen.candidates(spark, v)), ["tour", "match_id"])
    want = replay.replay(tours, v).where("exclusion is null")
    states = list(replay.STATE)
    got, expected = ({(r["variant"], r["match_id"]): [r[c] for c in states] for r in df.select("variant", "match_id", *states).collect()} for df in (rows, want))
    assert got.keys() == expected.keys()
    for key, values in got.items():
        assert values == pytest.approx(expected[key], nan_ok=True), key


def test_only_changed_policies_are_replayed_again(spark):
    base = replay.Variant("x")
    rows = [("current", "ATP", base), ("current", "WTA", base), ("strict", "ATP", replay.Variant("y", skip_retirements=True)), ("strict", "WTA", replay.Variant("z", weight=0.5)), ("skip", "ATP", replay.Variant("w", duplicates="skip_all")), ("skip", "WTA", base)]
    table = spark.createDataFrame([(p, t, tuple(asdict(v).values())) for p, t, v in rows], f"policy string, tour string, v struct<{', '.join(f.replace(' ', ':', 1) for f in chosen.FIELDS.split(', '))}>")
    got = {(r["policy"], r["tour"]): (r["changed"], r["required"]) for r in chosen.secondary(table).collect()}
    assert got == {("current", "ATP"): (False, False), ("current", "WTA"): (False, False), ("strict", "ATP"): (False, True), ("strict", "WTA"): (True, True), ("skip", "ATP"): (False, False), ("skip", "WTA"): (False, False)}


def test_selection_equals_one_by_hand(spark, tours):
    grid = [replay.Variant(f"current/{k:g}", k=k) for k in (8.0, 32.0)]
    years = (1992, 1993), (1994, 1995)
    own = {r["tour"]: r["v"] for r in chosen.selected(tours, chosen.candidates(spark, grid), *years).collect()}
    losses = replay.selection(tours, *years, grid).toPandas()
    for tour, part in losses.groupby("tour"):
        mean = part.groupby("variant")[["log_loss", "n"]].apply(lambda x: float((x.log_loss * x.n).sum() / x.n.sum()))
        assert own[tour]["variant"] == mean.idxmin()
        weights = [replay.Variant(f"{w:g}", k=own[tour]["k"], weight=w) for w in chosen.WEIGHTS]
        blend = replay.selection(tours.where(F.col("tour") == tour), *years, weights, model="p_blend").toPandas()
        mean = blend.groupby("variant")[["log_loss", "n"]].apply(lambda x: float((x.log_loss * x.n).sum() / x.n.sum()))
        assert own[tour]["weight"] == float(mean.idxmin())


def test_power_equals_bisection(spark):
    rng = np.random.default_rng(3)
    pairs = [*zip(1 + rng.exponential(2, 300), 1 + rng.exponential(2, 300)), (1.000001, 50.0), (1.01, 1.01), (2.0, 2.0), (1.25, 1 / 0.6), (900.0, 1.0005)]
    df = spark.createDataFrame([(float(w), float(l)) for w, l in pairs], "w double, l double")
    for r in df.select("w", "l", P.power("w", "l").alias("p")).collect():
        low, high = 0.0, 1.0
        while (1 / r["w"]) ** high + (1 / r["l"]) ** high > 1:
            high *= 2
        for _ in range(200):
            k = (low + high) / 2
            low, high = (k, high) if (1 / r["w"]) ** k + (1 / r["l"]) ** k > 1 else (low, k)
        assert r["p"] == pytest.approx((1 / r["w"]) ** low, abs=1e-10), r
    none = spark.createDataFrame([(None, 2.0), (1.0, 2.0), (2.0, 0.5)], "w double, l double")
    assert [r[0] for r in none.select(P.power("w", "l")).collect()] == [None, None, None]


def test_contest_proposals_equal_all_pairs(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    name = lambda: "".join(rng.choices("abcde ", k=rng.randint(0, 9)))
    candidates = [(rng.choice("xy"), name(), name()) for _ in range(150)] + [("x", "same one", "other"), ("x", "same one", "other"), ("x", None, "n")]
    unmatched = [(i, rng.choice("xyz"), name(), name()) for i in range(40)] + [(99, "x", "same on", "othér"), (100, "y", None, "n")]
    monkeypatch.setattr(market, "CHUNK", 20)
    got = {r["id"]: (r["proposal"], r["score"]) for r in market.contest_proposals(spark.createDataFrame(unmatched, "id int, context string, winner string, loser string"), spark.createDataFrame(candidates, "context string, winner string, loser string")).collect()}
    want = {}
    for i, context, w, l in unmatched:  # noqa: E741
        scored = [((SequenceMatcher(None, w, a).ratio() + SequenceMatcher(None, l, b).ratio()) / 2, f"{a} def. {b}") for c, a, b in candidates if c == context and a is not None and w is not None]
        if scored:
            want[i] = (max(scored)[1], round(max(scored)[0], 6))
    assert got == want
    names = [(a, b) for c, a, b in candidates if c == "x" and a is not None]
    alphabet = {ch: k for k, ch in enumerate(sorted({ch for pair in names for n in pair for ch in n}))}
    letters = tuple(market._letters([n[k] for n in names], alphabet) for k in (0, 1))
    assert market.best_contest("same on", "othér", names, letters, alphabet)[2] < len(names) / 4


def test_equal_inventories_are_solved_once(spark):
    rows = spark.createDataFrame([(i, 1.5 + i % 3, 2.5, None if i % 4 else 1.8, 2.1) for i in range(40)], "match_id int, a double, b double, c double, d double")
    rows = rows.withColumn("pairs", market.inventory(market.pair("Avg", F.col("a"), F.col("b")), market.pair("Book", F.col("c"), F.col("d"))))
    keys = ("policy", "odds_method", "unavailable_reason")
    each = market.under_policies(rows).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("p_winner").alias("mean_p"))
    told = lambda df: {tuple(r[k] for k in keys): (r["n"], r["mean_p"] and round(r["mean_p"], 9)) for r in df.collect()}
    assert told(market.policy_means(rows)) == told(each)


def test_flags_put_only_few_rows_in_order(spark):
    """No window of a group's whole rows: editions and the ten greatest residuals are ordered by themselves."""
    from duelscope.operators import scenarios

    names = "population string, match_id long, tour string, slam string, model string, year int, edition_id string, score_eligible boolean, upset_eligible boolean, p_under double, upset int"
    rows = [("p", i, "A", "W", m, 2000 + i % 8, f"{2000 + i % 8}:T", i % 9 > 0, i % 9 > 0, 0.3 + i / 1000, i % 2) for i in range(80) for m in ("x", "y")]
    flagged = scenarios.with_flags(spark.createDataFrame(rows, names), 2)
    got = [r for r in flagged.collect() if r["model"] == "x"]
    assert len(got) == 80
    best = sorted(((1 - (0.3 + i / 1000), i) for i in range(80) if i % 2 and i % 9), reverse=True)[:10]
    assert {r["match_id"] for r in got if r["top10"]} == {i for _, i in best}
    assert {r["match_id"] for r in got if r["latest"]} == {i for i in range(80) if i % 9 and i % 8 >= 3} == {r["match_id"] for r in got if r["latest_common"]}
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("windowspecdefinition(")[1:] if "score_eligible" in x.split(")")[0] or "common#" in x.split("),")[0].split(" DESC")[0]]


def test_contest_proposals_share_chunks_by_blocks(spark, monkeypatch):
    names = [f"{a} {b}" for a in ("ann", "bea", "cy") for b in ("boe", "coe", "dee")]
    candidates = spark.createDataFrame([("c", names[i], names[-1 - i]) for i in range(9)], "context string, winner string, loser string")
    unmatched = spark.createDataFrame([(i, "c", names[i % 9].replace("e", "i"), names[i * 5 % 9]) for i in range(40)], "id int, context string, winner string, loser string")
    found = []
    for size in (3, market.BLOCK):
        monkeypatch.setattr(market, "BLOCK", size)
        found.append(sorted(map(tuple, market.contest_proposals(unmatched, candidates).collect())))
    assert found[0] == found[1] and len(found[0]) == 40


def test_candidates_bound_few_of_a_context(monkeypatch):
    """A contest of a large context makes a handful of scores and bounds, and finds what all pairs give."""
    import pyarrow as pa
    from difflib import SequenceMatcher

    candidates = [(f"PLAYER {k * 7919 % 3000}", f"PLAYER {k * 104729 % 2999}") for k in range(20_000)] + [("", ""), ("", "PLAYER 5"), ("żółć 世界", "PLAYER 21")]
    of = market.Candidates(*(pa.array([c[k] for c in candidates]) for k in (0, 1)))
    bounded: list[int] = []
    bounds = of._bounds
    monkeypatch.setattr(of, "_bounds", lambda name, signs: (bounded.append(len(signs)), bounds(name, signs))[1])
    odd = lambda x: x.replace("L", "I").replace("Y", "")
    asked = [tuple(map(odd, candidates[k])) for k in (3, 777, 19_999, 20_001, 20_002)] + [("", ""), ("nobody", "PIAER 77"), ("世", "PIAER 12")]
    for w, l in asked:  # noqa: E741
        bounded.clear()
        score, proposal, made = of.best(w, l)
        all_pairs = max(((SequenceMatcher(None, w, a).ratio() + SequenceMatcher(None, l, b).ratio()) / 2, f"{a} def. {b}") for a, b in candidates)
        assert (score, proposal) == all_pairs
        if w.startswith("PIAER"):
            assert made < 50 and sum(bounded) < len(candidates) / 10
    monkeypatch.setattr(market, "CLASSES", 2)
    few = market.Candidates(*(pa.array([c[k] for c in candidates]) for k in (0, 1)))
    assert [few.best(*q)[:2] for q in asked[:4]] == [of.best(*q)[:2] for q in asked[:4]]
