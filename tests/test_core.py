"""Hand-computed numbers, invariants and contracts of the contest operators."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelscope.functions import probability as P
from duelscope.functions import text as X
from duelscope.operators import audit, coldstart, contracts, linkage, market, metrics, normalize, observations, publication, replay, resample, scenarios
from duelscope.plans import catalogue, project, robustness
from duelscope.schemas import MATCHES, MODELS, RAW_COLUMNS
from duelscope.sources import contests, fetch, files, sinks

DAY = datetime.date(2020, 1, 1)
CONTEST = "match_id string, tour string, event_date date, year int, slam string, tourney_name string, round string, surface string, best_of int, winner_id long, loser_id long, winner_rank int, loser_rank int, is_walkover boolean, is_retirement boolean, source_file string"


def contest(id_, days=0, w=1, l=2, **over):  # noqa: E741
    day = None if days is None else DAY + datetime.timedelta(days=days)
    row = {"match_id": id_, "tour": "ATP", "event_date": day, "year": 2020, "slam": None, "tourney_name": "T", "round": "R32", "surface": "Hard", "best_of": 3, "winner_id": w, "loser_id": l, "winner_rank": None, "loser_rank": None, "is_walkover": False, "is_retirement": False, "source_file": "f"} | over
    return tuple(row.values())


def replayed(spark, rows, *variants):
    found = replay.replay(spark.createDataFrame(rows, CONTEST), list(variants) or None).collect()
    return {(r["variant"], r["match_id"], r["exclusion"]): r for r in found}


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# --- functions -----------------------------------------------------------------


def test_elo_and_format_columns(spark):
    lit = F.lit
    r = one(spark, P.elo(lit(1500.0), lit(1900.0)), P.best_of_three(P.set_probability(lit(0.7))), P.rank_rating(lit(100)), P.rank_rating(lit(None).cast("int")), P.rank_rating(lit(1)), P.decayed(lit(1700.0), lit(365), lit(365.0)), P.additive(lit(1 / 1.8), lit(10.0)), P.proportional(lit(1.8), lit(2.2)))
    assert r[0] == pytest.approx(1 / 11) and r[1] == pytest.approx(0.7) and r[2] == 1500 and r[3] == 1500 and r[4] == 2200 and r[5] == pytest.approx(1600) and r[7] == pytest.approx(0.55)
    assert r[6] is None
    p = 0.6
    q = p**3 * (10 - 15 * p + 6 * p * p)
    assert one(spark, P.best_of_five(F.lit(p)))[0] == pytest.approx(q)


def test_power_prices(spark):
    df = spark.createDataFrame([(1.25, 1 / 0.6), (1.9, 1.9), (None, 2.0), (1.01, 30.0)], "w double, l double")
    got = [r[0] for r in df.select(P.power("w", "l")).collect()]
    assert got[0] == pytest.approx(0.64) and got[1] == pytest.approx(0.5) and got[2] is None
    assert 0 < got[3] < 1


def test_names_and_signatures(spark):
    names = ["Félix Auger-Aliassime", "Łuczak P.", "O'Brien", None, "  "]
    got = [r["k"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.key(F.col("n"), X.ascii_fold("n")).alias("k")).collect()]
    assert got == ["felix auger aliassime", "uczak p", "o brien", "", ""]
    words = lambda s: F.array(*map(F.lit, s.split()))
    r = one(spark, X.full_name_signatures(words("felix auger aliassime")), X.short_name_signatures(words("auger aliassime f")), X.short_name_signatures(words("j p smith")))
    assert sorted(r[0]) == ["aliassime:f", "augeraliassime:f"] and "augeraliassime:f" in r[1] and "smith:j" in r[2]


# --- normalizer and audit --------------------------------------------------------

RAW = [
    {"tourney_id": "2024-580", "tourney_name": "Australian Open", "surface": "Hard", "draw_size": "128", "tourney_level": "G", "tourney_date": "20240115", "match_num": "1", "winner_id": "101", "winner_name": "Ann A", "winner_rank": "3", "loser_id": "102", "loser_name": "Bea B", "score": "6-4 6-4", "best_of": "5", "round": "R128"},
    {"tourney_id": "2024-999", "tourney_name": "Ünder Öpen", "surface": "Sand", "draw_size": "thirty", "tourney_level": "a", "tourney_date": "2024011", "match_num": "1_0", "winner_id": "", "winner_name": " Cy  C ", "loser_id": "104", "loser_name": "Di D", "score": "W/O", "best_of": "3", "round": "r32"},
    {"tourney_name": "Wimbledon", "surface": "Clay", "tourney_level": "A", "tourney_date": "20230105", "winner_name": "E", "loser_name": "F", "score": "6-1 RET"},
    {"tourney_id": "x-540", "tourney_name": "US Open", "tourney_level": "G", "tourney_date": "20240901"},
]


def raw(spark, rows=RAW):
    data = [tuple(r.get(c) for c in RAW_COLUMNS) + ("ATP", 2024, "atp/f.csv", "local:f", i + 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", tour string, year int, source_file string, source_ref string, source_row_number long")


def test_normalizer_keeps_rows_and_reports(spark):
    import hashlib

    rows = {r["source_row_number"]: r for r in normalize.normalize(raw(spark)).collect()}
    assert len(rows) == 4 and rows[1]["slam"] == "Australian Open" and rows[1]["issues"] == []
    key = ["v1", "ATP", "atp/f.csv", "2024-580", "2024-01-15", "1", "R128", "id:101", "id:102"]
    assert rows[1]["match_id"] == hashlib.sha256("\x1f".join(key).encode()).hexdigest()
    assert rows[2]["is_walkover"] and rows[2]["surface"] == "Sand" and rows[2]["round"] == "R32" and rows[2]["winner_name"] == "Cy  C"
    assert {i["field"] for i in rows[2]["issues"]} == {"draw_size", "match_num", "tourney_date", "surface"}
    assert rows[3]["is_retirement"] and rows[3]["slam"] is None and {i["issue"] for i in rows[3]["issues"]} == {"date year differs from source file year 2024", "only one sign of a Slam, and level is not G"}
    assert rows[4]["slam"] is None and "different Slams" in rows[4]["issues"][0]["issue"]
    assert normalize.normalize(raw(spark)).drop("issues").columns == MATCHES.names


def test_slam_warnings(spark):
    rows = [("ATP", "2022-540", "Wimbledon", datetime.date(2022, 3, 1), "G", "Hard", 2022), ("WTA", "1", "Roland Garros", datetime.date(2020, 10, 1), "G", "Clay", 2020), ("ATP", "1988-580", "Elsewhere", None, "G", None, 1988), ("ATP", "7", "Nowhere", None, "G", None, 1990)]
    df = spark.createDataFrame(rows, "tour string, id string, name string, d date, level string, surface string, year int")
    slam, warnings = normalize.slam_decision(F.col("tour"), F.col("id"), X.key(F.col("name")), F.col("d"), F.col("level"), F.col("surface"), F.col("year"))
    got = df.select(slam.alias("s"), warnings.alias("w")).collect()
    assert [r["s"] for r in got] == ["Wimbledon", "Roland Garros", "Australian Open", None]
    assert [len(r["w"]) for r in got] == [2, 0, 0, 1] and "played on Grass" in got[0]["w"][1]


def test_fixture_files_end_to_end(spark, tmp_path):
    header = ",".join(RAW_COLUMNS)
    for tour, year, rows in (("atp", 2024, RAW[:2] + RAW[:1]), ("wta", 1987, [{"tourney_id": "1", "tourney_name": "French Open", "tourney_level": "G", "surface": "Clay", "tourney_date": "19870525", "winner_name": "G", "loser_name": "H", "score": "6-0 RET", "round": "F"}])):
        at = tmp_path / "raw" / tour / f"{tour}_matches_{year}.csv"
        at.parent.mkdir(parents=True)
        at.write_text("﻿" + header + "\n" + "\n".join(",".join(r.get(c, "") for c in RAW_COLUMNS) for r in rows) + "\n", encoding="utf-8")
    found = project.build_matches(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert (found["files"], found["matches"], found["issues"]) == (2, 4, 4)
    verdict = project.run_audit(spark, str(tmp_path / "out"), str(tmp_path / "out"))
    assert verdict["primary_period_ready"] is False
    assert {"duplicate_canonical_id", "probable_duplicate_match", "missing_value", "normalization", "slam_match_count_signal"} <= set(verdict["categories"])
    built = spark.read.parquet(str(tmp_path / "out/matches"))
    assert built.where("source_ref = 'local:atp/atp_matches_2024.csv#L2'").count() == 1
    assert sinks.content_digest(built) == sinks.content_digest(built.repartition(3)) != sinks.content_digest(built.limit(1))


def test_audit_checks(spark, folder):
    m = catalogue.matches(spark, folder)
    assert audit.missing_values(m, ("round",)).count() == m.where("round is null").count()
    assert audit.issue_table(m).columns == list(audit.ISSUE)
    assert audit.missing_events(m, 2020, 2020).where("slam = 'Wimbledon'").count() == 0


# --- replay ----------------------------------------------------------------------


def test_same_day_is_forecast_from_before(spark):
    got = replayed(spark, [contest("a"), contest("b", w=1, l=3), contest("c", 1)])
    assert got["base", "a", None]["p_overall"] == got["base", "b", None]["p_overall"] == 0.5
    last = got["base", "c", None]
    assert last["p_overall"] > 0.5 and (last["prior_w"], last["prior_l"]) == (2, 1) and last["overall_w"] == 1532


def test_retirement_and_duplicate_policies(spark):
    V = replay.Variant
    rows = [contest("a", is_retirement=True), contest("z", 5)]
    got = replayed(spark, rows, V("full"), V("half", retirement=0.5), V("zero", retirement=0.0), V("strict", skip_retirements=True))
    assert [got[v, "z", None]["overall_w"] for v in ("full", "half", "zero", "strict")] == [1516, 1508, 1500, 1500]
    assert [got[v, "z", None]["prior_w"] for v in ("full", "half", "zero", "strict")] == [1, 1, 1, 0]
    assert ("strict", "a", "retirement_strict_skip") in got
    twins = [contest("a"), contest("b", w=2, l=1), contest("z", 5)]
    got = replayed(spark, twins, V("now"), V("none", duplicates="skip_all"), V("one", duplicates="keep_one"))
    assert [got[v, "z", None]["prior_w"] for v in ("now", "none", "one")] == [2, 0, 1]
    assert ("one", "b", "probable_duplicate_keep_one_excluded") in got


def test_repeated_ids_and_base_exclusions(spark):
    rows = [contest("a"), contest("a"), contest("b", 1), contest("b", 2), contest("c", None), contest("d", w=5, l=5), contest("e", is_walkover=True), contest("f", best_of=1), contest("g", w=None), contest("h", 3, surface="Carpet")]
    got = replayed(spark, rows)
    assert {k[1:] for k in got} >= {("a", "duplicate_match_id"), ("b", None), ("b", "duplicate_match_id"), ("c", "missing_tournament_date"), ("d", "identical_players"), ("e", "walkover"), ("f", "unsupported_format"), ("g", "missing_player_id")}
    assert got["base", "h", None]["p_surface"] is None and got["base", "h", None]["prior_w"] == 1
    long = replay.long_form(replay.replay(spark.createDataFrame(rows, CONTEST)))
    assert long.where("match_id = 'h' and exclusion = 'unsupported_surface'").count() == 2


def test_rank_start_decay_and_conversion(spark):
    V = replay.Variant
    got = replayed(spark, [contest("a", winner_rank=10, loser_rank=100), contest("b", 365, w=1, l=2)], V("r", by_rank=True), V("d", by_rank=True, half_life=365.0), V("f"))
    assert got["r", "a", None]["overall_w"] == pytest.approx(1900) and got["f", "a", None]["overall_w"] == 1500
    after = 1900 + 32 * (1 - 1 / (1 + 10 ** (-1)))
    assert got["r", "b", None]["overall_w"] == pytest.approx(after) and got["d", "b", None]["overall_w"] == pytest.approx(1500 + (after - 1500) / 2)
    two = [contest("a", winner_rank=5, loser_rank=100), contest("b", w=1, l=3, winner_rank=9)]
    assert replayed(spark, two, V("r", by_rank=True))["r", "a", None]["overall_w"] == 1500
    five = replayed(spark, [contest("a", best_of=5, winner_rank=10, loser_rank=100)], V("c", by_rank=True, convert_tour="ATP"), V("n", by_rank=True))
    assert five["c", "a", None]["p_overall"] > five["n", "a", None]["p_overall"]


def test_replay_does_not_depend_on_partitions_or_batches(spark, folder):
    c = contests.contests(spark, folder)
    key = lambda df: sorted((r["match_id"], round(r["p_overall"], 12)) for r in df.where("exclusion is null").select("match_id", "p_overall").collect())
    a = key(replay.replay(c))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        b = key(replay.replay(c.repartition(5)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a == b and len(a) > 100


def test_slam_contests_never_reach_the_selection(spark):
    base = [contest(str(i), i, w=1 + i % 3, l=4 + i % 2, year=1980) for i in range(12)]
    grid = [replay.Variant("x"), replay.Variant("y", k=16.0)]
    losses = lambda rows: sorted(map(tuple, replay.selection(spark.createDataFrame(rows, CONTEST), (1978, 1982), (1983, 1987), grid).collect()))
    assert losses(base) == losses([*base, contest("s", 3, slam="Wimbledon", year=1980)])


# --- observations, metrics, resampling --------------------------------------------

PRED = "match_id string, population string, tour string, slam string, model string, edition_id string, year int, round string, p1 double, p2 double, winner_is_player_1 boolean, exclusion string, is_retirement boolean, is_walkover boolean, format_conflict boolean"


def prediction(id_, p, won, **over):
    row = {"match_id": id_, "population": None, "tour": "ATP", "slam": "Wimbledon", "model": "overall_elo", "edition_id": "2020:w", "year": 2020, "round": "R32", "p1": p, "p2": None if p is None else 1.0 - p, "winner_is_player_1": won, "exclusion": None, "is_retirement": False, "is_walkover": False, "format_conflict": False} | over
    return tuple(row.values())


def observed(spark, *rows):
    return observations.observations(spark.createDataFrame(rows, PRED).drop("population"))


def test_two_underdogs(spark):
    r = metrics.summaries(metrics.cube(observed(spark, prediction("a", 0.2, True), prediction("b", 0.3, False)))).where("population = 'completed_non_retirement'").first()
    assert (r["expected_upsets"], r["actual_upsets"], r["expected_per_100"], r["actual_per_100"], r["excess_per_100"]) == (0.5, 1, 25, 50, 25)
    assert r["standardized_excess"] == pytest.approx(0.5 / math.sqrt(0.37), abs=1e-6)


def test_denominators_and_reasons(spark):
    rows = [prediction("a", 0.2, True), prediction("t", 0.5, True), prediction("m", None, True), prediction("n", float("nan"), True), prediction("s", 0.2, True, p2=0.7), prediction("o", 0.2, None), prediction("r", 0.8, False, is_retirement=True), prediction("x", 0.8, False, exclusion="no_rating;walkover")]
    got = {(r["match_id"], r["population"]): r for r in observed(spark, *rows).collect()}
    first, second = "completed_non_retirement", "retirement_inclusive"
    assert got["t", first]["score_eligible"] and not got["t", first]["upset_eligible"] and got["t", first]["orientation_reason"] == "exact_probability_tie"
    assert [got[i, first]["orientation_reason"] for i in "mnso"] == ["missing_probability", "invalid_probability", "probabilities_do_not_sum_to_one", "missing_outcome"]
    assert got["r", first]["population_exclusion"] == "retirement" and got["r", second]["upset"] == 1 and got["x", second]["population_exclusion"] == "no_rating;walkover"
    counts = {(r["population"], r["reason"]): r["n"] for r in observations.exclusion_counts(observed(spark, *rows)).collect()}
    assert counts[first, "retirement"] == 1 and (second, "retirement") not in counts


def test_rolling_needs_five_editions(spark):
    rows = [prediction(f"{y}{k}", 0.3, k == 0, edition_id=f"{y}:w", year=y) for y in (2017, 2018, 2019, 2021, 2022, 2023) for k in range(2)]
    got = metrics.rolling(metrics.cube(observed(spark, *rows))).where("population = 'completed_non_retirement'").orderBy("first_edition").collect()
    assert [(r["first_edition"], r["last_edition"], r["upset_matches"]) for r in got] == [("2017:w", "2022:w", 10), ("2018:w", "2023:w", 10)]


def test_golden_draws_and_intervals(spark):
    got = [{k: int(v) for k, v in zip("ab", row) if v} for row in resample.draws(2, 5, 7)]
    assert got == [{"a": 2}, {"a": 1, "b": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 1}, {"a": 2}]
    rng = random.Random(7)
    assert [sorted(rng.choices("ab", k=2)) for _ in range(1)] == [["a", "a"]]
    cells = metrics.cube(observed(spark, prediction("a", 0.2, True), prediction("b", 0.3, False)))
    rows = {r["metric"]: r for r in resample.intervals(cells, replicates=50).where("population = 'completed_non_retirement'").collect()}
    assert rows["excess_per_100"]["low"] == rows["excess_per_100"]["high"] == rows["excess_per_100"]["point"] == pytest.approx(25)
    assert resample.interval(np.array([1.0, 2, 4, 8, 16]), 0.95) == pytest.approx((1.1, 15.2))
    assert resample.stable_seed(1, "a", None) == int.from_bytes(__import__("hashlib").sha256(b'[1,"a",null]').digest()[:8], "big")


def test_paired_models_and_contracts(spark):
    rows = [prediction(i, p, True, model=m) for i, a, b in (("a", 0.2, 0.6), ("b", 0.5, 0.4)) for m, p in (("x", a), ("y", b))]
    o = observed(spark, *rows).where("population = 'completed_non_retirement'")
    assert {(r["change"], r["n"]) for r in metrics.identity_changes(o, "x", "y").collect()} == {("flip", 1), ("tie_removed", 1)}
    assert metrics.paired_differences(o, "x", "y").first()["oriented"] == 1
    contracts.check_panel(o, ("x", "y"))
    with pytest.raises(contracts.ContractError):
        contracts.check_panel(o.where("not (match_id = 'a' and model = 'x')"), ("x", "y"))
    with pytest.raises(contracts.ContractError):
        contracts.check_no_identities(o)
    with pytest.raises(contracts.ContractError):
        contracts.check_same_ids(o, o.where("match_id = 'a'"))
    contracts.check_agree(o, o, ["match_id", "model"], "p1")
    with pytest.raises(contracts.ContractError):
        contracts.check_agree(o, o.withColumn("p1", F.col("p1") + 1e-9), ["match_id", "model"], "p1")


# --- market and linkage ------------------------------------------------------------


def test_consensus_hierarchies(spark):
    rows = [("avg", 1.8, 2.2, 1.5, 1.5, 2.0, 2.0), ("books", None, 2.2, 1.5, 1.5, 2.0, 2.0), ("single", 1.0, 2.0, None, None, 2.0, 2.0), ("none", None, None, 1.0, 3.0, None, None), ("one", None, None, 1.4, 3.0, None, None)]
    df = spark.createDataFrame(rows, "match_id string, AvgW double, AvgL double, B365W double, B365L double, PSW double, PSL double")
    df = df.withColumn("pairs", market.book_inventory(df.columns))
    got = {r["match_id"]: r for r in market.consensus(df).collect()}
    assert got["avg"]["p_winner"] == pytest.approx(0.55) and got["avg"]["odds_method"] == "oddsportal_average" and not got["avg"]["suspicious"]
    assert got["books"]["odds_method"] == "bookmaker_consensus" and got["books"]["suspicious"] and got["books"]["anomalous"] == "Bet365" and got["books"]["contributor_fields"] == "Bet365;Pinnacle"
    assert got["single"]["odds_method"] == "single_book" and got["none"]["unavailable_reason"] == "no_complete_price_pair" and got["none"]["p_winner"] is None
    named = {r["match_id"]: r for r in market.consensus(df, market.Policy("n", named_preferred=True)).collect()}
    assert named["avg"]["odds_method"] == "named_book_consensus" and named["one"]["unavailable_reason"] == "named_raw_minimum_not_met_and_avg_unavailable"
    power = {r["match_id"]: r["p_winner"] for r in market.consensus(df, market.Policy("p", "power")).collect()}
    assert power["avg"] == pytest.approx(0.55, abs=0.01) and power["none"] is None
    bad = spark.createDataFrame([("x", 1 / 0.9999, 1e6)], "match_id string, w double, l double").withColumn("pairs", market.inventory(market.pair("Avg", F.col("w"), F.col("l"))))
    assert market.evaluated(bad, "additive").first()["evaluated"][0]["status"] in ("available", "additive_out_of_bounds")


def test_linkage_keeps_ambiguity(spark):
    canonical = [("m1", 1, "Ann Arbor", 2, "Bea Boe"), ("m2", 3, "Cy Coe", 4, "Di Doe"), ("m3", 5, "Ed Eel", 6, "Flo Fox"), ("m4", 7, "Ed Eel", 8, "Flo Fox"), ("m5", 9, "Gus Gill", 10, "Hal Hay")]
    c = spark.createDataFrame([(m, "ATP", 2020, "US Open", "R16", True, a, an, b, bn) for m, a, an, b, bn in canonical], "match_id string, tour string, year int, slam string, round string, winner_is_player_1 boolean, player_1_id long, player_1_name string, player_2_id long, player_2_name string")
    odds = [("o1", "Arbor A.", "Boe B.", "R16"), ("o2", "Coe X.", "Doe D.", "R16"), ("o3", "Eel E.", "Fox F.", "R16"), ("o4", "Arbor A.", "Boe B.", None), ("o5", "Gill G.", "Hay H.", "R16"), ("o6", "Gus Gill", "Hal Hay", "R16"), ("o7", "Boe B.", "Arbor A.", "R16")]
    o = spark.createDataFrame([(i, "ATP", 2020, "US Open", r, w, x) for i, w, x, r in odds], "odds_row_id string, tour string, year int, slam string, round string, odds_winner_name string, odds_loser_name string")
    got = {r["odds_row_id"]: (r["match_status"], r["match_id"]) for r in linkage.linked(o, c).collect()}
    assert got == {"o1": ("matched", "m1"), "o2": ("unmatched", None), "o3": ("ambiguous", None), "o4": ("unmapped_round", None), "o5": ("duplicate_source_match", None), "o6": ("duplicate_source_match", None), "o7": ("unmatched", None)}
    alias = spark.createDataFrame([("atp", 2019, 2021, "Coe X.", 3, "Cy Coe")], "tour string, start_year int, end_year int, odds_name string, canonical_player_id long, canonical_name string")
    got = {r["odds_row_id"]: r["match_status"] for r in linkage.linked(o, c, alias).collect()}
    assert got["o2"] == "matched"
    players = c.select("tour", F.col("player_1_id").alias("player_id"), F.col("player_1_name").alias("name"))
    linkage.check_aliases(alias, players)
    with pytest.raises(linkage.AliasError):
        linkage.check_aliases(alias.withColumn("canonical_player_id", F.lit(99)), players)
    with pytest.raises(linkage.AliasError):
        linkage.expanded_aliases(alias.unionByName(alias))


# --- sources, sinks, plans -----------------------------------------------------------


def test_fetch_locks_and_refuses_drift(tmp_path):
    config = tmp_path / "s.toml"
    config.write_text('[[sources]]\ntour = "ATP"\nrepository = "a/b"\ncommit = "' + "0" * 40 + '"\ntemplate = "atp_matches_{year}.csv"\nfirst_year = 2000\nlast_year = 2002\n')
    specs = fetch.specs(str(config))
    lock, raw_dir = str(tmp_path / "lock.json"), str(tmp_path / "raw")
    assert fetch.fetch(specs, raw_dir, lock, lambda u: u.encode())["new_lock"]
    assert [e["year"] for e in json.loads(open(lock).read())["files"]] == [2000, 2001, 2002]
    (tmp_path / "raw/atp/atp_matches_2001.csv").unlink()
    assert not fetch.fetch(specs, raw_dir, lock, lambda u: u.encode())["new_lock"]
    (tmp_path / "raw/atp/atp_matches_2001.csv").unlink()
    with pytest.raises(files.SourceError):
        fetch.fetch(specs, raw_dir, lock, lambda u: b"drift")
    assert not (tmp_path / "raw/atp/atp_matches_2001.csv").exists()
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return b"ok"

    waits = []
    assert fetch.patient(flaky, sleep=waits.append)("u") == b"ok" and waits == [1.0, 2.0]
    with pytest.raises(FileExistsError):
        fetch.write_once(tmp_path / "lock.json", "x")
    for bad in ("/etc/x", "../x", "a/../../x", ""):
        with pytest.raises(files.SourceError):
            files.safe_path(str(tmp_path), bad)


def test_manifests_and_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "b.xls").write_bytes(b"PK\x03\x04rest")
    assert {r["path"][-6:]: r["ok"] for r in files.workbook_kinds(spark, str(tmp_path)).collect()} == {"a.xlsx": True, "/b.xls": False}
    found = files.digests(spark, str(tmp_path))
    files.verify(found, found)
    with pytest.raises(files.SourceError):
        files.verify(found.limit(1), found)
    assert files.workbook_rows([["A", None], [1], [None, " "], [2, 3]]) == [{"A": 1, "_blank_1": None, "_row": 2}, {"A": 2, "_blank_1": 3, "_row": 4}]
    with pytest.raises(files.SourceError):
        files.workbook_rows([["A", "A"]])


def test_typed_sinks_and_csv(spark, tmp_path):
    df = sinks.typed(spark.createDataFrame([(2, None), (1, True)], "a int, b boolean"), {"a": "bigint", "b": "boolean", "c": "double"})
    sinks.parquet(df, str(tmp_path / "t"), order=["a"])
    assert spark.read.parquet(str(tmp_path / "t")).dtypes == [("a", "bigint"), ("b", "boolean"), ("c", "double")]
    assert sinks.csv_text(df, ["a"]) == "a,b,c\n1,true,\n2,,\n"


def test_publication_order_and_scenarios(spark, folder):
    s = metrics.summaries(catalogue.cells(spark, folder)).where("slam is not null and population = 'completed_non_retirement'")
    rows = publication.figure_data(s, metrics.contrasts(catalogue.cells(spark, folder)).where("population = 'completed_non_retirement'")).collect()
    assert rows[0]["panel"] == "rates" and rows[0]["slam"] == "Australian Open" and rows[0]["model"] == MODELS[0] and rows[-1]["panel"] == "contrast"
    found = scenarios.scenario_summaries(robustness.flagged(spark, folder), scenarios.tags())
    assert found.select("scenario").distinct().count() >= 8


def test_cold_start_counts_only_the_past(spark):
    rows = [contest(str(i), i // 2, w=1, l=2 + i) for i in range(6)]
    df = spark.createDataFrame(rows, CONTEST).withColumns({"winner_entry": F.lit(None).cast("string"), "loser_entry": F.lit("wc")})
    prior = {(r["player_id"], r["event_date"].day): r["prior"] for r in coldstart.prior_counts(coldstart.appearances(df)).collect()}
    assert [prior[1, d] for d in (1, 2, 3)] == [0, 2, 4] and prior[7, 3] == 0


def test_reproduction_runs_in_order(spark):
    seen = []
    steps = {name: (lambda n=name: seen.append(n)) for name in project.ORDER}
    project.reproduce(spark, "", "", steps=steps)
    assert seen == list(project.ORDER)


def test_flagship_and_registry(spark, folder):
    import __spark_entry__ as entry

    assert catalogue.flagship(spark, folder).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.SQL) >= 60


def test_streamed_ratings_follow_the_batch(spark, folder, tmp_path):
    from duelscope.streaming.ratings import follow

    c = contests.event_contests(spark, folder)
    days = [r["event_date"] for r in c.select("event_date").distinct().orderBy("event_date").collect()]
    cut = days[len(days) // 2]
    c.where(F.col("event_date") <= cut).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(c.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = follow(stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        c.where(F.col("event_date") > cut).coalesce(1).write.parquet(str(tmp_path / "in/b"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["match_id"]: r["p_overall"] for r in spark.table("streamed").where("not late").collect()}
    want = {r["match_id"]: r["p_overall"] for r in catalogue.event_replay(spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("query, operator", [("bs02_seeded_intervals", "intervals"), ("bs05_joint_contrast", "joint_contrast"), ("bs06_paired_intervals", "paired_intervals"), ("bs09_rolling_intervals", "rolling_intervals")])
def test_registered_bootstraps_draw_the_published_replicates(spark, folder, monkeypatch, query, operator):
    import inspect

    from duelscope.plans import catalogue, relational  # noqa: F401

    signature, seen = inspect.signature(getattr(resample, operator)), []

    def spy(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        seen.append(bound.arguments["replicates"])
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("population", "tour", "slam", "model", "metric", "editions")) + ", point double, low double, high double")

    monkeypatch.setattr(resample, operator, spy)
    catalogue.QUERIES[query](spark, folder)
    assert seen == [2000]


def test_linkage_meets_by_names_and_not_by_context(spark):
    """Against all pairs of a context, with names that repeat; rows of the same names are one row of the join."""
    first, last = ("Ann", "Bea", "Al", "B"), ("Boe", "Coe", "van Dam", "Boe")
    full = [f"{f} {x}" for f in first for x in last] + ["", None, "Solo"]
    c = [(f"m{i:03d}", "ATP", 2020 + i % 2, "US Open", "R16", i % 3 > 0, i, full[i % len(full)], 1000 + i, full[i * 7 % len(full)]) for i in range(120)]
    o = [(f"o{i:03d}", "ATP", 2020 + i % 2, "US Open", "R16", full[i * 5 % len(full)] if i % 2 else f"{last[i % 4]} {first[i // 4 % 4][0]}.", full[i * 3 % len(full)]) for i in range(90)]
    c = spark.createDataFrame(c, "match_id string, tour string, year int, slam string, round string, winner_is_player_1 boolean, player_1_id long, player_1_name string, player_2_id long, player_2_name string")
    o = spark.createDataFrame(o, "odds_row_id string, tour string, year int, slam string, round string, odds_winner_name string, odds_loser_name string")
    alias = spark.createDataFrame([("atp", 2020, 2021, "Solo", 3, "x"), ("atp", 2020, 2020, "Solo", 1018, "y"), ("atp", 2021, 2021, "Ann Boe", 1003, "z")], "tour string, start_year int, end_year int, odds_name string, canonical_player_id long, canonical_name string")

    def sides(rows, name, out, short):
        return linkage._keyed(rows, name, out, short)

    for given in (None, alias):
        one = F.col("winner_is_player_1")
        all_c = c.select("match_id", "year", *[F.when(one, F.col(f"player_{a}_{x}")).otherwise(F.col(f"player_{b}_{x}")).alias(f"{s}_{x}") for s, a, b in (("cw", 1, 2), ("cl", 2, 1)) for x in ("id", "name")])
        all_c = sides(sides(all_c, "cw_name", "cwk", False), "cl_name", "clk", False).collect()
        all_o = sides(sides(o, "odds_winner_name", "wk", True), "odds_loser_name", "lk", True).collect()
        ids = {(r["alias_key"], r["year"]): r["ids"] for r in linkage.expanded_aliases(given).collect()} if given is not None else {}

        def same(x, y, side):
            own = ids.get((x[f"{side}k"], x["year"]))
            return y[f"c{side}_id"] in own if own else x[f"{side}k"] == y[f"c{side}k"] or bool(set(x[f"{side}k_sig"]) & set(y[f"c{side}k_sig"]))

        want = {x["odds_row_id"]: sum(x["year"] == y["year"] and same(x, y, "w") and same(x, y, "l") for y in all_c) for x in all_o}
        linked = linkage.linked(o, c, given)
        assert {r["odds_row_id"]: r["candidates"] for r in linked.collect()} == want
        assert "token" in linked._jdf.queryExecution().optimizedPlan().toString()
