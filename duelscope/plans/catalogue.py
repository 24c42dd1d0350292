"""Queries over the test tables, one or more per operator, each with its SQL for the oracle.

Every query runs over whole tables.  The operators come from ``operators``;
the tables are the contest adapters, which give each operator real variety:
byes, walkovers, retirements, repeated pairings, missing ranks and prices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, coldstart, market, metrics, observations, publication, replay, resample, scenarios
from ..sources import contests as src
from . import drawsql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

C, E, P = src.CONTESTS_SQL, src.EVENTS_SQL, src.FORECASTS_SQL
OBSERVED = P + """,
excluded as (
  select *, list_sort(list_distinct(list_filter([exclusion, case when is_retirement then 'retirement' end, case when is_walkover then 'walkover' end,
    case when format_conflict then 'format_conflict' end], lambda x: x is not null))) as exclusions from forecasts),
populated as (select *, unnest(['completed_non_retirement', 'retirement_inclusive']) as population from excluded),
remaining as (select *, case when population = 'retirement_inclusive' then list_filter(exclusions, lambda x: x <> 'retirement') else exclusions end as reasons from populated),
observed as (
  select *, case when len(reasons) > 0 then array_to_string(reasons, ';') end as population_exclusion, len(reasons) = 0 as score_eligible,
    len(reasons) = 0 and p1 <> p2 as upset_eligible,
    case when len(reasons) = 0 and p1 <> p2 then least(p1, p2) end as p_under, case when len(reasons) = 0 and p1 <> p2 then greatest(p1, p2) end as p_favorite,
    case when len(reasons) = 0 and p1 <> p2 then ((p1 < p2) = winner_is_player_1)::int end as upset,
    case when len(reasons) = 0 then (p1 - winner_is_player_1::int) * (p1 - winner_is_player_1::int) end as brier,
    case when len(reasons) = 0 then -ln(greatest(1e-12, least(1 - 1e-12, case when winner_is_player_1 then p1 else 1 - p1 end))) end as log_loss
  from remaining),
cells as (
  select population, tour, slam, model, edition_id, year, round, sum(score_eligible::int) as score_n, sum(brier) as brier_sum, sum(log_loss) as log_loss_sum,
    sum(upset_eligible::int) as upset_n, sum(p_under) as expected, sum(upset) as actual, sum(p_under * (1 - p_under)) as variance
  from observed where score_eligible group by all)"""

SUMS = "sum(score_n) as score_n, sum(brier_sum) as brier_sum, sum(log_loss_sum) as log_loss_sum, sum(upset_n) as upset_n, sum(expected) as expected, sum(actual) as actual, sum(variance) as variance"
METRICS = """score_n::bigint as score_matches, upset_n::bigint as upset_matches, round(coalesce(expected, 0), 6) as expected_upsets, coalesce(actual, 0)::bigint as actual_upsets,
  round(100.0::double * expected / nullif(upset_n, 0), 6) as expected_per_100, round(100.0::double * actual / nullif(upset_n, 0), 6) as actual_per_100,
  round(100.0::double * (actual - expected) / nullif(upset_n, 0), 6) as excess_per_100, round(case when variance > 0 then (actual - expected) / sqrt(variance) end, 6) as standardized_excess,
  round(brier_sum / nullif(score_n, 0), 6) as brier_score, round(log_loss_sum / nullif(score_n, 0), 6) as log_loss_score"""
BASE = "population, tour, slam, model"
ERA = "case when year <= 1999 then '1988-1999' when year <= 2009 then '2000-2009' when year <= 2019 then '2010-2019' else '2020-2025' end"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def matches(spark: SparkSession, d: str) -> DataFrame:
    """The adapter under the names of the canonical table."""
    c = src.contests(spark, d)
    return c.withColumns({"tourney_date": F.col("event_date"), "tourney_level": F.col("level"), "score": F.when(F.col("is_walkover"), "W/O").when(F.col("is_retirement"), "6-4 RET").otherwise("6-4 6-4"), "source_row_number": F.col("match_id"), "source_ref": F.concat(F.lit("local:"), "source_file")})


def cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cube(observed(spark, d))


def observed(spark: SparkSession, d: str) -> DataFrame:
    return observations.observations(src.forecasts(spark, d))


def rounded(intervals: DataFrame) -> DataFrame:
    """Points and bounds to six decimals; the rest as it is."""
    return intervals.withColumns({c: F.round(c, 6) for c in ("point", "low", "high") if c in intervals.columns})


# --- scans and adapters ------------------------------------------------------

query("src_contest_lines", f"with {C} select * from contests")(src.contests)
query("src_contest_events", f"with {E} select * from event_contests")(src.event_contests)
query("src_forecasts", f"with {P} select match_id, model, p1, p2, exclusion, format_conflict, eligible, edition_id, winner_is_player_1 from forecasts")(
    lambda s, d: src.forecasts(s, d).select("match_id", "model", "p1", "p2", "exclusion", "format_conflict", "eligible", "edition_id", "winner_is_player_1"))


@query("src17_pushed_scan", "select l_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem where l_quantity between 10 and 20 and l_returnflag in ('A', 'N')")
def src17(s, d):
    return src.table(s, d, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


@query("src16_ordered_rows", f"with {C} select match_id, row_number() over (partition by tour order by event_date nulls last, year, tourney_id, match_num nulls last, round nulls last, source_file, match_id)::bigint as place from contests")
def src16(s, d):
    order = [F.col("event_date").asc_nulls_last(), "year", "tourney_id", F.col("match_num").asc_nulls_last(), F.col("round").asc_nulls_last(), "source_file", "match_id"]
    return src.contests(s, d).select("match_id", F.row_number().over(Window.partitionBy("tour").orderBy(*order)).cast("bigint").alias("place"))


# --- aggregations ------------------------------------------------------------

@query("a01_counts_by_surface", f"with {C} select tour, year, level, surface, count(*) as n from contests group by all")
def a01(s, d):
    return src.contests(s, d).groupBy("tour", "year", "level", "surface").agg(F.count("*").alias("n"))


@query("a02_slam_rounds", f"with {C} select tour, slam, year, round, count(*) as n, coalesce(list_position(['R128','R64','R32','R16','QF','SF','F'], round), 8)::int as place from contests where slam is not null group by all")
def a02(s, d):
    return src.contests(s, d).where("slam is not null").groupBy("tour", "slam", "year", "round").agg(F.count("*").alias("n")).withColumn("place", F.coalesce(publication.round_order(F.col("round")), F.lit(8)).cast("int"))


@query("a03_report_groups", f"""with {C} select coalesce(tour, '') as tour, coalesce(level, '') as level, coalesce(slam, '') as slam, count(*) as n, sum(is_walkover::int)::bigint as walkovers, sum(is_retirement::int)::bigint as retirements
  from contests group by grouping sets ((tour), (tour, level), (slam))""")
def a03(s, d):
    c = src.contests(s, d)
    out = c.groupingSets([[F.col("tour")], [F.col("tour"), F.col("level")], [F.col("slam")]], F.col("tour"), F.col("level"), F.col("slam")).agg(F.count("*").alias("n"), F.sum(F.col("is_walkover").cast("int")).alias("walkovers"), F.sum(F.col("is_retirement").cast("int")).alias("retirements"))
    return out.select(*[F.coalesce(x, F.lit("")).alias(x) for x in ("tour", "level", "slam")], "n", "walkovers", "retirements")


query("a04_event_sizes", f"with {C} select tour, year, slam, min(tourney_name) as name, max(draw_size) as draw, count(*) as n from contests where slam is not null group by all")(lambda s, d: audit.event_sizes(matches(s, d)))


@query("a05_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as copies, min(l_partkey) as first_part from lineitem group by all having count(*) > 1")
def a05(s, d):
    return src.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.min("l_partkey").alias("first_part")).where("copies > 1")


query("a06_probable_duplicates", f"""with {C} select tour, year, event_date as tourney_date, lower(tourney_name) as name_key, round, least(winner_id::varchar, loser_id::varchar) as player_1, greatest(winner_id::varchar, loser_id::varchar) as player_2,
  count(*) as copies, count(distinct match_id) as distinct_ids, min(match_id) as match_id from contests group by all having count(*) > 1""")(lambda s, d: audit.probable_duplicates(matches(s, d)))


@query("a07_nested_counts", """with g as (select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all)
  select count(*) as keys, sum(copies - 1)::bigint as surplus, max(copies) as most, count(*) filter (copies > 1) as repeated from g""")
def a07(s, d):
    g = src.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))
    return g.agg(F.count("*").alias("keys"), F.sum(F.col("copies") - 1).alias("surplus"), F.max("copies").alias("most"), F.count_if(F.col("copies") > 1).alias("repeated"))


@query("a08_filtered_counts", f"with {C} select count(*) filter (level = 'G' and slam is null) as unmapped, count(*) filter (round is null or winner_rank is null) as incomplete, count(*) filter (slam is not null and round not in ('QF', 'SF', 'F')) as early from contests")
def a08(s, d):
    return src.contests(s, d).agg(F.count_if(F.expr("level = 'G' and slam is null")).alias("unmapped"), F.count_if(F.expr("round is null or winner_rank is null")).alias("incomplete"), F.count_if(F.expr("slam is not null and round not in ('QF', 'SF', 'F')")).alias("early"))


query("a09_low_years", f"""with {C}, y as (select tour, year, count(*) as n from contests where year between 1988 and 2025 group by all), m as (select tour, quantile_cont(n, 0.5)::double as middle from y where year <> 2020 group by tour)
select tour, year, n, middle, case when year = 2020 then 'info' else 'warning' end as severity from y join m using (tour) where n < 0.65 * middle""")(lambda s, d: audit.low_years(src.contests(s, d)))

APPEAR = C + """,
appearances as (
  select match_id, tour, event_date, year, slam, is_walkover, 'winner' as side, winner_id as player_id, winner_rank as rank, winner_entry as entry from contests
  union all select match_id, tour, event_date, year, slam, is_walkover, 'loser', loser_id, loser_rank, loser_entry from contests),
daily as (select tour, player_id, event_date, count(*) as played from appearances where not is_walkover group by all),
priors as (
  select tour, player_id, event_date, coalesce(sum(played) over (partition by tour, player_id order by event_date rows between unbounded preceding and 1 preceding), 0)::bigint as prior
  from (select distinct tour, player_id, event_date from appearances) left join daily using (tour, player_id, event_date)),
entrants as (
  select a.*, coalesce(p.prior, 0) as prior, coalesce(a.entry, 'DIRECT_OR_MISSING') as bucket, a.rank is null as unranked
  from appearances a left join priors p using (tour, player_id, event_date) where slam is not null),
rollup as (select match_id, tour, slam, year, min(prior) as min_prior, max(prior) as max_prior, bool_or(unranked) as any_unranked from entrants group by all)"""


def limits(column: str) -> str:
    return "count(*) as n, " + ", ".join(f"count(*) filter ({column} < {k}) as under_{k}, round(100.0::double * count(*) filter ({column} < {k}) / count(*), 6) as pct_{k}" for k in coldstart.LIMITS)


query("u01_appearances", f"with {APPEAR} select * from appearances")(lambda s, d: coldstart.appearances(src.contests(s, d)))
query("a13_played_by_date", f"with {APPEAR} select * from daily")(lambda s, d: coldstart.played_by_date(coldstart.appearances(src.contests(s, d))))
query("w04_strict_prior", f"with {APPEAR} select * from priors")(lambda s, d: coldstart.prior_counts(coldstart.appearances(src.contests(s, d))))
query("j03_entrants", f"with {APPEAR} select match_id, side, player_id, prior, bucket, unranked from entrants")(lambda s, d: coldstart.entrants(src.contests(s, d)).select("match_id", "side", "player_id", "prior", "bucket", "unranked"))
query("a12_match_rollup", f"with {APPEAR} select * from rollup")(lambda s, d: coldstart.match_rollup(coldstart.entrants(src.contests(s, d))))
query("a10_cold_start", f"with {APPEAR} select tour, slam, era, year, grouping_id(tour, slam, era, year)::int as gid, {limits('min_prior')} from (select *, {ERA} as era from rollup) group by grouping sets ((), (tour), (tour, slam, era), (tour, slam, year))")(
    lambda s, d: coldstart.match_thresholds(coldstart.match_rollup(coldstart.entrants(src.contests(s, d)))))
query("a11_entrant_thresholds", f"with {APPEAR} select tour, slam, {ERA} as era, bucket, unranked, {limits('prior')} from entrants group by all")(lambda s, d: coldstart.entrant_thresholds(coldstart.entrants(src.contests(s, d))))


@query("a14_prediction_coverage", f"with {P} select model, tour, count(*) as n, count(*) filter (eligible) as eligible, count(*) filter (exclusion = 'walkover') as walkovers, count(*) filter (exclusion = 'unsupported_surface') as unsupported, count(*) filter (p1 > 0.5) as favored from forecasts group by all")
def a14(s, d):
    f = src.forecasts(s, d)
    return f.groupBy("model", "tour").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("exclusion") == "walkover").alias("walkovers"), F.count_if(F.col("exclusion") == "unsupported_surface").alias("unsupported"), F.count_if(F.col("p1") > 0.5).alias("favored"))


DIAG = """select model, tour, dimension, value, count(*) as n, round(avg(pow(p1 - winner_is_player_1::int, 2)), 6) as brier,
  round(avg(-ln(greatest(1e-12, case when winner_is_player_1 then p1 else 1 - p1 end))), 6) as log_loss, round(avg(((p1 > 0.5) = winner_is_player_1)::int), 6) as accuracy
from (select *, 'overall' as dimension, 'all' as value from {0} union all select *, 'surface', coalesce(surface, 'missing') from {0} union all select *, 'format', coalesce(best_of::varchar, 'missing') from {0}
  union all select *, 'year', year::varchar from {0} union all select *, 'round', coalesce(round, 'missing') from {0}) group by all"""
query("a15_heldout_diagnostics", f"with {P}, held as (select * from forecasts where eligible and slam is null) " + DIAG.format("held"))(lambda s, d: metrics.diagnostics(src.forecasts(s, d).where("slam is null")))
query("a16_slam_diagnostics", f"with {P}, held as (select * from forecasts where eligible and slam is not null) " + DIAG.format("held"))(lambda s, d: metrics.diagnostics(src.forecasts(s, d).where("slam is not null")))
query("a17_deciles", f"with {P} select model, least(9, floor(p1 * 10)::int) as decile, count(*) as n, round(avg(p1), 6) as mean_p, round(avg(winner_is_player_1::int), 6) as observed from forecasts where eligible group by all")(lambda s, d: metrics.deciles(src.forecasts(s, d)))
query("prj22_observations", f"with {OBSERVED} select match_id, model, population, population_exclusion, score_eligible, upset_eligible, round(p_under, 9) as p_under, upset, round(brier, 9) as brier, round(log_loss, 9) as log_loss from observed")(
    lambda s, d: observed(s, d).select("match_id", "model", "population", "population_exclusion", "score_eligible", "upset_eligible", F.round("p_under", 9).alias("p_under"), "upset", F.round("brier", 9).alias("brier"), F.round("log_loss", 9).alias("log_loss")))
query("a18_upset_metrics", f"with {OBSERVED}, t as (select {BASE}, {SUMS}, count(distinct case when upset_n > 0 then edition_id end)::bigint as editions from cells group by all) select {BASE}, editions, {METRICS} from t")(lambda s, d: metrics.summaries(cells(s, d)))
query("a19_dimensions", f"""with {OBSERVED}, named as (select * replace (coalesce(round, 'missing') as round, year::varchar as year), {ERA} as era from cells),
t as (select {BASE}, round, era, year, {SUMS}, count(distinct edition_id)::bigint as editions from named group by grouping sets (({BASE}), ({BASE}, round), ({BASE}, era), ({BASE}, year)))
select {BASE}, case when round is not null then 'round' when era is not null then 'era' when year is not null then 'year' else 'all' end as dimension, coalesce(round, era, year, 'all') as value, editions, {METRICS} from t""")(lambda s, d: metrics.dimensions(cells(s, d)))
query("a20_calibration", f"""with {OBSERVED} select {BASE}, case when p_favorite >= 0.9 then 4 when p_favorite >= 0.8 then 3 when p_favorite >= 0.7 then 2 when p_favorite >= 0.6 then 1 else 0 end as bin, count(*) as n, round(avg(p_favorite), 6) as mean_probability, round(avg(1.0::double - upset), 6) as won
from observed where upset_eligible group by all""")(lambda s, d: metrics.calibration(observed(s, d)))
query("a21_exclusions", f"""with {OBSERVED} select population, tour, slam, model, coalesce(population_exclusion, case when not upset_eligible then 'exact_probability_tie' end) as reason, count(*) as n from observed
where population_exclusion is not null or not upset_eligible group by all""")(lambda s, d: observations.exclusion_counts(observed(s, d)))
query("w05_rolling_editions", f"""with {OBSERVED}, e as (select {BASE}, year, edition_id, {SUMS} from cells group by all),
r as (select {BASE}, {', '.join(f'sum({c}) over w as {c}' for c in metrics.SUMS)}, count(*) over w as in_run, first_value(edition_id) over w as first_edition, last_value(edition_id) over w as last_edition
  from e window w as (partition by {BASE} order by year, edition_id rows between 4 preceding and current row))
select {BASE}, first_edition, last_edition, {METRICS} from r where in_run = 5""")(lambda s, d: metrics.rolling(cells(s, d)))
query("w06_latest_editions", f"""with {OBSERVED}, p as (select *, dense_rank() over (partition by tour, slam, model order by year desc, edition_id desc) as place from cells),
t as (select {BASE}, {SUMS}, count(distinct case when upset_n > 0 then edition_id end)::bigint as editions from p where place <= 5 group by {BASE}) select {BASE}, editions, {METRICS} from t""")(lambda s, d: metrics.summaries(metrics.latest_editions(cells(s, d))))
SUMMARY = f"t as (select {BASE}, {SUMS}, count(distinct case when upset_n > 0 then edition_id end)::bigint as editions from cells group by all), summaries as (select {BASE}, editions, {METRICS} from t)"
query("bs05_contrast_points", f"with {OBSERVED}, {SUMMARY} select population, tour, model, " + ", ".join(f"round(case when count({m}) filter (slam <> 'Wimbledon') = 3 then max(case when slam = 'Wimbledon' then {m} end) - avg(case when slam <> 'Wimbledon' then {m} end) end, 6) as {m}" for m in ("expected_per_100", "actual_per_100", "excess_per_100")) + " from summaries where slam is not null group by all")(lambda s, d: metrics.contrasts(cells(s, d)))
query("bs08_influence", f"""with {OBSERVED}, e as (select {BASE}, edition_id, sum(upset_n) as n, sum(expected) as x, sum(actual) as a from cells group by all),
w as (select *, sum(n) over p as tn, sum(x) over p as tx, sum(a) over p as ta from e window p as (partition by {BASE})),
dl as (select *, round(100.0::double * ((ta - a) - (tx - x)) / nullif(tn - n, 0) - 100.0::double * (ta - tx) / nullif(tn, 0), 6) as delta from w)
select {BASE}, max_by(edition_id, (abs(delta), delta, edition_id)) as edition_id, max_by(delta, (abs(delta), delta, edition_id)) as delta from dl where delta is not null group by {BASE}""")(lambda s, d: metrics.influence(cells(s, d)))
query("s03_largest_residuals", f"""with {OBSERVED}, r as (select *, upset - p_under as residual from observed where upset_eligible and upset - p_under > 0),
p as (select *, row_number() over (partition by {BASE} order by residual desc, match_id desc) as place from r)
select {BASE}, round(sum(residual), 6) as positive, round(sum(residual) filter (place <= 1), 6) as top_1, round(sum(residual) filter (place <= 5), 6) as top_5, round(sum(residual) filter (place <= 10), 6) as top_10 from p group by {BASE}""")(lambda s, d: metrics.largest_residuals(observed(s, d)))
PAIRED = f"""both_models as (
  select a.population, a.tour, a.slam, a.edition_id, a.brier - b.brier as brier, a.log_loss - b.log_loss as log_loss,
    case when a.upset is not null and b.upset is not null then (a.upset - a.p_under) - (b.upset - b.p_under) end as excess
  from observed a join observed b on a.match_id = b.match_id and a.population = b.population and a.tour = b.tour and a.slam = b.slam
  where a.model = 'surface_adjusted_elo' and b.model = 'overall_elo' and a.score_eligible and b.score_eligible)"""


@query("j10_paired_models", f"with {OBSERVED}, {PAIRED} select population, tour, slam, edition_id, count(*) as n, count(excess) as oriented, round(sum(brier), 6) as brier, round(sum(log_loss), 6) as log_loss, round(sum(excess), 6) as excess from both_models group by all")
def j10(s, d):
    p = metrics.paired_differences(observed(s, d), "surface_adjusted_elo", "overall_elo")
    return p.select("population", "tour", "slam", "edition_id", "n", "oriented", *[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "excess")])


query("j12_identity_changes", f"""with {OBSERVED}, o as (select *, case when p1 = p2 then 0 when p1 < p2 then 1 else 2 end as u from observed where score_eligible)
select a.population, a.tour, a.slam, case when a.u = 0 then 'tie_removed' when b.u = 0 then 'tie_created' else 'flip' end as change, count(*) as n
from o a join o b on a.match_id = b.match_id and a.population = b.population and a.tour = b.tour and a.slam = b.slam where a.model = 'overall_elo' and b.model = 'surface_adjusted_elo' and a.u <> b.u group by all""")(lambda s, d: metrics.identity_changes(observed(s, d), "overall_elo", "surface_adjusted_elo"))
query("a28_model_agreement", f"""with {OBSERVED}, {SUMMARY} select population, tour, slam, min_by(model, (brier_score, model)) as best_brier, min_by(model, (log_loss_score, model)) as best_log_loss,
count(*) filter (excess_per_100 > 0) as positive, count(*) filter (excess_per_100 < 0) as negative from summaries group by all""")(lambda s, d: metrics.agreement(cells(s, d)))
query("bs_hash_intervals", f"""with {OBSERVED}, e as (select {BASE}, edition_id, sum(upset_n)::double as n, sum(coalesce(expected, 0)) as x, sum(coalesce(actual, 0))::double as a from cells group by all),
g as (select {BASE}, list((n, x, a) order by edition_id) as l, coalesce(population, '') || '|' || coalesce(tour, '') || '|' || coalesce(slam, '') || '|' || coalesce(model, '') as name from e group by {BASE}),
s as (select g.*, r.r, unnest(range(0, len(l))) as slot from g, range(0, 200) r(r)),
dr as (select *, l[(('0x' || substr(md5(name || '|' || r || '|' || slot), 1, 8))::bigint % len(l) + 1)::int] as x from s),
v as (select {BASE}, r, round(100.0::double * (sum(x[3]) - sum(x[2])) / nullif(sum(x[1]), 0), 9) as value from dr group by {BASE}, r)
select {BASE}, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from v group by {BASE}""")(lambda s, d: resample.hash_intervals(cells(s, d)))
query("bs02_seeded_intervals", drawsql.intervals_sql(OBSERVED))(lambda s, d: resample.intervals(cells(s, d)).select(*metrics.BASE, "metric", "editions", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")]))
query("bs05_joint_contrast", drawsql.joint_contrast_sql(OBSERVED))(lambda s, d: rounded(resample.joint_contrast(cells(s, d))))
query("bs06_paired_intervals", drawsql.paired_sql(OBSERVED, PAIRED))(lambda s, d: rounded(resample.paired_intervals(metrics.paired_differences(observed(s, d), "surface_adjusted_elo", "overall_elo"))))

# --- windows, flags, audit ---------------------------------------------------

@query("w01_exact_duplicates", "select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey, l_linenumber) as copies from lineitem")
def w01(s, d):
    return src.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")).alias("copies"))


query("w02_probable_duplicate_flag", f"with {C} select match_id, count(*) over (partition by tour, year, event_date, lower(tourney_name), round, least(winner_id, loser_id), greatest(winner_id, loser_id)) > 1 as flag from contests")(lambda s, d: matches(s, d).select("match_id", audit.probable_duplicate_flag().alias("flag")))


@query("w03_edition_max_seed", f"with {C} select match_id, max(greatest(coalesce(winner_seed::int, 0), coalesce(loser_seed::int, 0))) over (partition by tour, slam, year, tourney_id) as top_seed from contests")
def w03(s, d):
    top = F.greatest(F.coalesce(F.col("winner_seed").cast("int"), F.lit(0)), F.coalesce(F.col("loser_seed").cast("int"), F.lit(0)))
    return src.contests(s, d).select("match_id", F.max(top).over(Window.partitionBy("tour", "slam", "year", "tourney_id")).alias("top_seed"))


query("w07_representatives", f"""with {C}, b as (select *, case when event_date is null then 1 when winner_id = loser_id then 1 when is_walkover then 1 when best_of not in (3, 5) then 1 end is null as ok from contests)
select match_id, ok and row_number() over (partition by ok, tour, year, event_date, lower(tourney_name), round, least(winner_id, loser_id), greatest(winner_id, loser_id) order by source_file, match_id) = 1 as representative from b""")(lambda s, d: replay.prepared(src.contests(s, d)).select("match_id", "representative"))
query("a26_seed_regimes", f"""with {C} select tour, slam, year, tourney_id, max(greatest(coalesce(winner_seed::int, 0), coalesce(loser_seed::int, 0))) as max_seed,
case when max(greatest(coalesce(winner_seed::int, 0), coalesce(loser_seed::int, 0))) > 16 then '32_seeds' when max(greatest(coalesce(winner_seed::int, 0), coalesce(loser_seed::int, 0))) > 0 then '16_seeds' else 'no_seeds' end as regime
from contests where slam is not null group by tour, slam, year, tourney_id""")(lambda s, d: scenarios.seed_regimes(src.contests(s, d)))
query("a25_rank_seed", f"""with {C}, r as (select *, winner_seed::int as ws, loser_seed::int as ls, {ERA} as era from contests where slam is not null and not is_walkover),
x as (select *, 'all' as dimension, 'all' as value from r union all select *, 'era', era from r union all select *, 'round', coalesce(round, 'missing') from r)
select tour, slam, dimension, value, count(*) as matches, count(*) filter (winner_rank is not null and loser_rank is not null) as ranked, count(*) filter (winner_rank > loser_rank) as rank_upsets, count(*) filter (winner_rank = loser_rank) as rank_ties,
count(*) filter (ws is not null or ls is not null) as seeded, count(*) filter (ls is not null and ws is null) as unseeded_beats_seeded, count(*) filter (winner_entry is distinct from loser_entry) as entries_differ from x group by tour, slam, dimension, value""")(lambda s, d: scenarios.rank_seed_descriptive(src.contests(s, d)))
query("v10_missing_values", f"""with {C}, m as (select *, unnest([case when round is null then 'round' end, case when winner_rank is null then 'winner_rank' end, case when loser_rank is null then 'loser_rank' end]) as field from contests)
select match_id, field, 'info' as severity from m where field is not null""")(lambda s, d: audit.missing_values(matches(s, d), ("round", "winner_rank", "loser_rank")).select(F.col("match_id").cast("bigint").alias("match_id"), "field", "severity"))
query("v11_round_gaps", f"""with {C}, e as (select tour, year, slam, max(draw_size) as draw from contests where slam is not null group by all),
x as (select * from (values ('R128', 64), ('R64', 32), ('R32', 16), ('R16', 8), ('QF', 4), ('SF', 2), ('F', 1)) v(round, expected)), a as (select tour, year, slam, round, count(*) as n from contests where slam is not null group by all)
select e.tour, e.year, e.slam, x.round, x.expected, coalesce(a.n, 0) as n from e cross join x left join a on a.tour = e.tour and a.year = e.year and a.slam = e.slam and a.round = x.round where e.draw = 128 and coalesce(a.n, 0) <> x.expected""")(lambda s, d: audit.round_gaps(matches(s, d)).select("tour", "year", "slam", "round", "expected", "n"))
query("v11_size_signals", f"with {C}, e as (select tour, year, slam, min(tourney_name) as name, max(draw_size) as draw, count(*) as n from contests where slam is not null group by all) select *, n < 114 as severe from e where draw = 128 and n <> 127")(lambda s, d: audit.size_signals(matches(s, d)))
query("v11_surface_mismatches", f"""with {C}, m as (select tour, year, slam, surface, count(*) as n, case slam when 'Roland Garros' then 'Clay' when 'Wimbledon' then 'Grass' else 'Hard' end as expected from contests where slam is not null group by all) select * from m where surface <> expected""")(lambda s, d: audit.surface_mismatches(matches(s, d)))
query("v12_missing_events", f"""with {C}, g as (select t.tour, y.y::int as year, sl.slam from (select distinct tour from contests) t, range(1988, 2026) y(y), (values ('Australian Open'), ('Roland Garros'), ('Wimbledon'), ('US Open')) sl(slam))
select g.* from g left join (select distinct tour, year, slam from contests) c on g.tour = c.tour and g.year = c.year and g.slam = c.slam where c.tour is null and not (g.slam = 'Wimbledon' and g.year = 2020)""")(lambda s, d: audit.missing_events(matches(s, d), 1988, 2025).select("tour", "year", "slam"))
query("v09_verdict")(lambda s, d: audit.verdict(matches(s, d)))
query("s05_severity_top", f"""with {C}, m as (select match_id, unnest([case when winner_rank is null then 'winner_rank' end, case when round is null then 'round' end]) as field from contests)
select match_id, field from m where field is not null order by field, match_id limit 100""")(lambda s, d: audit.missing_values(matches(s, d), ("winner_rank", "round")).select(F.col("match_id").cast("bigint").alias("match_id"), "field").orderBy("field", "match_id").limit(100))

# --- market ------------------------------------------------------------------

def priced(s, d):
    return with_prices(src.contests(s, d))


def with_prices(c):
    return c.withColumn("pairs", market.inventory(market.pair("Avg", F.col("avg_w"), F.col("avg_l")), market.pair("Book", F.col("book_w"), F.col("book_l")), market.pair("Third", (F.col("avg_w") + F.col("book_w")) / 2.0, (F.col("avg_l") + F.col("book_l")) / 2.0)))


PRICED = C + """,
pairs as (
  select match_id, tour, slam, year, winner_id, loser_id, is_walkover, tourney_id, round, is_retirement, unnest([('Avg', avg_w, avg_l, 0), ('Book', book_w, book_l, 1), ('Third', (avg_w + book_w) / 2.0::double, (avg_l + book_l) / 2.0::double, 2)]) as x from contests),
flat as (select * exclude (x), x[1] as name, case when x[2] > 1 then x[2] end as w, case when x[3] > 1 then x[3] end as l, x[4] as place from pairs),
fair as (
  select *, w is not null and l is not null as complete, 1 / w + 1 / l as margin, (1 / w) / (1 / w + 1 / l) as p, (1 / l) / (1 / w + 1 / l) as q, 1 / w - (1 / w + 1 / l - 1) / 2 as add_p from flat),
used as (
  select match_id, count(*) filter (complete) as complete_pairs, count(*) filter (complete and name <> 'Avg') as valid_named, count(*) filter (complete and name = 'Avg') as avg_ok from fair group by match_id),
picked as (
  select f.*, u.avg_ok, u.valid_named, u.complete_pairs from fair f join used u using (match_id) where f.complete and (case when u.avg_ok > 0 then f.name = 'Avg' else f.name <> 'Avg' end)),
consensus as (
  select c.match_id, avg(p.p) as p_winner, avg(p.q) as p_loser, count(p.p) as contributors, round(avg(p.margin), 9) as mean_overround, coalesce(bool_or(p.margin < 0.9 or p.margin > 1.2), null) as suspicious,
    string_agg(case when p.name = 'Avg' then 'AvgW/AvgL' else p.name end, ';' order by p.place) as contributor_fields,
    case when max(u.avg_ok) > 0 then 'oddsportal_average' when max(u.valid_named) >= 2 then 'bookmaker_consensus' when max(u.valid_named) = 1 then 'single_book' end as odds_method,
    case when max(u.complete_pairs) = 0 then 'no_complete_price_pair' end as unavailable_reason
  from contests c join used u using (match_id) left join picked p using (match_id) group by c.match_id)"""

query("mkt02_consensus", f"with {PRICED} select match_id, round(p_winner, 9) as p_winner, round(p_loser, 9) as p_loser, nullif(contributors, 0)::int as contributors, mean_overround, suspicious, contributor_fields, odds_method, unavailable_reason from consensus")(
    lambda s, d: market.consensus(priced(s, d)).select("match_id", F.round("p_winner", 9).alias("p_winner"), F.round("p_loser", 9).alias("p_loser"), "contributors", F.round("mean_overround", 9).alias("mean_overround"), "suspicious", "contributor_fields", "odds_method", "unavailable_reason"))
query("mkt04_additive_status", f"""with {PRICED} select match_id, name as contributor, case when not complete then 'no_complete_price_pair' when add_p < 0 or add_p > 1 then 'additive_out_of_bounds' else 'available' end as status,
round(case when complete and add_p between 0 and 1 then add_p end, 9) as p_w from fair""")(lambda s, d: market.evaluated(priced(s, d), "additive").select("match_id", F.explode("evaluated").alias("e")).select("match_id", "e.contributor", "e.status", F.round("e.p_w", 9).alias("p_w")))
query("mkt06_median_named", f"""with {PRICED} select c.match_id, round(case when u.valid_named >= 2 then (select quantile_cont(f.p, 0.5) from fair f where f.match_id = c.match_id and f.complete and f.name <> 'Avg') when u.avg_ok > 0 then a.p end, 9) as p_winner,
case when u.valid_named >= 2 then 'named_book_consensus' when u.avg_ok > 0 then 'oddsportal_average_fallback' end as odds_method from contests c join used u using (match_id) left join fair a on a.match_id = c.match_id and a.name = 'Avg'""")(
    lambda s, d: market.consensus(priced(s, d), market.Policy("x", aggregation="median", named_preferred=True)).select("match_id", F.round("p_winner", 9).alias("p_winner"), "odds_method"))
query("a22_method_audit", f"with {PRICED} select c.tour, c.slam, count(*) as n, count(*) filter (k.odds_method = 'oddsportal_average') as by_average, count(*) filter (k.odds_method is null) as missing, count(*) filter (k.suspicious) as suspicious from contests c join consensus k using (match_id) group by all")(
    lambda s, d: market.consensus(priced(s, d)).groupBy("tour", "slam").agg(F.count("*").alias("n"), F.count_if(F.col("odds_method") == "oddsportal_average").alias("by_average"), F.count_if(F.col("odds_method").isNull()).alias("missing"), F.count_if("suspicious").alias("suspicious")))
query("a23_method_json", f"""with {PRICED}, m as (select c.tour, c.year, coalesce(k.odds_method, 'missing') as m, count(*) as n from contests c join consensus k using (match_id) group by all)
select tour, year, sum(n)::bigint as n, '{{' || string_agg('"' || m || '":' || n, ',' order by m) || '}}' as methods from m group by tour, year""")(lambda s, d: market.method_counts(market.consensus(priced(s, d)), ("tour", "year")))
POLICIES_SQL = PRICED + """,
prices as (select distinct w, l from flat where w is not null and l is not null),
bisect as (
  select w, l, 0.0::double as low, greatest(1.0::double, ln(0.5::double) / ln(greatest(1 / w, 1 / l))) as high, 0 as i from prices
  union all
  select w, l, case when pow(1 / w, (low + high) / 2) + pow(1 / l, (low + high) / 2) > 1 then (low + high) / 2 else low end, case when pow(1 / w, (low + high) / 2) + pow(1 / l, (low + high) / 2) > 1 then high else (low + high) / 2 end, i + 1 from bisect where i < 64),
roots as (select w, l, pow(1 / w, (low + high) / 2) as pw, pow(1 / l, (low + high) / 2) as pl from bisect where i = 64),
by_method as (
  select f.match_id, f.name, f.place, f.complete, m.method, case when not f.complete then null when m.method = 'proportional' then f.p when m.method = 'additive' then case when f.add_p between 0 and 1 then f.add_p end when abs(r.pw + r.pl - 1) <= 1e-12 then r.pw / (r.pw + r.pl) end as p
  from fair f left join roots r on r.w = f.w and r.l = f.l, (values ('proportional'), ('additive'), ('power')) m(method)),
tallied as (
  select match_id, method, count(*) filter (complete) as whole, count(*) filter (complete and name <> 'Avg') as raw_named, count(p) filter (name = 'Avg') as avg_ok, count(p) filter (name <> 'Avg') as named_ok, max(p) filter (name = 'Avg') as avg_p,
    avg(p) filter (name <> 'Avg') as named_mean, quantile_cont(p, 0.5) filter (name <> 'Avg') as named_median from by_method group by match_id, method),
policy_rows as (
  select t.match_id, o.policy, case when o.named and named_ok >= 2 or not o.named and avg_ok = 0 and named_ok > 0 then case when o.how = 'mean' then named_mean else named_median end when avg_ok > 0 then avg_p end as p_winner,
    case when o.named then case when named_ok >= 2 then 'named_book_consensus' when avg_ok > 0 then 'oddsportal_average_fallback' end when avg_ok > 0 then 'oddsportal_average' when named_ok >= 2 then 'bookmaker_consensus' when named_ok = 1 then 'single_book' end as odds_method,
    case when o.named and named_ok >= 2 or avg_ok > 0 or not o.named and named_ok > 0 then null when whole = 0 then 'no_complete_price_pair' when named_ok + avg_ok = 0 then 'all_complete_policy_sources_method_invalid'
      when o.named then case when raw_named < 2 then 'named_raw_minimum_not_met_and_avg_unavailable' else 'named_method_minimum_not_met_and_avg_unavailable' end else 'avg_unavailable_and_no_valid_named_pair' end as unavailable_reason
  from tallied t join (values ('primary', 'proportional', false, 'mean'), ('additive', 'additive', false, 'mean'), ('power', 'power', false, 'mean'), ('median', 'proportional', false, 'median'), ('named', 'proportional', true, 'mean'), ('named_additive', 'additive', true, 'mean'), ('named_power', 'power', true, 'mean')) o(policy, method, named, how) using (method))"""
query("mkt07_policies", f"with recursive {POLICIES_SQL} select policy, odds_method, unavailable_reason, count(*) as n, round(avg(p_winner), 6) as mean_p from policy_rows group by all")(
    lambda s, d: market.policy_means(priced(s, d)).withColumn("mean_p", F.round("mean_p", 6)))
query("mkt05_power_pairs", f"with recursive {POLICIES_SQL} select match_id, name as contributor, case when p is null then 'power_nonconvergence' else 'available' end as status, round(p, 9) as p_w from by_method where complete and method = 'power'")(
    lambda s, d: market.pair_details(priced(s, d), ("power",)).select("match_id", "contributor", "status", F.round("p_w", 9).alias("p_w")))
query("a27_missing_odds", f"""with {PRICED} select c.tour, c.slam, k.odds_method is not null as priced, count(*) as n, count(*) filter (c.is_retirement) as retired, round(avg(c.winner_rank), 6) as mean_rank from contests c join consensus k using (match_id) where c.slam is not null group by all""")(
    lambda s, d: market.consensus(priced(s, d)).where("slam is not null").groupBy("tour", "slam", F.col("odds_method").isNotNull().alias("priced")).agg(F.count("*").alias("n"), F.count_if("is_retirement").alias("retired"), F.round(F.avg("winner_rank"), 6).alias("mean_rank")))

# --- replay ------------------------------------------------------------------

BASIC = [replay.Variant("basic", k=32.0)]


def event_replay(s, d):
    c = src.event_contests(s, d)
    none = {n: F.lit(None).cast(t) for n, t in (("slam", "string"), ("tourney_name", "string"), ("round", "string"), ("winner_rank", "int"), ("loser_rank", "int"))}
    return replay.replay(c.withColumns({**none, "year": F.year("event_date"), "best_of": F.lit(3), "is_walkover": F.lit(False), "is_retirement": F.lit(False), "source_file": F.lit("events")}), BASIC, ("match_id",), ("p_overall", "overall_w", "overall_l"))


query("elo09_event_replay", f"""with recursive {E},
days as (select tour, event_date, row_number() over (partition by tour order by event_date) as k from (select distinct tour, event_date from event_contests)),
games as (select c.*, dd.k from event_contests c join days dd on dd.tour = c.tour and dd.event_date = c.event_date),
people as (select distinct tour, winner_id as id from event_contests union select distinct tour, loser_id from event_contests),
state as (
  select tour, id, 1::bigint as k, 1500.0::double as rating from people
  union all
  select s.tour, s.id, s.k + 1, s.rating + coalesce(ch.delta, 0)
  from state s left join (
    select tour, k, id, sum(delta) as delta from (
      select g.tour, g.k, g.winner_id as id, 32.0::double * (1 - 1 / (1 + pow(10.0::double, (l.rating - w.rating) / 400))) as delta from games g join state w on w.tour = g.tour and w.id = g.winner_id and w.k = g.k join state l on l.tour = g.tour and l.id = g.loser_id and l.k = g.k
      union all
      select g.tour, g.k, g.loser_id, -32.0::double * (1 - 1 / (1 + pow(10.0::double, (l.rating - w.rating) / 400))) from games g join state w on w.tour = g.tour and w.id = g.winner_id and w.k = g.k join state l on l.tour = g.tour and l.id = g.loser_id and l.k = g.k)
    group by all) ch on ch.tour = s.tour and ch.k = s.k and ch.id = s.id
  where s.k <= (select max(k) from days))
select g.match_id, round(w.rating, 6) as rating_w, round(l.rating, 6) as rating_l, round(1 / (1 + pow(10.0::double, (l.rating - w.rating) / 400)), 6) as p
from games g join state w on w.tour = g.tour and w.id = g.winner_id and w.k = g.k join state l on l.tour = g.tour and l.id = g.loser_id and l.k = g.k""")(
    lambda s, d: event_replay(s, d).select("match_id", F.round("overall_w", 6).alias("rating_w"), F.round("overall_l", 6).alias("rating_l"), F.round("p_overall", 6).alias("p")))
POLICY_VARIANTS = [replay.Variant("current"), replay.Variant("half_retirements", retirement=0.5), replay.Variant("no_retirement_delta", retirement=0.0), replay.Variant("strict", skip_retirements=True), replay.Variant("skip_duplicates", duplicates="skip_all"), replay.Variant("keep_one", duplicates="keep_one")]
query("elo11_exclusions", f"""with {C}, b as (select match_id, tour, is_retirement, case when event_date is null then 'missing_tournament_date' when winner_id = loser_id then 'identical_players' when is_walkover then 'walkover'
  when (case when slam is not null and year >= 1988 and best_of in (3, 5) then case when tour = 'ATP' then 5 else 3 end else best_of end) not in (3, 5) then 'unsupported_format' end as base,
  count(*) over (partition by tour, year, event_date, lower(tourney_name), round, least(winner_id, loser_id), greatest(winner_id, loser_id)) > 1 as dup from contests)
select v.variant, tour, coalesce(base, nullif(concat_ws(';', case when v.strict and is_retirement then 'retirement_strict_skip' end, case when v.skip and dup then 'probable_duplicate_skip_all' end), '')) as exclusion, count(*) as n
from b, (values ('current', false, false), ('strict', true, false), ('skip_duplicates', false, true)) v(variant, strict, skip) group by all""")(
    lambda s, d: replay.with_variants(replay.prepared(src.contests(s, d)), [v for v in POLICY_VARIANTS if v.variant in ("current", "strict", "skip_duplicates")]).groupBy("variant", "tour", "exclusion").agg(F.count("*").alias("n")))


@query("elo19_surface_blends", f"""with {P} select match_id, w.w as blend_weight, round(1.0::double / (1.0::double + pow(10.0::double, (((1 - w.w) * o2 + w.w * s2) - ((1 - w.w) * o1 + w.w * s1)) / 400.0::double)), 9) as p
from forecasts, (values (0.0::double), (0.25::double), (0.5::double), (0.75::double), (1.0::double)) w(w) where model = 'overall_elo' and eligible""")
def elo19(s, d):
    f = src.forecasts(s, d).where("model = 'overall_elo' and eligible")
    f = f.withColumns({"overall_w": src.skill(F.col("id_1")), "overall_l": src.skill(F.col("id_2")), "surface_w": src.skill(F.col("id_1"), F.col("surface")), "surface_l": src.skill(F.col("id_2"), F.col("surface"))})
    return scenarios.surface_blends(f).select("match_id", "blend_weight", F.round("p", 9).alias("p"))


# --- publication -------------------------------------------------------------

query("pub01_figure_data", f"""with {OBSERVED}, {SUMMARY}, ct as (select tour, model, """ + ", ".join(f"round(case when count({m}) filter (slam <> 'Wimbledon') = 3 then max(case when slam = 'Wimbledon' then {m} end) - avg(case when slam <> 'Wimbledon' then {m} end) end, 6) as {m}" for m in ("expected_per_100", "excess_per_100")) + """
  from summaries where slam is not null and population = 'completed_non_retirement' group by all), own as (select * from summaries where slam is not null and population = 'completed_non_retirement')
select 'rates' as panel, tour, slam, model, 'expected_per_100' as metric, expected_per_100 as value from own union all select 'rates', tour, slam, model, 'actual_per_100', actual_per_100 from own
union all select 'excess', tour, slam, model, 'excess_per_100', excess_per_100 from own union all select 'contrast', tour, 'contrast', model, 'expected_per_100', expected_per_100 from ct union all select 'contrast', tour, 'contrast', model, 'excess_per_100', excess_per_100 from ct""")(
    lambda s, d: publication.figure_data(metrics.summaries(cells(s, d)).where("slam is not null and population = 'completed_non_retirement'"), metrics.contrasts(cells(s, d)).where("population = 'completed_non_retirement'")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Replayed ratings to upset metrics by tour, Slam and model."""
    predictions = replay.long_form(replay.replay(src.contests(spark, d), None, replay.PREDICTED, replay.FORECASTS))
    predictions = predictions.withColumns({"format_conflict": F.lit(False), "edition_id": F.concat_ws(":", F.col("year").cast("string"), "tourney_id")})
    return metrics.summaries(metrics.cube(observations.observations(predictions)))

