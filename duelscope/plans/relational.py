"""Further queries: projections, joins, set operations, sorts and scalar rating columns, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions import text as X
from ..operators import coldstart, contracts, linkage, market, metrics, normalize, publication, replay, resample
from ..schemas import MODELS, ROUNDS, SLAMS
from ..sources import contests as src
from ..sources import scratch, sinks
from . import drawsql
from .catalogue import ERA, METRICS, OBSERVED, PRICED, SUMMARY, C, cells, matches, observed, priced, query, rounded
from .catalogue import P as FORECASTS

Q = src.table

# --- projections ---------------------------------------------------------------

query("prj02_trim", "select p_partkey, nullif(trim(replace(p_name, substr(p_name, 1, 3), '')), '') as rest from part")(lambda s, d: Q(s, d, "part").select("p_partkey", X.trimmed(F.replace("p_name", F.substring("p_name", 1, 3), F.lit(""))).alias("rest")))
query("prj03_tolerant_int", "select event_id, try_cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k, try_cast(event_type as bigint) as bad from events")(lambda s, d: Q(s, d, "events").select("event_id", X.whole_number(F.regexp_extract("props", "[0-9]+", 0), "bigint").alias("k"), X.whole_number(F.col("event_type"), "bigint").alias("bad")))
query("prj04_compact_date", "select o_orderkey, o_custkey, cast(o_orderdate as date) as day from orders")(lambda s, d: Q(s, d, "orders").select("o_orderkey", "o_custkey", X.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day")))
query("prj07_identity", f"with {C} select match_id, 'id:' || winner_id as by_id, 'name:' || lower(winner_name) as by_name from contests")(lambda s, d: src.contests(s, d).select("match_id", X.identity(F.col("winner_id"), F.col("winner_name")).alias("by_id"), X.identity(F.lit(None).cast("bigint"), F.col("winner_name")).alias("by_name")))
query("prj08_logical_key", f"""with {C} select match_id, sha256(concat_ws(chr(31), 'v1', tour, source_file, tourney_id, strftime(event_date, '%Y-%m-%d'), match_num::varchar, coalesce(round, ''), 'id:' || winner_id, 'id:' || loser_id)) as key from contests""")(
    lambda s, d: matches(s, d).select("match_id", normalize.match_id().alias("key")))
query("prj09_name_key", "select p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) as key from part")(lambda s, d: Q(s, d, "part").select("p_partkey", X.key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("key")))


@query("prj10_slam_by_two_signals", f"""with {C}, k as (select match_id, slam as named, case when match_id % 3 = 0 then 'G' else 'A' end as lv, case when match_id % 5 = 0 then '540' end as sfx from contests),
i as (select *, case when sfx = '540' then 'Wimbledon' end as by_id from k)
select match_id, case when named is not null and by_id is not null and named <> by_id then null when lv = 'G' or (named is not null and by_id is not null) then coalesce(named, by_id) end as slam from i""")
def prj10(s, d):
    c = src.contests(s, d)
    level = F.when(F.pmod("match_id", F.lit(3)) == 0, "G").otherwise("A")
    tid = F.when(F.pmod("match_id", F.lit(5)) == 0, "x-540").otherwise("x-1")
    slam, _ = normalize.slam_decision(F.lit("ATP"), tid, X.key(F.col("tourney_name")), F.col("event_date"), level, F.col("surface"), F.col("year"))
    return c.select("match_id", slam.alias("slam"))


query("prj11_expected_surface", f"with {C} select match_id, case slam when 'Australian Open' then 'Hard' when 'Roland Garros' then 'Clay' when 'Wimbledon' then 'Grass' when 'US Open' then 'Hard' end as surface from contests")(lambda s, d: src.contests(s, d).select("match_id", normalize.expected_surface(F.col("slam"), F.col("year")).alias("surface")))
query("prj12_plausible_dates", f"with {C} select match_id, case slam when 'Australian Open' then m in (1, 12) when 'Roland Garros' then m in (5, 6) when 'Wimbledon' then m in (6, 7) when 'US Open' then m in (8, 9) end as plausible from (select *, month(event_date) as m from contests)")(lambda s, d: src.contests(s, d).select("match_id", normalize.date_plausible(F.col("slam"), F.col("event_date")).alias("plausible")))
query("prj13_base_exclusion", f"with {C} select match_id, case when winner_id = loser_id then 'identical_players' when is_walkover then 'walkover' when (case when slam is not null and best_of in (3, 5) then 3 else best_of end) not in (3, 5) then 'unsupported_format' end as reason from contests")(lambda s, d: src.contests(s, d).select("match_id", replay.base_exclusion().alias("reason")))
query("prj15_orientation", f"with {FORECASTS} select match_id, id_1, id_2, winner_is_player_1 from forecasts where model = 'overall_elo'")(lambda s, d: src.forecasts(s, d).where("model = 'overall_elo'").select("match_id", "id_1", "id_2", "winner_is_player_1"))
query("prj19_population_exclusions", f"with {OBSERVED} select population, coalesce(population_exclusion, 'none') as reasons, count(*) as n from observed group by all")(lambda s, d: observed(s, d).groupBy("population", F.coalesce("population_exclusion", F.lit("none")).alias("reasons")).agg(F.count("*").alias("n")))
query("prj21_edition_and_era", f"with {C} select match_id, year || ':' || tourney_id as edition, {ERA} as era from contests")(lambda s, d: src.contests(s, d).select("match_id", F.concat_ws(":", F.col("year").cast("string"), "tourney_id").alias("edition"), coldstart.era(F.col("year")).alias("era")))
query("prj23_entry_buckets", f"with {C} select coalesce(winner_entry, 'DIRECT_OR_MISSING') as bucket, count(*) as n from contests group by all")(lambda s, d: src.contests(s, d).groupBy(coldstart.entry_bucket(F.col("winner_entry")).alias("bucket")).agg(F.count("*").alias("n")))
query("prj25_usable_prices", f"with {C} select match_id, case when avg_w > 1 then round(avg_w, 9) end as w, case when book_l > 1 then round(book_l, 9) end as l from contests")(lambda s, d: src.contests(s, d).select("match_id", F.round(P.decimal_price(F.col("avg_w")), 9).alias("w"), F.round(P.decimal_price(F.col("book_l")), 9).alias("l")))
query("prj26_price_inventory", f"with {PRICED} select name as contributor, count(*) as n, count(*) filter (complete) as complete, count(*) filter (w is null) as no_winner from fair group by all")(lambda s, d: priced(s, d).select(F.explode("pairs").alias("x")).groupBy("x.contributor").agg(F.count("*").alias("n"), F.count_if(F.col("x.w").isNotNull() & F.col("x.l").isNotNull()).alias("complete"), F.count_if(F.col("x.w").isNull()).alias("no_winner")))
query("prj27_signatures", """with n as (select distinct p_name, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') as w from part)
select p_name, unnest(list_transform(range(1, len(w)), lambda i: list_aggregate(w[i + 1:], 'string_agg', '') || ':' || w[1][1])) as signature from n where len(w) > 1""")(
    lambda s, d: Q(s, d, "part").select("p_name").distinct().select("p_name", F.explode(X.full_name_signatures(F.split(X.key(F.col("p_name")), " "))).alias("signature")))
query("prj30_seed_numbers", f"with {C} select match_id, try_cast(regexp_extract('S' || winner_seed || 'x', '[0-9]+') as int) as seed from contests")(lambda s, d: src.contests(s, d).select("match_id", F.regexp_extract(F.concat(F.lit("S"), "winner_seed", F.lit("x")), "[0-9]+", 0).try_cast("int").alias("seed")))

# --- rating columns --------------------------------------------------------------

query("elo01_expectation", "select c_custkey, round(1 / (1 + pow(10.0::double, (1500 - c_acctbal / 10) / 400)), 9) as p from customer")(lambda s, d: Q(s, d, "customer").select("c_custkey", F.round(P.elo(F.col("c_acctbal") / 10.0, F.lit(1500.0)), 9).alias("p")))
query("elo03_format_conversion", """with p as (select l_orderkey, l_linenumber, l_partkey, 0.02::double + 0.96::double * (l_partkey % 100) / 100 as p from lineitem), q as (select *, 0.5::double - sin(asin(1 - 2 * p) / 3) as q from p)
select l_orderkey, l_linenumber, l_partkey, round(q, 9) as set_p, round(q * q * q * (10 - 15 * q + 6 * q * q), 9) as five from q""")(
    lambda s, d: (lambda p: Q(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(P.set_probability(p), 9).alias("set_p"), F.round(P.best_of_five(P.set_probability(p)), 9).alias("five")))(0.02 + 0.96 * F.pmod("l_partkey", F.lit(100)) / 100))
query("elo05_rank_start", f"with {C} select match_id, round(case when winner_rank > 0 then greatest(900.0::double, least(2200.0::double, 1500 + 400 * log10(100.0::double / winner_rank))) else 1500 end, 6) as rating from contests")(lambda s, d: src.contests(s, d).select("match_id", F.round(P.rank_rating(F.col("winner_rank")), 6).alias("rating")))
query("elo06_decay", "select o_orderkey, o_custkey, round(1500 + (o_totalprice / 100 - 1500) * pow(0.5::double, date_diff('day', cast(o_orderdate as date), date '2002-01-01') / 1825.0::double), 6) as rating from orders")(
    lambda s, d: Q(s, d, "orders").select("o_orderkey", "o_custkey", F.round(P.decayed(F.col("o_totalprice") / 100.0, F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")), F.lit(1825.0)), 6).alias("rating")))
query("elo07_log_loss", f"with {FORECASTS} select match_id, model, round(-ln(greatest(1e-12, least(1 - 1e-12, case when winner_is_player_1 then p1 else 1 - p1 end))), 9) as loss from forecasts")(lambda s, d: src.forecasts(s, d).select("match_id", "model", F.round(P.log_loss(F.col("p1"), F.col("winner_is_player_1").cast("int")), 9).alias("loss")))

# --- joins -----------------------------------------------------------------------

query("j01_left_with_lookup", f"with {C}, i as (select match_id, 'round' as field from contests where round is null) select i.match_id, i.field, c.tour, c.tourney_name from i left join contests c using (match_id)")(
    lambda s, d: src.contests(s, d).where("round is null").select("match_id", F.lit("round").alias("field")).join(src.contests(s, d).select("match_id", "tour", "tourney_name"), "match_id", "left"))
query("j08_pivot_complete_pairs", f"""with {FORECASTS}, wide as (select match_id, max(p1) filter (model = 'overall_elo') as overall, max(p1) filter (model = 'surface_elo') as surface from forecasts where eligible group by match_id)
select match_id, round(overall, 9) as overall, round(surface, 9) as surface from wide where overall is not null and surface is not null""")(
    lambda s, d: src.forecasts(s, d).where("eligible").groupBy("match_id").pivot("model", ["overall_elo", "surface_elo"]).agg(F.first("p1")).where("overall_elo is not null and surface_elo is not null").select("match_id", F.round("overall_elo", 9).alias("overall"), F.round("surface_elo", 9).alias("surface")))
query("j11_exact_pairs", f"with {FORECASTS} select count(*) as compared, 0::bigint as only_a, 0::bigint as only_b, round(max(abs(a.p1 - b.p1)), 9) as gap from forecasts a join forecasts b using (match_id) where a.model = 'overall_elo' and b.model = 'surface_adjusted_elo'")(
    lambda s, d: (lambda f: contracts.largest_gap(f.where("model = 'overall_elo'"), f.where("model = 'surface_adjusted_elo'"), ["match_id"], "p1").withColumn("gap", F.round("gap", 9)))(src.forecasts(s, d)))
query("j13_semi_common_panel", f"with {FORECASTS} select model, count(*) as n from forecasts where match_id in (select match_id from forecasts where eligible group by match_id having count(*) = 3) group by model")(
    lambda s, d: (lambda f: f.join(f.where("eligible").groupBy("match_id").count().where("count = 3").select("match_id"), "match_id", "left_semi").groupBy("model").agg(F.count("*").alias("n")))(src.forecasts(s, d)))
query("j15_anti_flagged", f"with {FORECASTS} select model, count(*) as n, round(sum(p1), 6) as total from forecasts where match_id not in (select match_id from forecasts where least(p1, p2) < 0.05) group by model")(
    lambda s, d: (lambda f: f.join(f.where("least(p1, p2) < 0.05").select("match_id").distinct(), "match_id", "left_anti").groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("p1"), 6).alias("total")))(src.forecasts(s, d)))
query("j16_lookup_with_default", "select c_custkey, coalesce(n, 0) as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")(
    lambda s, d: Q(s, d, "customer").join(Q(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders")))
query("j20_accounting_grid", f"""with {PRICED}, g as (select t.tour, sl.slam, a.priced from (select distinct tour from contests) t, (values ('Australian Open'), ('Roland Garros'), ('Wimbledon'), ('US Open')) sl(slam), (values (true), (false)) a(priced)),
k as (select c.tour, c.slam, x.odds_method is not null as priced, count(*) as n from contests c join consensus x using (match_id) where c.slam is not null group by all)
select g.tour, g.slam, g.priced, coalesce(k.n, 0) as n from g left join k on g.tour = k.tour and g.slam = k.slam and g.priced = k.priced""")(
    lambda s, d: src.contests(s, d).select("tour").distinct().withColumn("slam", F.explode(F.array(*map(F.lit, SLAMS)))).withColumn("priced", F.explode(F.array(F.lit(True), F.lit(False)))).join(
        market.consensus(priced(s, d)).where("slam is not null").groupBy("tour", "slam", F.col("odds_method").isNotNull().alias("priced")).agg(F.count("*").alias("n")), ["tour", "slam", "priced"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


@query("j04_linkage", """with c as (select row_number() over (order by p_partkey) as id, p_name, p_brand, p_size from part), pairs as (
  select a.p_brand, a.p_size, a.id as o, b.id as m from c a join c b on a.p_brand = b.p_brand and a.p_size = b.p_size where a.p_name = b.p_name
     or list_has_any(list_transform(range(1, len(string_split(a.p_name, ' '))), lambda i: list_aggregate(string_split(a.p_name, ' ')[i + 1:], 'string_agg', '') || ':' || a.p_name[1]), list_transform(range(1, len(string_split(b.p_name, ' '))), lambda i: list_aggregate(string_split(b.p_name, ' ')[i + 1:], 'string_agg', '') || ':' || b.p_name[1]))),
f as (select o, count(*) as k, min(m) as m from pairs group by o), st as (select c.id, coalesce(f.k, 0) as candidates, f.m from c left join f on f.o = c.id),
cl as (select m, count(*) as claims from st where candidates = 1 group by m)
select case when candidates = 0 then 'unmatched' when candidates > 1 then 'ambiguous' when claims > 1 then 'duplicate_source_match' else 'matched' end as match_status, count(*) as n, sum(candidates)::bigint as candidates from st left join cl on cl.m = st.m and st.candidates = 1 group by 1""")
def j04(s, d):
    """Parts as contests of equal sides: brand and size are the context, names decide."""
    row = F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string"))
    p = Q(s, d, "part").select(row.alias("id"), F.lower("p_name").alias("name"), "p_brand", "p_size")
    ctx = [F.col("p_brand").alias("tour"), F.col("p_size").alias("year"), F.lit("s").alias("slam"), F.lit("R16").alias("round")]
    odds = p.select(F.col("id").alias("odds_row_id"), *ctx, F.col("name").alias("odds_winner_name"), F.lit("same name").alias("odds_loser_name"))
    canonical = p.select(F.col("id").alias("match_id"), *ctx, F.lit(True).alias("winner_is_player_1"), F.lit(0).cast("bigint").alias("player_1_id"), F.col("name").alias("player_1_name"), F.lit(0).cast("bigint").alias("player_2_id"), F.lit("same name").alias("player_2_name"))
    return linkage.linked(odds, canonical).groupBy("match_status").agg(F.count("*").alias("n"), F.sum("candidates").cast("bigint").alias("candidates"))


# --- sets, sorts, panels -----------------------------------------------------------

query("u02_dimension_union", f"with {C} select 'surface' as dimension, surface as value, count(*) as n from contests group by all union all select 'level', level, count(*) from contests group by all union all select 'all', 'all', count(*) from contests")(
    lambda s, d: src.contests(s, d).select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in (("surface", F.col("surface")), ("level", F.col("level")), ("all", F.lit("all")))])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n")))
query("u05_panel_intersection", f"with {FORECASTS} select match_id from forecasts where eligible and model = 'overall_elo' intersect select match_id from forecasts where eligible and model = 'surface_elo'")(
    lambda s, d: (lambda f: f.where("model = 'overall_elo'").select("match_id").intersect(f.where("model = 'surface_elo'").select("match_id")))(src.forecasts(s, d).where("eligible")))
query("u06_panel_difference", f"with {FORECASTS} select match_id from forecasts where eligible and model = 'overall_elo' except select match_id from forecasts where eligible and model = 'surface_elo'")(
    lambda s, d: (lambda f: f.where("model = 'overall_elo'").select("match_id").subtract(f.where("model = 'surface_elo'").select("match_id")))(src.forecasts(s, d).where("eligible")))
query("u07_distinct_events", f"with {C} select distinct tour, year, tourney_id, slam from contests")(lambda s, d: src.contests(s, d).select("tour", "year", "tourney_id", "slam").distinct())
query("s02_custom_order", f"with {C} select match_id, coalesce(list_position(['R128','R64','R32','R16','QF','SF','F'], round), 8)::int as round_place, coalesce(list_position(['Australian Open','Roland Garros','Wimbledon','US Open'], slam), 5)::int as slam_place from contests")(
    lambda s, d: src.contests(s, d).select("match_id", F.coalesce(publication.place(F.col("round"), ROUNDS), F.lit(8)).cast("int").alias("round_place"), F.coalesce(publication.place(F.col("slam"), SLAMS), F.lit(5)).cast("int").alias("slam_place")))
query("s04_argmin", f"with {OBSERVED}, {SUMMARY} select population, tour, min_by(model || ':' || coalesce(slam, ''), (log_loss_score, brier_score, model || ':' || coalesce(slam, ''))) as best from summaries group by all")(
    lambda s, d: (lambda name: metrics.summaries(cells(s, d)).groupBy("population", "tour").agg(F.min_by(name, F.struct("log_loss_score", "brier_score", name)).alias("best")))(F.concat_ws(":", "model", F.coalesce("slam", F.lit("")))))
query("v01_panel_counts", f"with {FORECASTS}, k as (select match_id, count(*) as n from forecasts where eligible group by 1) select sum(3 - n)::bigint as missing, 0::bigint as extra, 0::bigint as duplicates from k")(lambda s, d: contracts.panel_counts(src.forecasts(s, d).where("eligible"), MODELS))
query("v04_blend_control", f"with {FORECASTS} select count(*) as n, round(max(abs(p1 - 1.0::double / (1.0::double + pow(10.0::double, ((0.75::double * o2 + 0.25::double * s2) - (0.75::double * o1 + 0.25::double * s1)) / 400.0::double)))), 9) as gap from forecasts where model = 'surface_adjusted_elo'")(lambda s, d: (
    lambda f, r: f.select(F.abs(F.col("p1") - P.elo(r(1), r(2))).alias("g")).agg(F.count("*").alias("n"), F.round(F.max("g"), 9).alias("gap")))(src.forecasts(s, d).where("model = 'surface_adjusted_elo'"), lambda k: 0.75 * src.skill(F.col(f"id_{k}")) + 0.25 * src.skill(F.col(f"id_{k}"), F.col("surface"))))
query("a24_policy_coverage", f"""with {PRICED}, p as (select match_id, tour, slam from contests), a as (select c.*, k.odds_method is not null as ok from p c join consensus k using (match_id))
select coalesce(tour, 'all') as tour, coalesce(slam, 'all') as slam, count(*) as n, count(*) filter (ok) as available from (select * replace (coalesce(slam, 'none') as slam) from a) group by grouping sets ((), (tour, slam))""")(
    lambda s, d: market.consensus(priced(s, d)).withColumn("slam", F.coalesce("slam", F.lit("none"))).groupingSets([[], [F.col("tour"), F.col("slam")]], F.col("tour"), F.col("slam")).agg(F.count("*").alias("n"), F.count("odds_method").alias("available")).select(F.coalesce("tour", F.lit("all")).alias("tour"), F.coalesce("slam", F.lit("all")).alias("slam"), "n", "available"))
query("a29_long_run", f"with {OBSERVED}, t as (select population, tour, model, " + ", ".join(f"sum({c}) as {c}" for c in metrics.SUMS) + f", count(distinct case when upset_n > 0 then edition_id end)::bigint as editions from cells group by all) select population, tour, model, editions, {METRICS} from t")(lambda s, d: metrics.summaries(cells(s, d), ("population", "tour", "model")))
query("bs03_quantiles", "select event_type, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.5), 6) as middle, round(quantile_cont(value, 0.975), 6) as high from events group by 1")(lambda s, d: Q(s, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))]))
query("bs09_rolling_intervals", drawsql.rolling_sql(OBSERVED))(lambda s, d: rounded(resample.rolling_intervals(cells(s, d))))
query("mkt08_market_model", f"""with {PRICED}, m as (select c.tour, c.slam, c.match_id, case when c.winner_id <= c.loser_id then k.p_winner else k.p_loser end as p1, c.winner_id <= c.loser_id as one, k.p_winner is null as missing, c.is_walkover from contests c join consensus k using (match_id))
select tour, slam, count(*) as n, count(*) filter (missing) as missing, count(*) filter (not missing and is_walkover) as walkovers, round(avg(p1), 6) as mean_p1 from m group by all""")(
    lambda s, d: market.market_predictions(market.consensus(priced(s, d))).groupBy("tour", "slam").agg(F.count("*").alias("n"), F.count_if(F.col("exclusion") == "missing_odds").alias("missing"), F.count_if(F.col("exclusion") == "walkover").alias("walkovers"), F.round(F.avg("p1"), 6).alias("mean_p1")))
query("mkt11_pair_details", f"""with {PRICED} select match_id, 'proportional' as method, name as contributor, round(p, 9) as p_w, round(margin, 9) as overround from fair where complete
union all select match_id, 'additive', name, round(case when add_p between 0 and 1 then add_p end, 9), round(margin, 9) from fair where complete""")(
    lambda s, d: market.pair_details(priced(s, d), ("proportional", "additive")).select("match_id", "method", "contributor", F.round("p_w", 9).alias("p_w"), F.round("overround", 9).alias("overround")))
query("mkt09_name_proposals")(lambda s, d: market.proposals(Q(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("context"), F.col("p_name").alias("name")), Q(s, d, "part").select(F.col("p_brand").alias("context"), F.col("p_type").alias("other")).distinct()))

def proposed(s, d):
    """Finals whose players are spelled otherwise, against all contests of their Slam and year."""
    path = scratch.folder(s, "slams")
    sinks.parquet(src.contests(s, d).where("slam is not null").select("match_id", F.concat_ws("|", "tour", F.col("year").cast("string"), "slam").alias("context"), "round", "winner_name", "loser_name"), path)
    c = s.read.parquet(path)
    odd = lambda x: F.translate(F.upper(x), "LY", "I")
    return market.contest_proposals(c.where("round = 'F'").select(F.col("match_id").alias("id"), "context", odd("winner_name").alias("winner"), odd("loser_name").alias("loser")), c.select("context", F.upper("winner_name").alias("winner"), F.upper("loser_name").alias("loser")))


query("mkt09_contest_proposals")(proposed)
query("elo23_duplicate_audit", f"""with {C}, b as (select *, case when winner_id = loser_id then 'identical_players' when is_walkover then 'walkover' when (case when slam is not null and best_of in (3, 5) then 3 else best_of end) not in (3, 5) then 'unsupported_format' end as base from contests),
g as (select *, count(*) over (partition by tour, year, event_date, lower(tourney_name), round, least(winner_id, loser_id), greatest(winner_id, loser_id)) > 1 as dup,
  base is null and row_number() over (partition by base is null, tour, year, event_date, lower(tourney_name), round, least(winner_id, loser_id), greatest(winner_id, loser_id) order by source_file, match_id) = 1 as representative from b)
select match_id, tour, year, representative, case when base is not null then 'ineligible:' || base when representative then 'kept' else 'removed' end as decision from g where dup""")(lambda s, d: replay.duplicate_audit(src.contests(s, d)))
query("j22_change_grid", f"""with {OBSERVED}, o as (select *, case when p1 = p2 then 0 when p1 < p2 then 1 else 2 end as u from observed where score_eligible and slam is not null),
k as (select a.population, a.tour, a.slam, case when a.u = 0 then 'tie_removed' when b.u = 0 then 'tie_created' else 'flip' end as change, count(*) as n from o a join o b on a.match_id = b.match_id and a.population = b.population where a.model = 'overall_elo' and b.model = 'surface_elo' and a.u <> b.u group by all),
g as (select distinct population, tour, slam, unnest(['flip', 'tie_created', 'tie_removed']) as change from o)
select g.*, coalesce(k.n, 0) as n from g left join k on g.population = k.population and g.tour = k.tour and g.slam = k.slam and g.change = k.change""")(lambda s, d: metrics.identity_change_grid(observed(s, d), "overall_elo", "surface_elo"))
query("j07_borrowed_metadata", f"""with {PRICED}, {FORECASTS.split(C + ',')[1]}, m as (select match_id, 'market_odds' as model from consensus where p_winner is not null union all select match_id, model from forecasts)
select m.model, count(*) as n, count(f.match_id) as found, count(*) filter (f.format_conflict) as conflicts, count(distinct f.edition_id) as editions from m left join forecasts f on f.match_id = m.match_id and f.model = case when m.model = 'market_odds' then 'overall_elo' else m.model end group by m.model""")(
    lambda s, d: metrics.with_metadata(market.consensus(priced(s, d)).where("p_winner is not null").select("match_id", F.lit("market_odds").alias("model")).unionByName(src.forecasts(s, d).select("match_id", "model")), src.forecasts(s, d), ("format_conflict", "edition_id")).groupBy("model").agg(
        F.count("*").alias("n"), F.count("edition_id").alias("found"), F.count_if("format_conflict").alias("conflicts"), F.count_distinct("edition_id").alias("editions")))
