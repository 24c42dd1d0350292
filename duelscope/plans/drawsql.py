"""The seeded bootstraps as SQL: the same draws, made by a recursive query.

``draws_sql`` expands a table of groups into the multiplicities that CPython's
generator (MT19937, seeded with two 32-bit words) gives ``resample.draws``: how
often each cluster is taken in each replicate.  Values of a replicate are then
weighted sums, as in ``resample``.
"""

from __future__ import annotations

from ..operators.metrics import SUMS
from ..operators.resample import LEVEL, METRICS, PAIRED, REPLICATES, SEED

#: MT19937 and its seeding by an array (fixed values): size, middle word, masks, multipliers and first seed.
SIZE, MIDDLE, UPPER, LOWER, WORD = 624, 397, 0x80000000, 0x7FFFFFFF, 0xFFFFFFFF
MATRIX, TEMPER_B, TEMPER_C = 0x9908B0DF, 0x9D2C5680, 0xEFC60000
FIRST_SEED, GROW, MIX_ONE, MIX_TWO = 19650218, 1812433253, 1664525, 1566083941


def key_sql(*parts: str, base: int = SEED) -> str:
    """SQL of the digest whose first 16 digits are ``resample.stable_seed``; parts are columns of plain text or quoted words."""
    return f"sha256('[{base}' || " + " || ".join(f"',' || coalesce('\"' || {p} || '\"', 'null')" for p in parts) + " || ']')"


def draws_sql(groups: str, replicates: int = REPLICATES) -> str:
    """CTEs that end in ``drawn`` (g, r, pick, times) from a CTE of groups (g, n, key): pick counts from 0, a row for picks that occur."""
    folded = lambda x: f"xor({x}, {x} >> 30)"
    word = lambda at: f"('0x' || substr(key, {at}, 8))::bigint"
    twisted = lambda far, near, after: f"xor({far}, xor((({near} & {UPPER}) | ({after} & {LOWER})) >> 1, ({after} & 1) * {MATRIX}))"
    part = lambda first, last, far: f"list_transform(range({first}, {last + 1}), lambda i: {twisted(far, 's[i]', 's[i + 1]')})"
    lag = SIZE - MIDDLE
    return f"""mt_grown(i, v) as (
  select 0, {FIRST_SEED}::bigint union all select i + 1, ({GROW}::bigint * ({folded('v')}) + i + 1) & {WORD} from mt_grown where i < {SIZE - 1}),
mt_base as materialized (select list(v order by i) as base from mt_grown),
mt_one(g, low, high, step, v, first) as (
  select g, {word(9)}, {word(1)}, -1, base[1], 0::bigint from {groups}, mt_base
  union all
  select g, low, high, step + 1, w, case when step = -1 then w else first end from (
    select m.*, (xor(case when step = {SIZE - 2} then first else base[step + 3] end, ({folded('v')}) * {MIX_ONE}::bigint & {WORD}) + case when step % 2 = 0 then high + 1 else low end) & {WORD} as w from mt_one m, mt_base where step < {SIZE - 1})),
mt_lists as materialized (select g, list(v order by step) as l from mt_one where step >= 0 group by g),
mt_two(g, l, i, v) as (
  select g, l, 1, l[{SIZE}] from mt_lists
  union all
  select g, l, i + 1, (xor(l[i + 1], ({folded('v')}) * {MIX_TWO}::bigint & {WORD}) - case when i = {SIZE - 1} then 1 else i + 1 end) & {WORD} from mt_two where i < {SIZE}),
mt_seeded as materialized (
  select g, n, [{UPPER}::bigint] || list(v order by case when i = {SIZE} then 1 else i end) filter (i > 1) as s from mt_two join {groups} using (g) group by g, n),
mt_blocks(g, n, block, s) as (
  select g, n, 0, s from mt_seeded
  union all
  select g, n, block + 1, a || b || c || [{twisted(f'b[{MIDDLE - lag}]', f's[{SIZE}]', 'a[1]')}] from (
    select *, {part(2 * lag + 1, SIZE - 1, f'b[i - {2 * lag}]')} as c from (
      select *, {part(lag + 1, 2 * lag, f'a[i - {lag}]')} as b from (
        select *, {part(1, lag, f's[i + {MIDDLE}]')} as a from mt_blocks where block * {SIZE // 2} < {replicates} * n)))),
mt_pairs as (select g, n, block, k, s[2 * k + 1] as x, s[2 * k + 2] as y from (select *, unnest(range(0, {SIZE // 2})) as k from mt_blocks where block > 0)),
mt_one_shift as (select * replace (xor(x, x >> 11) as x, xor(y, y >> 11) as y) from mt_pairs),
mt_two_shifts as (select * replace (xor(x, (x << 7) & {TEMPER_B}) as x, xor(y, (y << 7) & {TEMPER_B}) as y) from mt_one_shift),
mt_three_shifts as (select * replace (xor(x, (x << 15) & {TEMPER_C}) as x, xor(y, (y << 15) & {TEMPER_C}) as y) from mt_two_shifts),
mt_words as (select * replace (xor(x, x >> 18) as x, xor(y, y >> 18) as y) from mt_three_shifts),
mt_picks as (
  select g, ((block - 1) * {SIZE // 2} + k) // n as r, floor(((x >> 5) * 67108864 + (y >> 6))::double / 9007199254740992 * n)::int as pick
  from mt_words where (block - 1) * {SIZE // 2} + k < {replicates}::bigint * n),
drawn as materialized (select g, r, pick, count(*) as times from mt_picks group by all)"""


def spans_sql(names: tuple[str, ...], keys: str, sampled: str, points: str | None, extra: str = "", level: float = LEVEL) -> str:
    """The last select: a row per group and metric of ``sampled`` (g and the metrics), its point from ``points``; keys from the CTE ``grouped``."""
    ends = ", ".join(f"round(quantile_cont({m}, {q!r}), 6) as {m}_{e}" for m in names for e, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2)))
    rows = ", ".join("{" + f"'metric': '{m}', 'point': {f'p.{m}' if points else 'null'}, 'low': {m}_low, 'high': {m}_high" + "}" for m in names)
    of = f"select {keys}{extra}, unnest([{rows}]) as m from grouped join (select g, {ends} from {sampled} group by g) using (g)" + (f" join {points} p using (g)" if points else "")
    return f"select {keys}{extra}, m.metric as metric, " + ("round(m.point, 6) as point, " if points else "") + f"m.low as low, m.high as high from ({of})"


#: Metrics of rows of sums, in the order of METRICS.
OF_SUMS = """100 * expected / nullif(upset_n, 0) as expected_per_100, 100 * actual / nullif(upset_n, 0) as actual_per_100, 100 * (actual - expected) / nullif(upset_n, 0) as excess_per_100,
  case when upset_n > 0 and variance > 0 then (actual - expected) / sqrt(variance) end as standardized_excess, brier_sum / nullif(score_n, 0) as brier_score, log_loss_sum / nullif(score_n, 0) as log_loss_score"""
_sums = ", ".join(f"coalesce(sum({c}), 0)::double as {c}" for c in SUMS)
_plain = ", ".join(f"sum({c}) as {c}" for c in SUMS)
_weighted = ", ".join(f"sum(times * {c}) as {c}" for c in SUMS)


def _numbered(keys: str, table: str, key: str, order: str = "edition_id") -> str:
    """CTEs ``grouped`` (keys, g, n, key) and ``placed``, the rows of the table with g and their place."""
    same = " and ".join(f"t.{k} is not distinct from grouped.{k}" for k in keys.split(", "))
    return f"""grouped as materialized (select {keys}, row_number() over () as g, count(distinct {order})::int as n, {key} as key from {table} group by {keys}),
placed as materialized (select t.*, g, dense_rank() over (partition by g order by {order}) - 1 as pick from {table} t join grouped on {same})"""


def intervals_sql(cells: str) -> str:
    keys = "population, tour, slam, model"
    return f"""with recursive {cells}, summed as (select {keys}, edition_id, {_sums} from cells group by all),
{_numbered(keys, 'summed', key_sql('population', 'tour', 'slam', 'model'))},
{draws_sql('grouped')},
sampled as (select g, {OF_SUMS} from (select g, r, {_weighted} from drawn join placed using (g, pick) group by g, r)),
points as (select g, {OF_SUMS} from (select g, {_plain} from placed group by g))
{spans_sql(METRICS, keys, 'sampled', 'points', ', n')}""".replace(f"select {keys}, n, m.metric", f"select {keys}, n as editions, m.metric")


def joint_contrast_sql(cells: str, one: str = "Wimbledon") -> str:
    keys, names = "population, tour, model", METRICS[:3]
    less = ", ".join(f"case when count(*) filter (slam = '{one}') = 1 and max(slams) >= 4 and count({m}) = max(slams) then max({m}) filter (slam = '{one}') - avg({m}) filter (slam <> '{one}') end as {m}" for m in names)
    return f"""with recursive {cells}, summed as (select {keys}, slam, year, {_sums} from cells where slam is not null group by all),
{_numbered(keys, 'summed', key_sql("'contrast'", 'population', 'tour', 'model'), 'year')},
{draws_sql('grouped')},
wide as (select g, count(distinct slam) as slams from placed group by g),
sampled as (select g, r, {less} from (select g, r, slam, {OF_SUMS} from (select g, r, slam, {_weighted} from drawn join placed using (g, pick) group by g, r, slam)) join wide using (g) group by g, r),
points as (select g, {less} from (select g, slam, {OF_SUMS} from (select g, slam, {_plain} from placed group by g, slam)) join wide using (g) group by g)
{spans_sql(names, keys, 'sampled', 'points')}"""


def paired_sql(cells: str, pairs: str) -> str:
    keys, names = "population, tour, slam", ("brier", "log_loss", "excess")
    of = "sum({0}brier) / nullif(sum({0}n), 0) as brier, sum({0}log_loss) / nullif(sum({0}n), 0) as log_loss, 100 * sum({0}excess) / nullif(sum({0}oriented), 0) as excess"
    return f"""with recursive {cells}, {pairs},
summed as (select {keys}, edition_id, count(*)::double as n, count(excess)::double as oriented, coalesce(sum(brier), 0) as brier, coalesce(sum(log_loss), 0) as log_loss, coalesce(sum(excess), 0) as excess from both_models group by all),
{_numbered(keys, 'summed', key_sql("'paired'", 'population', 'tour', 'slam'))},
{draws_sql('grouped')},
sampled as (select g, r, {of.format('times * ')} from drawn join placed using (g, pick) group by g, r),
points as (select g, {of.format('')} from placed group by g)
{spans_sql(names, keys, 'sampled', 'points')}"""


def paired_probability_sql(cells: str, pairs: str) -> str:
    keys = "model, tour, slam"
    of = """100 * sum({0}expected) / nullif(sum({0}pair_n), 0) as expected_per_100, 100 * sum({0}actual) / nullif(sum({0}pair_n), 0) as actual_per_100,
  100 * (sum({0}actual) - sum({0}expected)) / nullif(sum({0}pair_n), 0) as excess_per_100, sum({0}brier) / nullif(sum({0}score_n), 0) as brier_score, sum({0}log_loss) / nullif(sum({0}score_n), 0) as log_loss"""
    return f"""with recursive {cells}, {pairs},
summed as (select {keys}, edition_id, count(*)::double as score_n, count(expected)::double as pair_n, coalesce(sum(brier), 0) as brier, coalesce(sum(log_loss), 0) as log_loss,
  coalesce(sum(expected), 0) as expected, coalesce(sum(actual), 0)::double as actual from pairs group by all),
{_numbered(keys, 'summed', key_sql("'paired_probability'", 'model', 'tour', 'slam'))},
{draws_sql('grouped')},
sampled as (select g, r, {of.format('times * ')} from drawn join placed using (g, pick) group by g, r),
points as (select g, {of.format('')} from placed group by g)
{spans_sql(PAIRED, keys, 'sampled', 'points')}"""


def rolling_sql(cells: str, size: int = 5) -> str:
    keys = "population, tour, slam, model"
    ids = [f"ids[{i + 1}]" for i in range(size)]
    return f"""with recursive {cells}, summed as (select {keys}, year, edition_id, upset_n, expected, actual from (select {keys}, year, edition_id, {_sums} from cells group by all)),
rolled as (select {keys}, list((edition_id, upset_n, expected, actual)) over (partition by {keys} order by year, edition_id rows between {size - 1} preceding and current row) as run from summed),
runs as (select {keys}, list_sort(run) as run, list_transform(list_sort(run), lambda e: e[1]) as ids from rolled where len(run) = {size}),
grouped as materialized (select *, row_number() over () as g, {size} as n, {key_sql('population', 'tour', 'slam', 'model', *ids)} as key from runs),
{draws_sql('grouped')},
placed as (select g, k - 1 as pick, run[k] as e from (select g, run, unnest(range(1, {size + 1})) as k from grouped)),
sampled as (select g, r, 100 * (sum(times * e[4]) - sum(times * e[3])) / nullif(sum(times * e[2]), 0) as value from drawn join placed using (g, pick) group by g, r)
select {keys}, ids[1] as first_edition, ids[{size}] as last_edition, low, high from grouped join (
  select g, round(quantile_cont(value, {(1 - LEVEL) / 2!r}), 6) as low, round(quantile_cont(value, {(1 + LEVEL) / 2!r}), 6) as high from sampled group by g) using (g)"""
