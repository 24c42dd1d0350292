"""Prices to probabilities: inventories of price pairs, de-margining, consensus policies.

An inventory is an array of structs in order of priority; everything is done in
array functions without leaving the row.  Each method is evaluated once, and a
policy is a projection of what its method gave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import probability as P

#: Contributors in order, with their column prefixes (fixed values).
BOOKS = (("Bet365", "B365"), ("Bet&Win", "B&W"), ("Centrebet", "CB"), ("Expekt", "EX"), ("Gamebookers", "GB"), ("Interwetten", "IW"), ("Ladbrokes", "LB"), ("Pinnacle", "PS"), ("Sportingbet", "SB"), ("Stan James", "SJ"), ("Unibet", "UB"))
#: Overrounds outside are suspicious (fixed values).
LOW, HIGH = 0.9, 1.2
TOLERANCE = 1e-12


@dataclass(frozen=True)
class Policy:
    policy: str
    method: str = "proportional"
    aggregation: str = "mean"
    named_preferred: bool = False
    minimum_named: int = 2


POLICIES = (Policy("primary"), Policy("additive", "additive"), Policy("power", "power"), Policy("median", aggregation="median"), Policy("named", named_preferred=True), Policy("named_additive", "additive", named_preferred=True), Policy("named_power", "power", named_preferred=True))


def pair(name: str, w: Column, l: Column) -> Column:  # noqa: E741
    return F.struct(F.lit(name).alias("contributor"), P.decimal_price(w).alias("w"), P.decimal_price(l).alias("l"))


def inventory(*pairs: Column) -> Column:
    """The average first, then the books in order."""
    return F.array(*pairs)


def book_inventory(columns: list[str]) -> Column:
    """The inventory of a workbook row: AvgW/AvgL and every known book that has columns."""
    have = lambda c: F.col(f"`{c}`") if c in columns else F.lit(None).cast("double")
    return inventory(pair("Avg", have("AvgW"), have("AvgL")), *[pair(name, have(f"{p}W"), have(f"{p}L")) for name, p in BOOKS])


def _fair(method: str):
    """The contributor's struct with p_w, p_l, overround and status by a method."""
    def solved(x: Column) -> Column:
        p = {"power": P.power, "proportional": P.proportional, "additive": lambda w, l: 1.0 / w - (1.0 / w + 1.0 / l - 1.0) / 2.0}[method](x["w"], x["l"])  # noqa: E741
        return F.struct(x["contributor"].alias("contributor"), x["w"].alias("w"), x["l"].alias("l"), p.alias("p"))

    def told(x: Column) -> Column:
        complete, p = x["w"].isNotNull() & x["l"].isNotNull(), x["p"]
        ok = complete & F.coalesce(p.between(0, 1), F.lit(False))
        q = P.proportional(x["l"], x["w"]) if method == "proportional" else 1.0 - p
        status = F.when(~complete, "no_complete_price_pair").when(~ok, "power_nonconvergence" if method == "power" else f"{method}_out_of_bounds").otherwise("available")
        return F.struct(*[x[c].alias(c) for c in ("contributor", "w", "l")], F.when(ok, p).alias("p_w"), F.when(ok, q).alias("p_l"), (1.0 / x["w"] + 1.0 / x["l"]).alias("overround"), status.alias("status"))

    return lambda pairs: F.transform(F.transform(pairs, solved), told).cast(EVALUATED)


EVALUATED = "array<struct<contributor:string,w:double,l:double,p_w:double,p_l:double,overround:double,status:string>>"


def evaluated(rows: DataFrame, method: str, pairs: str = "pairs") -> DataFrame:
    """Adds ``evaluated``: every pair of the inventory by this method."""
    return rows.withColumn("evaluated", _fair(method)(F.col(pairs)))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def _ok(x: Column) -> Column:
    return x["status"] == "available"


def _choice(policy: Policy, named: Column, avg: Column, whole: Column) -> tuple[Column, Column, Column]:
    """(contributors, where they come from, the reason if there are none although a method gave some)."""
    if policy.named_preferred:
        enough, few = F.size(named) >= policy.minimum_named, F.size(F.filter(whole, lambda x: x["contributor"] != "Avg")) < policy.minimum_named
        selected, source = F.when(enough, named).when(F.size(avg) > 0, avg), F.when(enough, "named_book_consensus").when(F.size(avg) > 0, "oddsportal_average_fallback")
        return selected, source, F.when(few, "named_raw_minimum_not_met_and_avg_unavailable").otherwise("named_method_minimum_not_met_and_avg_unavailable")
    selected = F.when(F.size(avg) > 0, avg).when(F.size(named) > 0, named)
    source = F.when(F.size(avg) > 0, "oddsportal_average").when(F.size(named) >= 2, "bookmaker_consensus").when(F.size(named) == 1, "single_book")
    return selected, source, F.lit("avg_unavailable_and_no_valid_named_pair")


def under_policies(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Each row once per policy: one probability with its provenance, or the reason why there is none.  One pass."""
    methods = list(dict.fromkeys(p.method for p in policies))
    out = rows.withColumns({f"__e_{m}": _fair(m)(F.col("pairs")) for m in methods})
    parts = {f"__named_{m}": F.filter(f"__e_{m}", lambda x: _ok(x) & (x["contributor"] != "Avg")) for m in methods} | {f"__avg_{m}": F.filter(f"__e_{m}", lambda x: _ok(x) & (x["contributor"] == "Avg")) for m in methods}
    out = out.withColumns(parts | {"__whole": F.filter(f"__e_{methods[0]}", lambda x: x["w"].isNotNull() & x["l"].isNotNull())})

    def chosen(p: Policy) -> Column:
        named, avg = F.col(f"__named_{p.method}"), F.col(f"__avg_{p.method}")
        selected, source, last = _choice(p, named, avg, F.col("__whole"))
        values = {"policy": F.lit(p.policy), "mean": F.lit(p.aggregation == "mean"), "sel": selected, "odds_method": source, "last": last, "valid_named": F.size(named), "valid": F.size(named) + F.size(avg)}
        return F.struct(*[v.alias(c) for c, v in values.items()])

    out = out.select(*rows.columns, "__whole", F.explode(F.array(*map(chosen, policies))).alias("__of"))
    sel, fair = F.col("__of.sel"), lambda side: F.transform("__of.sel", lambda x: x[side])
    merged = lambda side: F.when(F.col("__of.mean"), _mean(fair(side))).otherwise(_median(fair(side)))
    label = lambda xs: F.array_join(F.transform(xs, lambda x: F.when(x["contributor"] == "Avg", "AvgW/AvgL").otherwise(x["contributor"])), ";")
    odd = F.filter(sel, lambda x: ~x["overround"].between(LOW, HIGH))
    reason = F.when(F.size("__whole") == 0, "no_complete_price_pair").when(F.col("__of.valid") == 0, "all_complete_policy_sources_method_invalid").otherwise(F.col("__of.last"))
    return out.withColumns({
        "policy": F.col("__of.policy"), "p_winner": merged("p_w"), "p_loser": merged("p_l"), "odds_method": F.col("__of.odds_method"),
        "contributors": F.when(sel.isNotNull(), F.size(sel)), "contributor_fields": label(sel),
        "mean_overround": _mean(fair("overround")), "min_overround": F.array_min(fair("overround")), "max_overround": F.array_max(fair("overround")),
        "suspicious": F.size(odd) > 0, "anomalous": label(odd), "unavailable_reason": F.when(sel.isNull(), reason),
        "complete_pairs": F.size("__whole"), "valid_named": F.col("__of.valid_named"),
    }).drop("__of", "__whole")


def policy_means(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy, odds_method, unavailable_reason, n, mean_p): equal inventories are solved once, with their number as weight."""
    equal = rows.groupBy("pairs").agg(F.count("*").alias("__n"))
    priced = F.when(F.col("p_winner").isNotNull(), F.col("__n"))
    return under_policies(equal, policies).groupBy("policy", "odds_method", "unavailable_reason").agg(F.sum("__n").alias("n"), (F.sum(F.col("p_winner") * F.col("__n")) / F.sum(priced)).alias("mean_p"))


def consensus(rows: DataFrame, policy: Policy = POLICIES[0]) -> DataFrame:
    return under_policies(rows, (policy,))


def method_counts(consensual: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key the methods and statuses as JSON with sorted names."""
    per = consensual.groupBy(*keys, F.coalesce("odds_method", F.lit("missing")).alias("m")).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "n"))))).alias("methods"))


def pair_details(rows: DataFrame, methods: tuple[str, ...] = ("proportional", "additive", "power")) -> DataFrame:
    """A row per contest, method and contributor with a complete pair."""
    of = F.array(*[F.struct(F.lit(m).alias("method"), _fair(m)(F.col("pairs")).alias("evaluated")) for m in methods])
    rows = rows.select("match_id", F.explode(of).alias("of")).select("match_id", "of.method", F.explode("of.evaluated").alias("e"))
    return rows.select("match_id", "method", "e.*").where("w is not null and l is not null")


def market_predictions(consensual: DataFrame) -> DataFrame:
    """Consensus rows seen from player 1, shaped like model predictions."""
    one = F.coalesce(F.col("winner_id") <= F.col("loser_id"), F.lit(True))
    p1 = F.when(one, F.col("p_winner")).otherwise(F.col("p_loser"))
    return consensual.withColumns({"model": F.lit("market_odds"), "winner_is_player_1": one, "p1": p1, "p2": 1.0 - p1, "exclusion": F.when(F.col("p_winner").isNull(), "missing_odds").when(F.col("is_walkover"), "walkover"), "edition_id": F.concat_ws(":", F.col("year").cast("string"), "tourney_id")})


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names, for proposals to a reviewer; nothing is matched by it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def proposals(unmatched: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each unmatched name (id, context, name) the most similar candidate (context, other) of its context."""
    pairs = unmatched.join(candidates, "context").withColumn("score", F.round(ratio("name", "other"), 6))
    return pairs.groupBy("id", "name").agg(F.max_by("other", F.struct("score", "other")).alias("proposal"), F.max("score").alias("score"))


#: Candidates of a context that are looked through at once.
CHUNK = 500_000
#: Unmatched contests that share one copy of such a chunk.
BLOCK = 16_384
#: Letters are counted in so many classes at most, which keeps counts of any script small; classes only raise a bound.
CLASSES = 64
#: Similarities of names that a task keeps.
KEPT = 100_000


def _letters(names: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """How often each letter stands in each name."""
    out = np.zeros((len(names), max(alphabet.values(), default=-1) + 1), dtype=np.int32)
    for k, name in enumerate(names):
        for ch in name:
            out[k, alphabet[ch]] += 1
    return out


def best_contest(winner: str, loser: str, candidates: list[tuple[str, str]], letters: tuple, alphabet: dict[str, int]) -> tuple[float, str, int]:
    """(score, proposal, exact scores made) of the candidate with the greatest mean of both names' similarities; the later text wins ties.

    Two names have no more in common than letters, so 2 * common letters over
    their lengths bounds the similarity; candidates are scored from the
    greatest bound down, until none can reach the best score.  ``Candidates``
    does the same without a bound for each candidate.
    """
    bound = np.zeros(len(candidates))
    for name, own in zip((winner, loser), letters):
        known = _letters(["".join(ch for ch in name if ch in alphabet)], alphabet)[0]
        size = len(name) + own.sum(axis=1)
        bound += np.where(size > 0, 2.0 * np.minimum(own, known).sum(axis=1) / np.maximum(size, 1), 1.0) / 2
    best, made = (-1.0, ""), 0
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < best[0] - 1e-12:
            break
        made += 1
        score = (SequenceMatcher(None, winner, candidates[k][0]).ratio() + SequenceMatcher(None, loser, candidates[k][1]).ratio()) / 2
        best = max(best, (score, f"{candidates[k][0]} def. {candidates[k][1]}"))
    return (*best, made)


@lru_cache(maxsize=KEPT)
def _ratio(name: str, other: str) -> float:
    return SequenceMatcher(None, name, other).ratio()


class Candidates:
    """Contests in the order of their winners' and losers' letters.

    Names of the same letters have the same bound, so bounds are made for the
    letters of winners first.  Those that a contest can still gain by, if the
    best of all losers stood beside them, are gone through from the greatest
    bound down; only there are losers bounded, and only the pairs of letters
    that reach the best score so far are scored.
    """

    def __init__(self, winners: pa.Array, losers: pa.Array) -> None:
        coded = pa.concat_arrays([winners, losers]).dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known: dict[str, int] = {}
        signs = np.array([known.setdefault("".join(sorted(name)), len(known)) for name in self.names], dtype=np.int64)
        self.alphabet = {ch: k % CLASSES for k, ch in enumerate(sorted({ch for sign in known for ch in sign}))}
        self.letters, self.lengths = _letters(list(known), self.alphabet), np.array([len(sign) for sign in known])
        w, l = codes[: len(winners)], codes[len(winners) :]  # noqa: E741
        pair = signs[w] * len(known) + signs[l]
        order = np.argsort(pair, kind="stable")
        self.w, self.l = w[order], l[order]
        pairs, self.first = np.unique(pair[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.losers = pairs % len(known)
        self.winners, self.group = np.unique(pairs // len(known), return_index=True)
        self.group = np.append(self.group, len(pairs))
        self.all_losers = np.unique(self.losers)
        self._reach: tuple = (None,)
        self._most: dict[str, float] = {}

    def _bounds(self, name: str, signs: np.ndarray) -> np.ndarray:
        """Twice the common letters over the lengths: no similarity is greater."""
        own = _letters(["".join(ch for ch in name if ch in self.alphabet)], self.alphabet)[0]
        size = len(name) + self.lengths[signs]
        return np.where(size > 0, 2.0 * np.minimum(self.letters[signs], own).sum(axis=1) / np.maximum(size, 1), 1.0)

    def _winners(self, winner: str) -> tuple[np.ndarray, np.ndarray]:
        """Groups of winners from the greatest bound down, and their bounds; kept for the next contest of such a winner."""
        sign = "".join(sorted(winner))
        if self._reach[0] != sign:
            bound = self._bounds(winner, self.winners)
            down = np.argsort(-bound, kind="stable")
            self._reach = sign, down, bound[down]
        return self._reach[1:]

    def _greatest(self, loser: str) -> float:
        """The greatest bound of any loser."""
        sign = "".join(sorted(loser))
        if sign not in self._most:
            self._most[sign] = float(self._bounds(loser, self.all_losers).max())
        return self._most[sign]

    def best(self, winner: str, loser: str) -> tuple[float, str, int]:
        """(score, proposal, exact scores made) as ``best_contest`` gives it."""
        groups, reach = self._winners(winner)
        most = self._greatest(loser)
        best, made, at, step = (-1.0, ""), 0, 0, 1
        while at < len(groups) and (reach[at] + most) / 2 >= best[0] - 1e-12:
            taken = groups[at : at + step]
            sizes = self.group[taken + 1] - self.group[taken]
            pairs = np.repeat(self.group[taken] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            beside = self._bounds(loser, self.losers[pairs])
            bound = (np.repeat(reach[at : at + step], sizes) + beside) / 2
            able = np.flatnonzero(bound >= best[0] - 1e-12)
            for k in able[np.argsort(-bound[able], kind="stable")]:
                if bound[k] < best[0] - 1e-12:
                    break
                for row in range(self.first[pairs[k]], self.first[pairs[k] + 1]):
                    name, other = self.names[self.w[row]], self.names[self.l[row]]
                    first = _ratio(winner, name)
                    if (first + beside[k]) / 2 < best[0] - 1e-12:
                        continue
                    made += 1
                    best = max(best, ((first + _ratio(loser, other)) / 2, f"{name} def. {other}"))
            at, step = at + step, step * 2
        return (*best, made)


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best candidate of each row's contests among its candidates."""
    for batch in batches:
        for k in range(batch.num_rows):
            asked, known = (batch.column(c).slice(k, 1).flatten() for c in ("queries", "candidates"))
            of = Candidates(known.field("winner"), known.field("loser"))
            ids, winners, losers = asked.field("id"), asked.field("winner").to_pylist(), asked.field("loser").to_pylist()
            found: list = [None] * len(winners)
            for n in sorted(range(len(winners)), key=lambda n: (sorted(winners[n]), winners[n])):
                found[n] = of.best(winners[n], losers[n])
            yield pa.RecordBatch.from_arrays([ids, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string())], ["id", "score", "proposal"])


def contest_proposals(unmatched: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, proposal, score): for each unmatched contest (id, context, winner, loser) the most similar candidate (context, winner, loser) of its context.

    For a reviewer only; nothing is matched by it.  Candidates of a context lie
    in chunks and unmatched contests in blocks of a bounded size, so a large
    context is many rows of work, and a chunk is sent once for a block.  Few
    chunks find more than many: what a contest finds early bounds the rest.
    """
    numbered = candidates.select("context", F.struct("winner", "loser").alias("c")).where("c.winner is not null and c.loser is not null").distinct()
    sizes = numbered.groupBy("context").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("c"), F.col("chunks"))
    lists = numbered.join(sizes, "context").groupBy("context", chunk.alias("chunk")).agg(F.collect_list("c").alias("candidates"))
    asked = unmatched.where("winner is not null and loser is not null").select("context", F.struct("id", "winner", "loser").alias("q"))
    many = asked.groupBy("context").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("q"), F.col("blocks"))
    blocks = asked.join(many, "context").groupBy("context", block.alias("block")).agg(F.collect_list("q").alias("queries"))
    pairs = blocks.join(lists, "context")
    kind = unmatched.schema["id"].dataType.simpleString()
    parts = int(unmatched.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number is kept: such rows are small, their work is not
    found = pairs.select("context", "chunk", "block", "queries", "candidates").repartition(parts, "context", "chunk", "block").mapInArrow(_proposed, f"id {kind}, score double, proposal string")
    best = found.groupBy("id").agg(F.max(F.struct("score", "proposal")).alias("best"))
    return best.select("id", "best.proposal", F.round("best.score", 6).alias("score"))


def coverage(consensual: DataFrame) -> DataFrame:
    """Contests, those priced, and counts of methods and reasons as JSON: for all, and by tour and Slam."""
    status = F.coalesce("odds_method", "unavailable_reason", F.lit("missing"))
    cells = F.array(F.struct(F.lit("all").alias("tour"), F.lit("all").alias("slam")), F.struct("tour", "slam"))
    rows = consensual.select(status.alias("status"), F.col("p_winner").isNotNull().alias("ok"), F.explode(cells).alias("c"))
    counts = rows.groupBy("c.tour", "c.slam", "status").agg(F.count("*").alias("n"), F.count_if("ok").alias("available"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(F.lit('"'), x["status"], F.lit('":'), x["n"].cast("string")))
    return counts.groupBy("tour", "slam").agg(F.sum("n").alias("n"), F.sum("available").alias("available"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("statuses"))
