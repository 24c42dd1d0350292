"""Chronological rating replay.

All rules that need no rating are column expressions: exclusions, duplicate
ids, policies, formats.  What is left is one ordered fold per (stream, tour):
rows are dealt out by that key, a slice of dates at a time (``carried``), sorted
by date in the JVM and streamed through a Python worker that keeps the players'
ratings and one date at a time, never a whole history.  Variants that rate the same rows share a
stream: their ratings are columns of one array, their forecasts columns of one
row, which the JVM turns into a row per variant afterwards.

Every contest of a date is forecast from the ratings before that date; the
changes are summed and applied once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import EPS
from . import carried
from .contracts import in_turn

RATED = ("Hard", "Clay", "Grass")
BASE = 1500.0


@dataclass(frozen=True)
class Variant:
    """One set of parameters and policies of a replay."""

    variant: str = "base"
    k: float = 32.0
    by_rank: bool = False
    half_life: float | None = None
    convert_tour: str | None = None
    weight: float = 0.25
    retirement: float = 1.0
    skip_retirements: bool = False
    duplicates: str = "current"


def base_exclusion() -> Column:
    """The first reason why a contest is not rated, or null."""
    c = F.col
    return F.coalesce(
        F.when(c("event_date").isNull(), "missing_tournament_date"),
        F.when(c("winner_id").isNull() | c("loser_id").isNull(), "missing_player_id"),
        F.when(c("winner_id") == c("loser_id"), "identical_players"),
        F.when(c("is_walkover"), "walkover"),
        F.when(~F.coalesce(effective_best_of().isin(3, 5), F.lit(False)), "unsupported_format"),
    )


def effective_best_of(five: str = "ATP") -> Column:
    """Slams from 1988 on are best of five on one tour and of three on the others; else what is recorded."""
    slam = F.col("slam").isNotNull() & (F.col("year") >= 1988)
    return F.when(slam & F.col("best_of").isin(3, 5), F.when(F.col("tour") == five, 5).otherwise(3)).otherwise(F.col("best_of"))


def prepared(contests: DataFrame) -> DataFrame:
    """Contests with base, repeated, duplicate and representative: what the policies look at."""
    same_id, same_day = Window.partitionBy("tour", "match_id"), Window.partitionBy("tour", "match_id", "event_date")
    group = ["tour", "year", "event_date", F.lower("tourney_name"), "round", F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id")]
    rows = contests.withColumn("base", base_exclusion())
    rows = rows.withColumn("repeated", F.col("event_date").isNotNull() & ((F.count("*").over(same_day) > 1) | (F.col("event_date") > F.min("event_date").over(same_id))))
    rows = rows.withColumn("duplicate", F.count("*").over(Window.partitionBy(*group)) > 1)
    place = F.row_number().over(Window.partitionBy(F.col("base").isNull(), *group).orderBy("source_file", "match_id"))
    return rows.withColumn("representative", F.col("base").isNull() & (place == 1))


def with_variants(rows: DataFrame, variants: list[Variant]) -> DataFrame:
    """Every row once per variant, with ``exclusion`` by that variant's policies."""
    lit = lambda v: F.lit(v).cast("double") if v is None else F.lit(v)
    kinds = F.array(*[F.struct(*[(F.lit(v).cast("string") if n in ("variant", "convert_tour", "duplicates") else F.lit(v).cast("double") if n in ("k", "half_life", "weight", "retirement") else lit(v)).alias(n) for n, v in asdict(x).items()]) for x in variants])
    return excluded(rows.withColumn("v", F.explode(kinds)))


def exclusion(skip_retirements: Column, duplicates: Column) -> Column:
    """Why prepared rows are not rated under these policies, or null."""
    skip = F.concat_ws(
        ";",
        F.when(F.col("is_retirement") & skip_retirements, "retirement_strict_skip"),
        F.when(F.col("base").isNull() & F.col("duplicate") & (duplicates == "skip_all"), "probable_duplicate_skip_all"),
        F.when(F.col("base").isNull() & F.col("duplicate") & (duplicates == "keep_one") & ~F.col("representative"), "probable_duplicate_keep_one_excluded"),
    )
    return F.coalesce("base", F.when(F.col("repeated"), "duplicate_match_id"), F.nullif(skip, F.lit("")))


def excluded(rows: DataFrame) -> DataFrame:
    """The rows with ``exclusion`` by the policies of their column ``v``, and its name as ``variant``."""
    return rows.withColumn("exclusion", exclusion(F.col("v.skip_retirements"), F.col("v.duplicates"))).withColumn("variant", F.col("v.variant"))


class Ratings:
    """Players' ratings on one tour, a column per variant; the first index is 0 for overall, 1 to 3 for the rated surfaces."""

    def __init__(self, k, by_rank, half_life, weight):
        self.k, self.half_life, self.weight = (np.atleast_1d(np.asarray(x, dtype=float)) for x in (k, half_life, weight))
        self.by_rank = np.atleast_1d(np.asarray(by_rank, dtype=bool))
        self.index: dict[int, int] = {}
        self.rating = np.full((4, 1024, len(self.k)), np.nan)
        self.last = np.zeros((4, 1024), dtype=np.int64)
        self.count = np.zeros((4, 1024), dtype=np.int64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        out = np.array([self.index.setdefault(p, len(self.index)) for p in ids.tolist()], dtype=np.int64)
        while len(self.index) > self.rating.shape[1]:
            self.rating = np.concatenate([self.rating, np.full_like(self.rating, np.nan)], axis=1)
            self.last, self.count = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.last, self.count))
        return out

    def left(self, players: int = 1024) -> Iterator[bytes]:
        """All that is kept, some players at a time."""
        ids = list(self.index)
        for lo in range(0, len(ids), players):
            hi = min(lo + players, len(ids))
            yield pickle.dumps((ids[lo:hi], *(x[:, lo:hi].copy() for x in (self.rating, self.last, self.count))))

    def take(self, some: bytes) -> None:
        """Go on from what other ratings have left."""
        ids, rating, last, count = pickle.loads(some)  # noqa: S301
        at = self.places(np.array(ids))
        self.rating[:, at], self.last[:, at], self.count[:, at] = rating, last, count

    def prepare(self, kind: int, players: np.ndarray, start: np.ndarray, day: int) -> None:
        """Start those not seen yet; let the others drift back by the days since they last played."""
        r = self.rating[kind, players]
        new = np.isnan(r)
        drifting = ~np.isnan(self.half_life)
        if drifting.any():
            days = np.where(self.count[kind, players] > 0, day - self.last[kind, players], 0)[:, None]
            half = np.where(drifting, self.half_life, 1.0)
            r = np.where((days > 0) & drifting, BASE + (r - BASE) * 0.5 ** (days / half), r)
        self.rating[kind, players] = np.where(new, start, r)

    def starts(self, players: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct players and their starting ratings: by rank only where a date shows exactly one."""
        unique, at = np.unique(players, return_inverse=True)
        low, high = np.full(len(unique), np.inf), np.zeros(len(unique))
        shown = ranks > 0
        np.minimum.at(low, at[shown], ranks[shown])
        np.maximum.at(high, at[shown], ranks[shown])
        one = low == high
        rated = np.clip(BASE + 400.0 * np.log10(100.0 / np.where(one, low, 100.0)), 900.0, 2200.0)
        return unique, np.where(one[:, None] & self.by_rank, rated[:, None], BASE)

    def date(self, day: int, winner: np.ndarray, loser: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], surface: np.ndarray, five: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Forecasts of all contests of a date from the ratings before it; then the update.

        ``five`` and ``share`` and what comes back have a column per variant, counts of prior contests excepted."""
        w, l = self.places(winner), self.places(loser)  # noqa: E741
        players, start = self.starts(np.concatenate([w, l]), np.concatenate(ranks))
        self.prepare(0, players, start, day)
        for s in (1, 2, 3):
            on = np.isin(players, np.concatenate([w[surface == s], l[surface == s]]))
            self.prepare(s, players[on], start[on], day)
        rated = surface > 0
        at = np.where(rated, surface, 0)
        out = {"overall_w": self.rating[0, w], "overall_l": self.rating[0, l]}
        out["surface_w"], out["surface_l"] = (np.where(rated[:, None], self.rating[at, x], np.nan) for x in (w, l))
        out["prior_w"], out["prior_l"] = self.count[0, w], self.count[0, l]
        out["surface_prior_w"], out["surface_prior_l"] = (np.where(rated, self.count[at, x], 0) for x in (w, l))
        blend = [(1 - self.weight) * out[f"overall_{x}"] + self.weight * out[f"surface_{x}"] for x in "wl"]
        out["p_overall"] = chance(out["overall_w"], out["overall_l"], five)
        out["p_surface"] = chance(out["surface_w"], out["surface_l"], five)
        out["p_blend"] = chance(*blend, five)
        for kind in range(4):
            rows = np.arange(len(w)) if kind == 0 else np.flatnonzero(surface == kind)
            change = self.k * (1 - out["p_overall" if kind == 0 else "p_surface"][rows]) * share[rows]
            np.add.at(self.rating[kind], w[rows], change)
            np.subtract.at(self.rating[kind], l[rows], change)
            for x in (w, l):
                np.add.at(self.count[kind], x[rows], 1)
                self.last[kind, x[rows]] = day
        return out


def chance(r1: np.ndarray, r2: np.ndarray, five: np.ndarray) -> np.ndarray:
    """The first side's probability; best-of-three chances convert where ``five`` is set."""
    p = np.clip(1.0 / (1.0 + 10.0 ** ((r2 - r1) / 400.0)), EPS, 1 - EPS)
    q = 0.5 - np.sin(np.arcsin(1 - 2 * p) / 3)
    return np.where(five, np.clip(q**3 * (10 - 15 * q + 6 * q * q), EPS, 1 - EPS), p)


STATE = ("p_overall", "p_surface", "p_blend", "overall_w", "overall_l", "surface_w", "surface_l", "prior_w", "prior_l", "surface_prior_w", "surface_prior_l")


COUNTS = tuple(c for c in STATE if "prior" in c)
FOLDED = ("day", "winner_id", "loser_id", "winner_rank", "loser_rank", "surface_code", "best_of_five", "retired")

#: So many variants share a stream: fewer copies of the rows against fewer tasks.
TOGETHER = 9


def streams(variants: list[Variant], together: int = TOGETHER) -> list[list[Variant]]:
    """Variants that rate the same rows, dealt into streams."""
    by: dict[tuple, list[Variant]] = {}
    for v in variants:
        by.setdefault((v.skip_retirements, v.duplicates), []).append(v)
    return [own[k : k + together] for own in by.values() for k in range(0, len(own), together)]


def folded(dealt: list[list[Variant]], kept: list[str], states: tuple[str, ...], carry: bool = False) -> carried.Fold:
    """Rows sorted by stream, tour and date in; the kept columns with forecasts, numbered by the place of the variant in its stream, out.

    Rows with ratings give what a stream starts from; with ``carry`` such rows
    are given out at its end.  Rows that are not ``shown`` only rate."""
    width = max(map(len, dealt))
    columns = [*kept, *(x for c in states for x in ([c] if c in COUNTS else [f"{c}__{i}" for i in range(width)]))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in _whole_dates(batches):
            for now, rows in batch.groupby(["stream", "tour"], sort=False):
                if now != key:
                    if carry and key is not None:
                        yield from carried.given({"stream": key[0], "tour": key[1]}, columns, ratings.left())
                    key, own, last = now, dealt[now[0]], None
                    ratings = Ratings([v.k for v in own], [v.by_rank for v in own], [np.nan if v.half_life is None else v.half_life for v in own], [v.weight for v in own])
                    converts, after_retirement = np.array([v.convert_tour == now[1] for v in own]), np.array([float(v.retirement) for v in own])
                if (rows := started(rows, ratings)).empty:
                    continue
                day, winner, loser, rank_w, rank_l, surface, five, retired = (rows[c].to_numpy() for c in FOLDED)
                in_turn(day, last)
                last = int(day[-1])
                five = five.astype(bool)[:, None] & converts
                share = np.where(retired.astype(bool)[:, None], after_retirement, 1.0)
                bounds = np.flatnonzero(np.r_[True, day[1:] != day[:-1], True])
                found = [ratings.date(int(day[a]), winner[a:b], loser[a:b], (rank_w[a:b], rank_l[a:b]), surface[a:b], five[a:b], share[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                shown = rows["shown"].to_numpy().astype(bool) if "shown" in rows else np.ones(len(rows), dtype=bool)
                out = {c: rows[c].to_numpy()[shown] for c in kept}
                for c in states:
                    values = np.concatenate([f[c] for f in found])[shown]
                    out |= {c: values} if c in COUNTS else {f"{c}__{i}": values[:, i] if i < len(own) else np.full(len(values), np.nan) for i in range(width)}
                yield pd.DataFrame({**out, carried.RATINGS: None})
        if carry and key is not None:
            yield from carried.given({"stream": key[0], "tour": key[1]}, columns, ratings.left())

    return run


def started(rows: pd.DataFrame, ratings: Ratings) -> pd.DataFrame:
    """The contests among the rows, after the ratings among them are taken."""
    if carried.RATINGS not in rows:
        return rows
    left = rows[carried.RATINGS].notna()
    for some in rows.loc[left, carried.RATINGS]:
        ratings.take(some)
    return rows[~left] if left.any() else rows


def _whole_dates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in pieces that never cut a date."""
    held: list[pd.DataFrame] = []
    by = ["stream", "tour", "day"]
    for batch in batches:
        if batch.empty:
            continue
        last = tuple(batch[by].iloc[-1])
        tail = (batch[by] == last).all(axis=1).to_numpy()
        cut = len(batch) - int(np.argmin(tail[::-1])) if not tail.all() else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]]) if held else batch.iloc[:cut]
            held = [batch.iloc[cut:]]
        elif held and tuple(held[-1][by].iloc[-1]) != last:
            yield pd.concat(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held)


def _dealt(contests: DataFrame, dealt: list[list[Variant]]) -> DataFrame:
    """Contests with what the fold needs and ``exclusions``, one for each stream."""
    code = F.when(F.col("surface") == "Hard", 1).when(F.col("surface") == "Clay", 2).when(F.col("surface") == "Grass", 3).otherwise(0)
    rows = prepared(contests).withColumns({
        "surface_code": code, "day": F.unix_date("event_date"), "best_of_five": F.coalesce(effective_best_of(five="ATP") == 5, F.lit(False)), "retired": F.coalesce("is_retirement", F.lit(False)),
        "exclusions": F.array(*[exclusion(F.lit(own[0].skip_retirements), F.lit(own[0].duplicates)) for own in dealt]),
    })
    return rows.drop("base", "repeated", "representative")


def _forecast(rows: DataFrame, dealt: list[list[Variant]], kept: list[str], states: tuple[str, ...], where: str = "true") -> DataFrame:
    """The kept columns of the rated rows, once per variant, with the states."""
    ranks = [F.coalesce(c, F.lit(0)).cast("int").alias(f"__{c}") for c in ("winner_rank", "loser_rank")]
    numbers = F.sequence(F.lit(0), F.lit(len(dealt) - 1))
    needed = [c for c in dict.fromkeys([*kept, "tour", "match_id", *FOLDED]) if c not in ("stream", "exclusion", "winner_rank", "loser_rank")]
    rated = rows.select(*needed, *ranks, F.expr(f"coalesce({where}, false)").alias("shown"), F.filter(numbers, lambda k: F.get("exclusions", k).isNull()).alias("streams")).where("size(streams) > 0")
    rated = rated.withColumnsRenamed({f"__{c}": c for c in ("winner_rank", "loser_rank")})
    passed = [c for c in dict.fromkeys([*kept, "tour", "stream"]) if c != "exclusion"]
    width = max(map(len, dealt))
    types = {f.name: f.dataType.simpleString() for f in rated.schema} | {"stream": "int"}
    numbered = [f"{c} bigint" if c in COUNTS else ", ".join(f"{c}__{i} double" for i in range(width)) for c in states]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in passed), *numbered])
    each = lambda df: df.withColumn("stream", F.explode("streams")).drop("streams")
    forecast = carried.forecasts(rated, ["stream", "tour"], lambda carry: folded(dealt, passed, states, carry), schema, each)
    whole = lambda c: F.when(~F.isnan(c), F.col(c))
    told = F.array(*[F.struct(F.lit(i).alias("place"), *[whole(f"{c}__{i}").alias(c) for c in states if c not in COUNTS]) for i in range(width)])
    names = F.get(_names(dealt), F.col("stream"))
    out = forecast.withColumn("of", F.explode(F.slice(told, 1, F.size(names))))
    shown = [F.nullif(F.col(c), F.lit(0)).alias(c) if c in ("winner_rank", "loser_rank") else F.lit(None).cast("string").alias(c) if c == "exclusion" else F.col(c) for c in kept]
    return out.select(*shown, F.get(names, F.col("of.place")).alias("variant"), *[F.col(c) if c in COUNTS else F.col(f"of.{c}") for c in states])


def _names(dealt: list[list[Variant]]) -> Column:
    return F.array(*[F.array(*[F.lit(v.variant) for v in own]) for own in dealt])


#: What the long form of predictions and their observations read.
PREDICTED = ("match_id", "tour", "slam", "year", "tourney_id", "event_date", "round", "best_of", "winner_id", "loser_id", "is_retirement", "is_walkover")
FORECASTS = tuple(c for c in STATE if c.startswith("p_") or c in COUNTS)


def replay(contests: DataFrame, variants: list[Variant] | None = None, kept: tuple[str, ...] | None = None, states: tuple[str, ...] = STATE, where: str = "true", unrated: bool = True) -> DataFrame:
    """Contests once per variant, with exclusion and, where rated, forecasts of the winner and prior state.

    kept: the columns of contests that are wanted, all by default; the fewer
    they and the states are, the less goes through the fold.  where: the
    contests that are wanted; all of them rate.  unrated: whether those that
    are not rated are wanted, too.
    """
    dealt = streams(variants or [Variant()])
    rows = _dealt(contests, dealt)
    named = list(kept) if kept is not None else [c for c in rows.columns if c not in ("surface_code", "day", "best_of_five", "retired", "exclusions")]
    named = [*named, "exclusion"]
    if not unrated:
        return _forecast(rows, dealt, named, states, where)
    left_out = rows.where(where).withColumn("stream", F.explode(F.sequence(F.lit(0), F.lit(len(dealt) - 1)))).withColumn("exclusion", F.get("exclusions", F.col("stream"))).where("exclusion is not null")
    left_out = left_out.select(*named, F.explode(F.get(_names(dealt), F.col("stream"))).alias("variant"))
    return _forecast(rows, dealt, named, states, where).unionByName(left_out, allowMissingColumns=True)


def long_form(replayed: DataFrame) -> DataFrame:
    """A row per model, seen from player 1 (the smaller id; the winner where an id is missing)."""
    one = F.coalesce(F.col("winner_id") <= F.col("loser_id"), F.lit(True))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(p).alias("p"), F.lit(surface).alias("on_surface")) for m, p, surface in (("overall_elo", "p_overall", False), ("surface_elo", "p_surface", True), ("surface_adjusted_elo", "p_blend", True))])
    rows = replayed.withColumn("winner_is_player_1", one).withColumn("of", F.explode(models))
    unsupported = F.col("exclusion").isNull() & F.col("of.p").isNull()
    p1 = F.when(one, F.col("of.p")).otherwise(1.0 - F.col("of.p"))
    rows = rows.withColumns({"model": F.col("of.model"), "p1": p1, "p2": 1.0 - p1, "exclusion": F.when(unsupported, "unsupported_surface").otherwise(F.col("exclusion"))})
    least = F.least("prior_w", "prior_l")
    return rows.withColumns({"eligible": F.col("exclusion").isNull(), "cold_start": least < 20, "no_surface_history": F.least("surface_prior_w", "surface_prior_l") == 0}).drop("of")


#: The candidates of the selection (fixed values).
GRID = [Variant(f"k{k:g}-{'rank' if r else 'fixed'}-{h or 'none'}-{'convert' if c else 'plain'}", k=k, by_rank=r, half_life=h, convert_tour="ATP" if c else None) for k in (16.0, 24.0, 32.0) for r in (False, True) for h in (None, 730.0, 1825.0) for c in (False, True)]


def selection(contests: DataFrame, first: tuple[int, int], second: tuple[int, int], variants: list[Variant] | None = None, model: str = "p_overall") -> DataFrame:
    """Losses of every candidate per tour and window of years; Slam contests neither rate nor count."""
    dealt = streams(variants or GRID)
    wanted = f"year between {first[0]} and {first[1]} or year between {second[0]} and {second[1]}"
    rows = _forecast(_dealt(contests.where("slam is null"), dealt), dealt, ["tour", "year"], (model,), wanted)
    window = F.when(F.col("year").between(*first), "first").when(F.col("year").between(*second), "second")
    p = F.greatest(F.lit(EPS), F.col(model))
    return rows.withColumn("window", window).where("window is not null and " + model + " is not null").groupBy("variant", "tour", "window").agg(
        F.count("*").alias("n"), F.avg((1.0 - F.col(model)) ** 2).alias("brier"), F.avg(-F.log(p)).alias("log_loss"))


def best_of_selection(losses: DataFrame) -> DataFrame:
    """Per tour the candidate of least log loss, then Brier score, then name, over both windows together."""
    return least_loss(losses, "tour")


def least_loss(losses: DataFrame, *by: str) -> DataFrame:
    """(by, variant, log_loss): the candidate of least log loss, then Brier score, to 12 digits, then name."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 12).alias(c)
    total = losses.groupBy("variant", *by).agg(mean("log_loss"), mean("brier"))
    return total.groupBy(*by).agg(F.min_by("variant", F.struct("log_loss", "brier", "variant")).alias("variant"), F.min("log_loss").alias("log_loss"))


def duplicate_audit(contests: DataFrame) -> DataFrame:
    """Every contest of a probable-duplicate group with what keeping one means for it."""
    rows = prepared(contests).where("duplicate")
    decision = F.when(F.col("base").isNotNull(), F.concat(F.lit("ineligible:"), "base")).when(F.col("representative"), "kept").otherwise("removed")
    return rows.select("match_id", "tour", "year", "representative", decision.alias("decision"))


def best_by_policy(losses: DataFrame) -> DataFrame:
    """Per policy (the variant's name up to its first dash) and tour the candidate of least log loss over both windows."""
    return least_loss(losses.withColumn("policy", F.split("variant", "-")[0]), "policy", "tour").withColumn("log_loss", F.round("log_loss", 6))
