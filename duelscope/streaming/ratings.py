"""Ratings that follow a stream of contests, keyed by tour.

The overall ratings of a tour are those of the batch replay without starts by
rank, conversion and policies; surfaces are left out, and a tour's state is one
value.  The contests of a date must
arrive within one micro-batch and dates in order; what comes for a date that
is already applied is reported as late and changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.replay import Ratings

OUT = "match_id bigint, tour string, event_date date, winner_id bigint, loser_id bigint, p_overall double, rating_w double, rating_l double, late boolean"


def follow(contests: DataFrame, k: float = 32.0) -> DataFrame:
    """Forecasts of streamed contests (match_id, tour, event_date, winner_id, loser_id) from the ratings before their date."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ratings, done = pickle.loads(state.get[0]) if state.exists else (Ratings(k, False, float("nan"), 0.25), -(10**9))  # noqa: S301
        rows = pd.concat(list(batches)).sort_values(["day", "match_id"])
        for day, of in rows.groupby("day", sort=True):
            late = int(day) <= done
            n = len(of)
            if late:
                found = {"p_overall": np.full(n, np.nan), "overall_w": np.full(n, np.nan), "overall_l": np.full(n, np.nan)}
            else:
                zeros = np.zeros(n)
                found = ratings.date(int(day), of["winner_id"].to_numpy(), of["loser_id"].to_numpy(), (zeros, zeros), zeros.astype(int), np.zeros((n, 1), dtype=bool), np.ones((n, 1)))
                found = {c: found[c][:, 0] for c in ("p_overall", "overall_w", "overall_l")}
                done = int(day)
            yield pd.DataFrame({"match_id": of["match_id"], "tour": key[0], "event_date": of["event_date"], "winner_id": of["winner_id"], "loser_id": of["loser_id"], "p_overall": found["p_overall"], "rating_w": found["overall_w"], "rating_l": found["overall_l"], "late": late})
        state.update((pickle.dumps((ratings, done)),))

    keyed = contests.select("match_id", "tour", "event_date", "winner_id", "loser_id", F.unix_date("event_date").alias("day"))
    return keyed.groupBy("tour").applyInPandasWithState(step, OUT, "ratings binary", "append", "NoTimeout")
