"""Declared schemas; nothing in this library is read with inferred types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of a raw contest file, all text.
RAW_COLUMNS = (
    "tourney_id tourney_name surface draw_size tourney_level tourney_date match_num winner_id winner_seed winner_entry winner_name winner_rank "
    "winner_rank_points loser_id loser_seed loser_entry loser_name loser_rank loser_rank_points score best_of round"
).split()

MATCHES = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("match_id", "tour")],
    T.StructField("year", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("tourney_id", "tourney_name")],
    T.StructField("tourney_date", T.DateType()),
    *[T.StructField(n, T.StringType()) for n in ("tourney_level", "slam", "surface")],
    T.StructField("draw_size", T.IntegerType()),
    T.StructField("round", T.StringType()),
    *[T.StructField(n, T.IntegerType()) for n in ("best_of", "match_num")],
    T.StructField("winner_id", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("winner_seed", "winner_entry", "winner_name")],
    *[T.StructField(n, T.IntegerType()) for n in ("winner_rank", "winner_rank_points")],
    T.StructField("loser_id", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("loser_seed", "loser_entry", "loser_name")],
    *[T.StructField(n, T.IntegerType()) for n in ("loser_rank", "loser_rank_points")],
    T.StructField("score", T.StringType()),
    *[T.StructField(n, T.BooleanType()) for n in ("is_walkover", "is_retirement")],
    *[T.StructField(n, T.StringType()) for n in ("source_file", "source_ref")],
    T.StructField("source_row_number", T.LongType()),
])

ISSUES = "source_file string, source_row_number bigint, tour string, year int, field string, raw_value string, issue string"

#: Result of the chronological replay, one row per contest; the long form adds a row per model.
REPLAY = (
    "variant string, match_id string, tour string, event_date date, exclusion string, p_overall double, p_surface double, p_blend double, "
    "overall_1 double, overall_2 double, surface_1 double, surface_2 double, prior_1 int, prior_2 int, surface_prior_1 int, surface_prior_2 int, "
    "surface_supported boolean, updated boolean"
)

MODELS = ("overall_elo", "surface_elo", "surface_adjusted_elo")
POPULATIONS = ("completed_non_retirement", "retirement_inclusive")
SLAMS = ("Australian Open", "Roland Garros", "Wimbledon", "US Open")
ROUNDS = ("R128", "R64", "R32", "R16", "QF", "SF", "F")
SURFACES = ("Hard", "Clay", "Grass", "Carpet")
