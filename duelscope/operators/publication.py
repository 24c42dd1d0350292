"""Tidy figure data: summary columns to long rows, ordered as panels show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MODELS, ROUNDS, SLAMS
from .contracts import ContractError


def place(c: Column, order: tuple[str, ...]) -> Column:
    """The position in a custom order; unknown values go last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def panel(summaries: DataFrame, name: str, metrics: tuple[str, ...], keys: tuple[str, ...] = ("tour", "slam", "model")) -> DataFrame:
    """Wide metric columns as rows (panel, keys, metric, value)."""
    return summaries.select(F.lit(name).alias("panel"), *keys, *metrics).unpivot(["panel", *keys], list(metrics), "metric", "value")


def figure_data(summaries: DataFrame, contrast: DataFrame) -> DataFrame:
    """All panels in one table in display order."""
    rates = panel(summaries, "rates", ("expected_per_100", "actual_per_100"))
    excess = panel(summaries, "excess", ("excess_per_100",))
    other = panel(contrast.withColumn("slam", F.lit("contrast")), "contrast", ("expected_per_100", "excess_per_100"))
    rows = rates.unionByName(excess).unionByName(other)
    return rows.orderBy(place(F.col("panel"), ("rates", "excess", "contrast")), "tour", place(F.col("slam"), SLAMS), place(F.col("model"), (*MODELS, "market_odds")), "metric")


#: The five panels in their order (fixed names).
PANELS = ("long_run_actual_expected", "wta_latest_era_context", "rolling_five_excess", "market_model_validation", "direct_wimbledon_contrast")
RATES, EXCESS = ("expected_per_100", "actual_per_100"), ("excess_per_100",)
PRIMARY = "population = 'completed_non_retirement'"


def five_panels(summaries: DataFrame, eras: DataFrame, rolling: DataFrame, common: DataFrame, contrast: DataFrame, tour: str = "WTA", endpoints: tuple[str, str] = ("1988-1999", "2020-2025"), model: str = "surface_adjusted_elo", compared: tuple[str, ...] = (MODELS[0], MODELS[2], "market_odds")) -> DataFrame:
    """Tidy rows of all panels: (panel, tour, slam, model, sample, period, metric, value, score_matches, place).

    summaries and eras: of all available contests, the latter by era; rolling:
    runs of editions with their first and last one; common: of the contests that
    all compared models have; contrast: one Slam against the mean of the others.
    place is the position in the order in which the panels show the rows.
    """
    def shown(rows: DataFrame, panel: str, metrics: tuple[str, ...], sample: str, period: Column) -> DataFrame:
        count = F.col("score_matches") if "score_matches" in rows.columns else F.lit(None)
        wide = rows.select(F.lit(panel).alias("panel"), "tour", "slam", "model", F.lit(sample).alias("sample"), period.cast("string").alias("period"), count.cast("long").alias("score_matches"), *metrics)
        return wide.unpivot(["panel", "tour", "slam", "model", "sample", "period", "score_matches"], list(metrics), "metric", "value")

    whole, own = F.lit(None), f"model = '{model}' and {PRIMARY}"
    parts = [
        shown(summaries.where(f"{own} and slam is not null"), PANELS[0], RATES, "maximum_available", whole),
        shown(eras.where(f"{own} and slam is not null and dimension = 'era'").where((F.col("tour") == tour) & F.col("value").isin(*endpoints)).withColumnRenamed("value", "era"), PANELS[1], RATES, "maximum_available", F.col("era")),
        shown(rolling.where(f"{own} and slam is not null"), PANELS[2], EXCESS, "maximum_available", F.concat_ws(" to ", "first_edition", "last_edition")),
        shown(common.where(f"{PRIMARY} and slam is not null").where(F.col("model").isin(*compared)), PANELS[3], EXCESS, "common_matched", whole),
        shown(contrast.where(own).withColumn("slam", F.lit("Wimbledon")), PANELS[4], ("expected_per_100", "excess_per_100"), "common_matched", whole),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    order = [place(F.col("panel"), PANELS), F.col("tour"), place(F.col("slam"), SLAMS), place(F.col("model"), (*MODELS, "market_odds")), F.coalesce("period", F.lit("")), place(F.col("metric"), (*RATES, *EXCESS))]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a few hundred rows


def panel_counts(rows: DataFrame) -> DataFrame:
    """(panel, rows) in which every panel has its row."""
    names = F.explode(F.array(*map(F.lit, PANELS))).alias("panel")
    every = rows.sparkSession.range(1).select(names)
    return every.join(rows.groupBy("panel").agg(F.count("*").alias("rows")), "panel", "left").select("panel", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def check_panels(rows: DataFrame, wanted: dict[str, int]) -> None:
    """The panels hold the rows they were reviewed with."""
    found = {r["panel"]: r["rows"] for r in panel_counts(rows).collect()}  # one of each panel
    if found != wanted:
        raise ContractError(f"panels of {found}, not {wanted}")


def round_order(c: Column) -> Column:
    return place(c, ROUNDS)
