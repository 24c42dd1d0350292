"""Audit checks: each is a projection or one aggregate, and their union is the issue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ROUNDS, SLAMS, SURFACES
from .normalize import expected_surface

ISSUE = ("severity", "category", "tour", "year", "tourney_id", "tourney_name", "source_file", "source_row_number", "match_id", "field", "value", "message")
REQUIRED = ("tourney_id", "tourney_name", "tourney_date", "tourney_level", "surface", "round", "best_of", "winner_id", "winner_name", "loser_id", "loser_name", "score")
URGENT = ("winner_name", "loser_name", "tourney_id")
#: Main-draw matches of a 128 draw, and the count below which an event is severely short (fixed values).
FULL_DRAW, SEVERE = 127, 114
EXPECTED_ROUNDS = {"R128": 64, "R64": 32, "R32": 16, "R16": 8, "QF": 4, "SF": 2, "F": 1}
#: Editions that did not take place (fixed values).
CANCELLED = (("Wimbledon", 2020), ("Australian Open", 1986))


def _issue(severity, category: str, field: str, value: Column, message, **other) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    of = {c: F.col(c) for c in ISSUE[2:9]} | other
    return [lit(severity).alias("severity"), lit(category).alias("category"), *[lit(v).cast("bigint" if k == "source_row_number" else "int" if k == "year" else "string").alias(k) for k, v in of.items()], lit(field).alias("field"), value.cast("string").alias("value"), lit(message).alias("message")]


def missing_values(matches: DataFrame, fields: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A row per required field that is null: one pass, whatever the number of fields."""
    of = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit("warning" if f in URGENT else "info").alias("severity"))) for f in fields]))
    rows = matches.withColumn("gap", F.explode(of))
    return rows.select(*_issue(F.col("gap.severity"), "missing_value", F.col("gap.field"), F.lit(None), "canonical field is null"))


def row_checks(matches: DataFrame) -> DataFrame:
    """Unexpected surfaces, unmapped grand-slam levels and rounds outside a main draw, in one pass."""
    recent = F.col("year") >= 1988
    checks = {
        "unexpected_surface": (F.col("surface").isNotNull() & ~F.col("surface").isin(*SURFACES), F.when(recent, "warning").otherwise("info"), "surface", F.col("surface"), "surface is outside Hard, Clay, Grass, Carpet"),
        "unmapped_grand_slam": ((F.col("tourney_level") == "G") & F.col("slam").isNull(), F.when(recent, "error").otherwise("warning"), "slam", F.col("tourney_name"), "tournament level G could not be mapped conservatively to a canonical Slam"),
        "unexpected_slam_round": (F.col("slam").isNotNull() & F.col("round").isNotNull() & ~F.col("round").isin(*ROUNDS), F.lit("warning"), "round", F.col("round"), "Slam row has an unexpected main-draw round code"),
    }
    found = F.array_compact(F.array(*[F.when(cond, F.struct(sev.alias("severity"), F.lit(name).alias("category"), F.lit(field).alias("field"), value.alias("value"), F.lit(text).alias("message"))) for name, (cond, sev, field, value, text) in checks.items()]))
    rows = matches.withColumn("check", F.explode(found))
    return rows.select("check.severity", "check.category", *[F.col(c).cast("bigint" if c == "source_row_number" else "int" if c == "year" else "string").alias(c) for c in ISSUE[2:9]], "check.field", "check.value", "check.message")


def duplicate_ids(matches: DataFrame) -> DataFrame:
    """Canonical ids that occur more than once."""
    return matches.groupBy("match_id").agg(F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("tour", "year", "tourney_id", "tourney_name", "source_file")]).where("copies > 1")


def probable_duplicates(matches: DataFrame) -> DataFrame:
    """Unordered pairs of players that meet twice in one round of one event on one date."""
    key = lambda s: F.coalesce(F.col(f"{s}_id").cast("string"), F.lower(f"{s}_name"), F.lit("?"))
    rows = matches.withColumns({"w": key("winner"), "l": key("loser")}).where("w <> '?' and l <> '?'")
    keys = ["tour", "year", "tourney_date", F.lower("tourney_name").alias("name_key"), "round", F.least("w", "l").alias("player_1"), F.greatest("w", "l").alias("player_2")]
    return rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.countDistinct("match_id").alias("distinct_ids"), F.min("match_id").alias("match_id")).where("copies > 1")


def event_sizes(matches: DataFrame) -> DataFrame:
    """Slam events with their smallest name, largest draw and number of matches."""
    return matches.where("slam is not null").groupBy("tour", "year", "slam").agg(F.min("tourney_name").alias("name"), F.max("draw_size").alias("draw"), F.count("*").alias("n"))


def size_signals(matches: DataFrame) -> DataFrame:
    """Events of a 128 draw that do not have 127 matches; severe under 114."""
    events = event_sizes(matches).where((F.col("draw") == 128) & (F.col("n") != FULL_DRAW))
    return events.withColumn("severe", F.col("n") < SEVERE)


def surface_mismatches(matches: DataFrame) -> DataFrame:
    rows = matches.where("slam is not null and surface is not null").groupBy("tour", "year", "slam", "surface").agg(F.count("*").alias("n"))
    return rows.withColumn("expected", expected_surface(F.col("slam"), F.col("year"))).where("surface <> expected")


def round_gaps(matches: DataFrame) -> DataFrame:
    """Rounds of 128-draw events whose number of matches is not the expected one, 0 where a round is absent."""
    events = event_sizes(matches).where("draw = 128").select("tour", "year", "slam")
    expected = F.array(*[F.struct(F.lit(r).alias("round"), F.lit(n).alias("expected")) for r, n in EXPECTED_ROUNDS.items()])
    grid = events.withColumn("e", F.explode(expected)).select("tour", "year", "slam", "e.round", "e.expected")
    actual = matches.where("slam is not null").groupBy("tour", "year", "slam", "round").agg(F.count("*").alias("n"))
    return grid.join(actual, ["tour", "year", "slam", "round"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> expected")


def missing_events(matches: DataFrame, first: int, last: int) -> DataFrame:
    """Slam editions of every tour that have no match, but for cancelled ones."""
    spark: SparkSession = matches.sparkSession
    present = matches.where("slam is not null").select("tour", "year", "slam").distinct()
    tours = matches.select("tour").distinct()
    grid = tours.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("slam", F.explode(F.array(*map(F.lit, SLAMS))))
    cancelled = spark.createDataFrame(list(CANCELLED), "slam string, year int")
    return grid.join(F.broadcast(cancelled), ["slam", "year"], "left_anti").join(present, ["tour", "year", "slam"], "left_anti")


def known_cancelled(matches: DataFrame) -> DataFrame:
    """(tour, year, slam) of editions that are known not to have been held, for every tour."""
    cancelled = matches.sparkSession.createDataFrame(list(CANCELLED), "slam string, year int")
    return matches.select("tour").distinct().crossJoin(F.broadcast(cancelled)).select("tour", "year", "slam")


def low_years(matches: DataFrame, share: float = 0.65, first: int = 1988, last: int = 2025, left_out: int = 2020) -> DataFrame:
    """Years of the primary period with fewer contests than this share of their tour's median year.

    The year left out is not in the median, and only an info if it is low itself.
    """
    yearly = matches.where(F.col("year").between(first, last)).groupBy("tour", "year").agg(F.count("*").alias("n"))
    middle = yearly.where(F.col("year") != left_out).groupBy("tour").agg(F.percentile("n", 0.5).alias("middle"))
    low = yearly.join(middle, "tour").where(F.col("n") < share * F.col("middle"))
    return low.withColumn("severity", F.when(F.col("year") == left_out, "info").otherwise("warning"))


def in_order(issues: DataFrame) -> list[Column]:
    """The total order of an exported table of findings; nulls come first."""
    severity = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    names = ("tour", "year", "tourney_id", "tourney_name", "source_file", "source_row_number", "match_id", "field", "value", "detail")
    return [severity, F.col("category"), *[F.col(c).asc_nulls_first() for c in names if c in issues.columns]]


def issue_table(matches: DataFrame, normalization: DataFrame | None = None) -> DataFrame:
    """All findings in one schema."""
    none = F.lit(None)
    dup = duplicate_ids(matches).select(*_issue("error", "duplicate_canonical_id", "match_id", F.col("match_id"), F.concat(F.lit("canonical ID occurs "), F.col("copies").cast("string"), F.lit(" times")), source_row_number=none))
    probable = probable_duplicates(matches).select(*_issue("warning", "probable_duplicate_match", "participants", F.concat_ws(" / ", "player_1", "player_2"), F.concat(F.col("copies").cast("string"), F.lit(" rows and "), F.col("distinct_ids").cast("string"), F.lit(" distinct canonical IDs share the key")), tourney_id=none, tourney_name=F.col("name_key"), source_file=none, source_row_number=none))
    signal = size_signals(matches).select(*_issue(F.when(F.col("severe"), "error").otherwise("warning"), "slam_match_count_signal", "match_count", F.col("n"), "a 128 draw has 127 matches", tourney_id=none, tourney_name=F.col("name"), source_file=none, source_row_number=none, match_id=none))
    surface = surface_mismatches(matches).select(*_issue("warning", "slam_surface", "surface", F.col("surface"), F.concat(F.lit("expected "), F.col("expected")), tourney_id=none, tourney_name=F.col("slam"), source_file=none, source_row_number=none, match_id=none))
    gaps = round_gaps(matches).select(*_issue("warning", "slam_round_count", "round", F.col("round"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("expected").cast("string")), tourney_id=none, tourney_name=F.col("slam"), source_file=none, source_row_number=none, match_id=none))
    parts = [missing_values(matches), row_checks(matches), dup, probable, signal, surface, gaps]
    if normalization is not None:
        of = matches.select("source_file", "source_row_number", "tourney_id", "tourney_name", "match_id").dropDuplicates(["source_file", "source_row_number"])
        joined = normalization.join(of, ["source_file", "source_row_number"], "left")
        parts.append(joined.select(*_issue("warning", "normalization", F.col("field"), F.col("raw_value"), F.col("issue"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(matches: DataFrame, normalization: DataFrame | None = None) -> DataFrame:
    """One row: contests, findings by severity, and whether nothing blocks the primary period."""
    found = issue_table(matches, normalization).agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = matches.agg(F.count("*").alias("matches"), F.countDistinct("tour").alias("tours"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return rows.crossJoin(found).withColumn("ready", (F.col("errors") == 0) & (F.col("matches") > 0))


def exact_duplicate_count() -> Column:
    return F.count("*").over(Window.partitionBy("match_id"))


def probable_duplicate_flag(date: str = "tourney_date") -> Column:
    same = Window.partitionBy("tour", "year", date, F.lower("tourney_name"), "round", F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id"))
    return F.count("*").over(same) > 1


def placed(issues: DataFrame) -> DataFrame:
    """The findings with their place in the order of ``in_order``, for exports that other tools read unordered."""
    return issues.withColumn("place", F.row_number().over(Window.orderBy(*in_order(issues))).cast("bigint"))


def blocking(matches: DataFrame) -> DataFrame:
    """The counters of a verdict that are sums over the rows, from one aggregate and one count of repeated ids."""
    repeated = duplicate_ids(matches).agg(F.count("*").alias("duplicate_ids"))
    rows = matches.agg(F.count("*").alias("matches"), F.countDistinct("tour").alias("tours"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                       F.count_if((F.col("tourney_level") == "G") & F.col("slam").isNull() & (F.col("year") >= 1988)).alias("unmapped"), F.count_if(~F.col("surface").isin(*SURFACES)).alias("odd_surfaces"))
    return rows.crossJoin(repeated)
