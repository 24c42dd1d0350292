"""Record linkage of priced rows to contests, with ambiguity kept.

Both sides meet on tour, year, Slam and round; names decide by a reviewed
alias if there is one, else by equality or a shared surname-initial signature.
A row with one candidate is matched, with several it stays ambiguous, and a
contest claimed by several rows is taken from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class AliasError(ValueError):
    """A reviewed alias that does not name a known player, or repeats."""


def expanded_aliases(aliases: DataFrame) -> DataFrame:
    """(tour, alias_key, year, ids): a row per name and year."""
    rows = aliases.select(F.upper("tour").alias("tour"), X.key(F.col("odds_name")).alias("alias_key"), F.explode(F.sequence("start_year", "end_year")).alias("year"), F.col("canonical_player_id").cast("bigint").alias("id"))
    repeated = rows.groupBy("tour", "alias_key", "year", "id").count().where("count > 1")
    if not repeated.isEmpty():
        raise AliasError("a reviewed alias is given twice for a year")
    return rows.groupBy("tour", "alias_key", "year").agg(F.collect_set("id").alias("ids"))


def check_aliases(aliases: DataFrame, players: DataFrame) -> None:
    """Every alias names a player (tour, id, name) that exists."""
    wanted = aliases.select(F.upper("tour").alias("tour"), F.col("canonical_player_id").cast("bigint").alias("player_id"), F.col("canonical_name").alias("name")).distinct()
    if not wanted.join(players.select("tour", "player_id", "name").distinct(), ["tour", "player_id", "name"], "left_anti").isEmpty():
        raise AliasError("a reviewed alias names no known player")


def _keyed(df: DataFrame, name: str, out: str, short: bool) -> DataFrame:
    rows = df.withColumn(out, X.key(F.col(name), X.ascii_fold(F.col(name))))
    words = F.filter(F.split(out, " "), lambda w: w != "")
    return rows.withColumn(f"{out}_sig", X.short_name_signatures(words) if short else X.full_name_signatures(words))


def _tokens(key: Column | None = None, signatures: Column | None = None, ids: Column | None = None) -> Column:
    """What two names have in common if they are the same: their key, a signature, or a player's id."""
    parts = [F.array(F.concat(F.lit("k:"), key))] if key is not None else []
    parts += [F.transform(x, lambda v, kind=kind: F.concat(F.lit(kind), v.cast("string"))) for kind, x in (("s:", signatures), ("i:", ids)) if x is not None]
    return F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))))


def linked(odds: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Odds rows with match_status, match_id (where matched) and candidates."""
    # names decide, so rows of the same names are one row of work, and only names that share a key, a signature or an id meet
    context, names = ["tour", "year", "slam", "round"], ["w_name", "l_name"]
    rows = odds.select("odds_row_id", *context, *[F.coalesce(f"odds_{side}_name", F.lit("")).alias(n) for side, n in zip(("winner", "loser"), names)])
    o = _keyed(_keyed(rows.select(*context, *names).distinct(), "w_name", "wk", True), "l_name", "lk", True)
    if aliases is None:
        o = o.withColumns({"w_ids": F.lit(None).cast("array<bigint>"), "l_ids": F.lit(None).cast("array<bigint>")})
    else:
        a = expanded_aliases(aliases)
        for side in "wl":
            o = o.join(a.select("tour", F.col("alias_key").alias(f"{side}k"), "year", F.col("ids").alias(f"{side}_ids")), ["tour", f"{side}k", "year"], "left")
    one = F.col("winner_is_player_1")
    told = [f"{s}_{x}" for s in ("cw", "cl") for x in (("name",) if aliases is None else ("id", "name"))]
    c = canonical.select("match_id", *context, *[F.when(one, F.col(f"player_{a}_{x}")).otherwise(F.col(f"player_{b}_{x}")).alias(f"{s}_{x}") for s, a, b in (("cw", 1, 2), ("cl", 2, 1)) for x in ("id", "name")])
    c = c.groupBy(*context, *told).agg(F.count("*").alias("n"), F.min("match_id").alias("found"))
    if aliases is None:
        c = c.withColumns({"cw_id": F.lit(None).cast("bigint"), "cl_id": F.lit(None).cast("bigint")})
    c = _keyed(_keyed(c, "cw_name", "cwk", False), "cl_name", "clk", False)

    def same(side: str):
        alias, key, sig = F.col(f"{side}_ids"), F.col(f"{side}k") == F.col(f"c{side}k"), F.arrays_overlap(f"{side}k_sig", f"c{side}k_sig")
        return F.when(alias.isNotNull(), F.array_contains(alias, F.col(f"c{side}_id"))).otherwise(key | F.coalesce(sig, F.lit(False)))

    o = o.withColumn("tokens", F.when(F.col("w_ids").isNotNull(), _tokens(ids=F.col("w_ids"))).otherwise(_tokens(F.col("wk"), F.col("wk_sig"))))
    c = c.withColumn("c_tokens", _tokens(F.col("cwk"), F.col("cwk_sig"), F.array("cw_id")))
    pairs = o.withColumn("token", F.explode("tokens")).join(c.withColumn("token", F.explode("c_tokens")), [*context, "token"])
    # a pair that shares several tokens counts at the first of them
    pairs = pairs.where(same("w") & same("l")).where(F.get(F.array_intersect("tokens", "c_tokens"), F.lit(0)) == F.col("token"))
    by_names = pairs.groupBy(*context, *names).agg(F.sum("n").alias("n"), F.min("found").alias("found"))
    found = rows.join(by_names, [*context, *names]).groupBy("odds_row_id").agg(F.sum("n").alias("candidates"), F.min("found").alias("found"))
    rows = odds.join(found, "odds_row_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    status = F.when(F.col("round").isNull(), "unmapped_round").when(F.col("candidates") == 0, "unmatched").when(F.col("candidates") > 1, "ambiguous").otherwise("matched")
    rows = rows.withColumn("status", status)
    claimed = rows.where("status = 'matched'").groupBy("found").agg(F.count("*").alias("claims"))
    rows = rows.join(claimed, "found", "left")
    twice = (F.col("status") == "matched") & (F.col("claims") > 1)
    out = rows.withColumn("match_status", F.when(twice, "duplicate_source_match").otherwise(F.col("status")))
    return out.withColumn("match_id", F.when(F.col("match_status") == "matched", F.col("found"))).drop("found", "status", "claims")
