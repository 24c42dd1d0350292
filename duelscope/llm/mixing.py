"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words; each of its documents an expected number
of copies in proportion to a weight: by default the binary digits of its word
count, so that a text of twice the length is a little more likely to be in the
mix.  No document is expected more than MAX_COPIES times; a level per source
is found such that the expected words are the target with that cap.  The whole
part of a document's number is certain.  For the rest, documents are ranked by
random odds divided by inclusion odds, ``u / (1 - u) * (1 - p) / p``, and taken
in that order until the source's missing words are reached: a sample of fixed
size, in words, with unequal inclusion probabilities.  The document at the
boundary gives only its first missing words, so every source meets its target
to the word.

``u`` is a hash of seed, doc_id and text, so reruns agree.  The boundary of a
source is found from word counts in 4096 cells of the rank, then in 4096 parts
of the boundary cell, and only documents of that one part are sorted; no task
holds a whole source.

Defined cases: null text and text without words have size 0 and give nothing;
null is a source of its own, after all others; rows that share a doc_id or have
none are drawn each by its text, and rows that are equal in both share their
rank, so which of them is cut does not show; ranks that tie go by doc_id and
size; very long texts are counted whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lookup, sent, stash, words

#: Cells of the rank, and parts of a cell.
CELLS = 4096
WEIGHTS = (3, 1, 2)
#: Twice the share of all words that the mix has: 150 %.
SHARE_HALVES = 3
MAX_COPIES = 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources by code point, null last.  No target
    exceeds MAX_COPIES times its source; what it would have had beyond goes to
    the others by weight.  That is a level all others share: sources are gone
    through from the lowest cap per weight on, each capped if its cap is no
    more than the level that is left, and the first that isn't sets it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sources.withColumn("weight", weight).withColumn("place", F.row_number().over(by_name))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    levels = named.select("*", F.sum("source_size").over(every).alias("total"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("gone"), F.sum("weight").over(rest).alias("left"))
    level = (SHARE_HALVES * F.col("total") - 2 * MAX_COPIES * F.col("gone")).cast("double") / (2 * F.col("left")).cast("double")
    capped = levels.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= MAX_COPIES * F.col("source_size"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(every)["level"]
    reached = capped.withColumn("first", first)
    cap = (MAX_COPIES * F.col("source_size")).cast("double")
    return reached.select("source", "source_size", F.when(F.col("first").isNull(), cap).otherwise(F.least(cap, F.col("first") * F.col("weight"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a string: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def levels(classes: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, level): a document of weight w is expected least(MAX_COPIES, level * w) times.

    classes: (source, w, words).  Weights are gone through from the greatest
    on, each capped if the level that is left asks for the cap or more; the
    first that isn't sets the level, and it is null if all are.
    """
    down = Window.partitionBy("source").orderBy(F.col("w").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = classes.join(sent(goal).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("before", before).withColumn("rest", rest)
    rows = rows.withColumn("level", F.try_divide(F.col("target") - (MAX_COPIES * F.col("before")).cast("double"), F.col("rest").cast("double")))
    free = F.col("level") * F.col("w") < MAX_COPIES
    out = rows.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max_by("level", F.when(free, F.col("w"))).alias("level"))
    return out


def mix(docs: DataFrame, seed: int = 20, weights: tuple[int, ...] = WEIGHTS, weight: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    weight: a column of whole numbers, 1 at least (null and less count as 1),
    by which documents of a source are expected in the mix; the binary digits
    of their size without it.  Distinct weights are few, or as many groups.
    """
    size = F.size(words(F.col("text"))).cast("long")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    own = docs.select("doc_id", "source", size.alias("size"), (F.col(f"`{weight}`").cast("long") if weight else F.lit(None).cast("long")).alias("w"), uniform(key, seed).alias("u"))
    own = own.withColumn("w", F.greatest(F.col("w"), F.lit(1)) if weight else F.length(F.bin("size")).cast("long"))
    sized = stash(own, "sizes")
    classes = stash(sized.groupBy("source", "w").agg(F.sum("size").alias("words")), "classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    rows = lookup(sized, stash(levels(classes, stash(goal, "targets")), "levels"), "source")
    wanted = F.when(F.col("level").isNull(), F.lit(float(MAX_COPIES))).otherwise(F.least(F.lit(float(MAX_COPIES)), F.col("level") * F.col("w")))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(wanted)).withColumn("whole", F.floor("copies"))
    rows = rows.withColumn("p", F.col("copies") - F.col("whole"))
    odds = F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p"))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, odds))
    fine = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * (CELLS * CELLS)), F.lit(CELLS * CELLS - 1))
    rows = rows.withColumn("cell", F.floor(fine / CELLS)).withColumn("part", F.pmod(fine, F.lit(CELLS)))
    rows = stash(rows.select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "cell", "part"), "ranked")
    cells = rows.groupBy("source", "cell").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("goal"))
    run = cells.withColumn("missing", F.floor("goal").cast("long") - F.sum("certain").over(Window.partitionBy("source")))
    run = run.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy(F.col("cell").asc_nulls_first())))
    room = F.col("missing") - (F.col("until") - F.col("words"))
    edge = F.min(F.when((F.col("until") >= F.col("missing")) & (F.col("words") > 0) & (F.col("missing") > 0), F.struct("cell", room.alias("room"))))
    ends = run.groupBy("source").agg(F.first("missing").alias("missing"), edge.alias("edge"))
    # a source whose ranked words do not reach its target gives all of them
    ends = stash(ends.select("source", F.when(F.col("missing") <= 0, F.lit(-1)).otherwise(F.coalesce("edge.cell", F.lit(CELLS))).alias("last"), F.col("edge.room").alias("room")), "ends")
    parts = lookup(rows.where("rank is not null"), ends, "source").where("cell = last").groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("last").alias("last"), F.first("room").alias("room"))
    parts = parts.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("part")))
    inner = F.min(F.when((F.col("until") >= F.col("room")) & (F.col("words") > 0), F.struct("part", (F.col("room") - (F.col("until") - F.col("words"))).alias("room"))))
    inner = parts.groupBy("source").agg(inner.alias("inner")).select(F.col("source").alias("s"), F.col("inner.part").alias("last_part"), F.col("inner.room").alias("rest"))
    ends = stash(ends.join(inner, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "last", "last_part", "rest"), "ends")
    placed = lookup(rows, ends, "source")
    sure = F.col("whole") * F.col("size")
    at_end = F.coalesce((F.col("cell") == F.col("last")) & (F.col("part") == F.col("last_part")), F.lit(False))
    within = (F.col("cell") < F.col("last")) | ((F.col("cell") == F.col("last")) & (F.col("part") < F.col("last_part")))
    inside = placed.where(~at_end).withColumn("taken", sure + F.when(within, F.col("size")).otherwise(0))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = placed.where(at_end).withColumn("through", F.sum("size").over(in_order))
    edges = edges.withColumn("taken", sure + F.least("size", F.greatest(F.lit(0), F.col("rest") - (F.col("through") - F.col("size")))))
    out = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return inside.select(*out).unionByName(edges.select(*out))


#: The same mix in DuckDB's SQL.
SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5('20:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, '')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u
  from documents),
weighed as (select *, length(bin(size)) as w from sized),
of as (select source, sum(size)::bigint as source_size from sized group by source),
named as (
  select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    row_number() over (order by source nulls last) as place from of),
levels as (
  select *, sum(source_size) over () as total,
    coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0) as gone,
    sum(weight) over (order by source_size / weight, place rows between current row and unbounded following) as remaining
  from named),
capped as (
  select *, (3 * total - 4 * gone)::double / (2 * remaining)::double as level,
    (3 * total - 4 * gone)::double / (2 * remaining)::double * weight >= 2 * source_size as is_capped
  from levels),
goal as (
  select source, source_size, case when first is null then (2 * source_size)::double
    else least((2 * source_size)::double, first * weight) end as target
  from (select *, (select min_by(level, (source_size / weight, place)) from capped where not is_capped) as first from capped)),
classes as (select source, w, sum(size)::bigint as words from weighed group by source, w),
shares as (
  select c.source, c.w, g.source_size, g.target,
    (g.target - (2 * coalesce(sum(c.words) over (partition by c.source order by c.w desc rows between unbounded preceding and 1 preceding), 0))::double)
      / nullif((sum(c.w * c.words) over (partition by c.source order by c.w desc rows between current row and unbounded following))::double, 0) as level
  from classes c join goal g on c.source is not distinct from g.source),
per_source as (select source, any_value(source_size) as source_size, any_value(target) as target, max_by(level, w) filter (where level * w < 2) as level from shares group by source),
copied as (
  select s.*, g.source_size, g.target,
    case when s.size = 0 then 0.0::double when g.level is null then 2.0::double else least(2.0::double, g.level * s.w) end as copies
  from weighed s join per_source g on s.source is not distinct from g.source),
ranked as (
  select *, floor(copies)::bigint as whole, copies - floor(copies) as p from copied),
ordered as (
  select *, case when p > 0 then u / (1 - u) * ((1 - p) / p) end as rank from ranked),
run as (
  select *, sum(case when rank is not null then size else 0 end) over (partition by source order by rank nulls last, doc_id, size rows unbounded preceding) as through,
    floor(target)::bigint - sum(whole * size) over (partition by source) as missing
  from ordered)
select doc_id, size, source_size, target,
  (whole * size + case when rank is not null then least(size, greatest(0, missing - (through - size))) else 0 end)::bigint as taken
from run
"""
