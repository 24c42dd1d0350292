"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is its prompt, rendered once; the
turns after it are rendered for either side, as its completion.  Every
rendered turn carries its mask: loss falls on assistant turns of completions
and on nothing else.  ``preferences`` gives rows of turns; ``paired`` puts them
together to records of prompt, chosen and rejected text with the spans that
count.  A record holds the turns of one stretch of PIECE turn numbers, so a
conversation of any length is never gathered in one place; a reader puts the
pieces of a pair together in their order.

Turns are numbered by ``turn``, a whole number; only their order counts.

Defined cases: null text is an empty one, null role reads ``unknown``; a row
without pair or turn has no place and is left out; repeated rows count once,
and several different rows of one turn are one turn that holds them in order;
a pair whose sides do not differ has nothing to prefer and is left out; a side
may end where the other goes on, and has an empty text in pieces that only the
other has; very long texts stay whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, stash

#: Turn numbers that one record holds.
PIECE = 64
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turns: Column) -> Column:
    """The template over the rows (role, text) of one turn."""
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, text, loss) from two tables of (pair_id, turn, role, text).

    part is prompt, chosen or rejected; loss says whether training counts the text.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        own = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return df.where("pair_id is not null and turn is not null").select("pair_id", "turn", F.lit(name).alias("side"), own.alias("own"))

    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    held = lambda name: F.sort_array(F.collect_set(F.when(F.col("side") == name, F.col("own"))))
    turns = stash(both.groupBy("pair_id", "turn").agg(held("chosen").alias("chosen"), held("rejected").alias("rejected")), "turns")
    split = stash(turns.where("chosen <> rejected").groupBy("pair_id").agg(F.min("turn").alias("split")), "splits")
    placed = lookup(turns, split, "pair_id").where("split is not null")
    before = F.col("turn") < F.col("split")
    piece = lambda part, of: F.struct(F.lit(part).alias("part"), F.col(of).alias("of"))
    parts = F.when(before, F.array(piece("prompt", "chosen"))).otherwise(F.array(piece("chosen", "chosen"), piece("rejected", "rejected")))
    rows = placed.select("pair_id", "turn", F.explode(parts).alias("piece")).where("size(piece.of) > 0")
    loss = (F.col("piece.part") != "prompt") & F.exists("piece.of", lambda t: t["role"] == "assistant")
    return rows.select("pair_id", F.col("piece.part").alias("part"), "turn", rendered(F.col("piece.of")).alias("text"), loss.alias("loss"))


def paired(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """(pair_id, piece, prompt, chosen, rejected, chosen_loss, rejected_loss) from the rows of ``preferences``.

    The texts are those of the piece's turns in order; the losses are the spans
    (start, len) of the text, in characters from 0, that training counts.  A
    prompt has none.
    """
    at = turns.withColumn("piece", F.floor(F.col("turn") / piece))
    grouped = at.groupBy("pair_id", "piece").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "text", "loss")))).alias(part) for part in ("prompt", "chosen", "rejected")])
    text = lambda part: F.array_join(F.transform(part, lambda t: t["text"]), "")

    def spans(part: str) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
        more = lambda a, t: F.when(t["loss"], F.array_append(a["spans"], F.struct(a["end"].alias("start"), F.length(t["text"]).alias("len")))).otherwise(a["spans"])
        return F.aggregate(part, start, lambda a, t: F.struct((a["end"] + F.length(t["text"])).alias("end"), more(a, t).alias("spans")))["spans"]

    return grouped.select("pair_id", "piece", *[text(p).alias(p) for p in ("prompt", "chosen", "rejected")], spans("chosen").alias("chosen_loss"), spans("rejected").alias("rejected_loss"))


def stale_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: chosen up to its last reply, rejected with the reply before in that place.

    Conversations of fewer than two assistant turns make no pair.
    """
    own = turns.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    replies = own.where("role = 'assistant'").select("pair_id", "turn", "text")
    last = replies.groupBy("pair_id").agg(F.max("turn").alias("last"))
    before = lookup(replies, stash(last, "last"), "pair_id").where("turn < last")
    stale = stash(before.groupBy("pair_id", "last").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("stale")).select("pair_id", "last", F.col("stale.text").alias("stale")), "stale")
    placed = lookup(own, stale, "pair_id").where("turn <= last")
    final = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    return placed.select("pair_id", "turn", "role", "text"), placed.select("pair_id", "turn", "role", F.when(final, F.col("stale")).otherwise(F.col("text")).alias("text"))


#: The query over conversations in DuckDB's SQL (turns are not repeated there).
SQL = """
with last as (select conv_id, max(turn) as last from conversations where role = 'assistant' group by conv_id),
stale as (
  select c.conv_id, l.last, max_by(c.text, c.turn) as stale from conversations c join last l on c.conv_id = l.conv_id
  where c.role = 'assistant' and c.turn < l.last group by c.conv_id, l.last),
turns as (
  select c.conv_id as pair_id, c.turn, coalesce(c.role, 'unknown') as role, coalesce(c.text, '') as chosen,
    case when c.turn = s.last and c.role = 'assistant' then s.stale else coalesce(c.text, '') end as rejected
  from conversations c join stale s on c.conv_id = s.conv_id where c.turn <= s.last),
split as (select pair_id, min(turn) as split from turns where chosen <> rejected group by pair_id),
parts as (
  select t.pair_id, 'prompt' as part, t.turn, t.role, t.chosen as text from turns t join split s on t.pair_id = s.pair_id where t.turn < s.split
  union all select t.pair_id, 'chosen', t.turn, t.role, t.chosen from turns t join split s on t.pair_id = s.pair_id where t.turn >= s.split
  union all select t.pair_id, 'rejected', t.turn, t.role, t.rejected from turns t join split s on t.pair_id = s.pair_id where t.turn >= s.split),
said as (
  select pair_id, part, turn, turn // 64 as piece, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as text, part <> 'prompt' and role = 'assistant' as loss
  from parts),
placed as (
  select *, coalesce(sum(length(text)) over (partition by pair_id, piece, part order by turn rows between unbounded preceding and 1 preceding), 0) as start
  from said)
select pair_id, piece,
  coalesce(string_agg(text, '' order by turn) filter (where part = 'prompt'), '') as prompt,
  coalesce(string_agg(text, '' order by turn) filter (where part = 'chosen'), '') as chosen,
  coalesce(string_agg(text, '' order by turn) filter (where part = 'rejected'), '') as rejected,
  coalesce(string_agg(start || '+' || length(text), ',' order by turn) filter (where part = 'chosen' and loss), '') as chosen_loss,
  coalesce(string_agg(start || '+' || length(text), ',' order by turn) filter (where part = 'rejected' and loss), '') as rejected_loss
from placed group by pair_id, piece
"""
