"""The trie of conversations: every sequence of first turns is a node, totals climb from the leaves to the root.

Leaf-peeling message passing.  The nodes that one longest conversation runs
through form a path; paths hang on nodes of other paths.  A path holds a
counter of the paths that hang on it and are not complete.  In each round the
paths whose counter is 0 are complete and send their totals to the path they
hang on, which adds them and counts down, until only the root's path is left.
So a chain of thousands of turns, or a node with a third of all conversations
below it, costs no rounds of its own: rounds are as many as paths hang on each
other.  What was sent to a node is then summed along its path from below.

No group is held by a task.  Conversations, paths and the conversations that
end in a node are dealt out in ranges (see ``scan``), counts and messages are
combined before they are shuffled, and a node's list of ends is put together
from pieces, each a text of one range.

Sequences are told apart by two 64-bit sums over hashes of (depth, role and
text); a turn's role and text by their 128-bit digest.

Defined cases: a null role or text is empty; a null turn number comes first;
turns of one number come in the order of the digests of role and text, so
repeated rows are repeated turns; rows without conv_id belong to no
conversation; a conversation without turns ends in the root; an empty table
gives no rows; other columns are ignored; long texts are digested where they
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean
from .scan import ranged, running
from .shared import empty, keyed, stash

#: Characters of a piece of a node's list of ends.
PIECE = 1 << 16


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return running(turns, "conv_id", ["turn", "digest"], [], "turns").drop("turn")


def borrowed(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, length, depth, digest, chars) of conversations that begin with another one's first turns.

    Conversation c takes the first h turns of c - c % every instead of its own
    first h, where h is the CRC-32 of its decimal id modulo most + 1.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = stash(sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")), "ids")
    bases = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = keyed(ids, stash(bases.join(ids.select("base").distinct(), "base", "left_semi"), "bases"), ["base"], "left")
    used = F.least("h", F.coalesce("base_n", F.lit(0)))
    known = stash(known.select("conv_id", "base", "h", used.alias("used"), (used + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "known")
    firsts = turns.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    heads = known.where("used > 0").select("conv_id", "base", "used", "length").join(firsts, "base").where("place <= used").select("conv_id", "length", F.col("place").alias("depth"), "digest", "chars")
    tails = keyed(turns, known.select("conv_id", "h", "used", "length"), ["conv_id"], "inner").where("place > h").select("conv_id", "length", (F.col("used") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars")
    root = known.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return heads.unionByName(tails).unionByName(root)


def _members(turns: DataFrame) -> DataFrame:
    """(conv_id, length, depth, chars, n1, n2, p1, p2): the nodes of each conversation; n1 and n2 tell a node, p1 and p2 its parent."""
    z = {"z1": F.xxhash64("depth", "digest"), "z2": F.xxhash64("digest", "depth", F.lit("2"))}
    turns = turns.withColumns({k: F.when(F.col("depth") > 0, v).otherwise(0) for k, v in z.items()}).drop("digest")
    rows = running(turns, "conv_id", ["depth"], ["z1", "z2"], "members").drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("conv_id", "length", "depth", "chars", "sum_z1", "sum_z2")]
            parents = [pa.array(batch.column(f"sum_{c}").to_numpy() - batch.column(c).to_numpy()) for c in ("z1", "z2")]
            yield pa.record_batch([*cols, *parents], names=["conv_id", "length", "depth", "chars", "n1", "n2", "p1", "p2"])

    return rows.mapInArrow(lean(run), "conv_id long, length long, depth long, chars long, n1 long, n2 long, p1 long, p2 long")


def _nodes(members: DataFrame) -> DataFrame:
    """A row per node: its smallest member, members, path (the largest id among its longest members) and that path's length."""
    longest = F.max(F.struct("length", F.col("conv_id").alias("path")))
    grouped = members.groupBy("n1", "n2", "p1", "p2", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), longest.alias("longest"))
    nodes = stash(grouped.select("n1", "n2", "p1", "p2", "depth", "chars", "conv_id", "n_convs", "longest.length", "longest.path"), "nodes")
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    return nodes.join(parents, ["p1", "p2", "depth"], "left").withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))


def _peeled(nodes: DataFrame) -> DataFrame:
    """(path, depth, n_side, saved, leaves): what the paths that hang on a node have sent to it."""
    paths = nodes.groupBy("path").agg(F.sum("own").alias("saved"), F.min(F.struct("depth", "up")).alias("top"))
    paths = stash(paths.select("path", "saved", "top.up", (F.col("top.depth") - 1).alias("at")), "paths")
    left = paths.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("left"))
    pending = stash(paths.join(left, "path", "left").select("path", "up", "at", "saved", F.lit(1).cast("long").alias("leaves"), F.coalesce("left", F.lit(0)).alias("left")), "pending")
    rounds = []
    while not empty(pending):
        ready = pending.where("left = 0 and up is not null")
        rounds.append(ready.select("up", "at", "saved", "leaves"))
        messages = ready.groupBy(F.col("up").alias("path")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("came"))
        waiting = pending.where("left > 0").join(messages, "path", "left")
        pending = stash(waiting.select("path", "up", "at", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("left") - F.coalesce("came", F.lit(0))).alias("left")), "pending")
    out = paths.where("false").selectExpr("up", "at", "saved", "cast(0 as bigint) as leaves") if not rounds else rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(F.count("*").alias("n_side"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _ends(members: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of nodes in which conversations end: the digest of their sorted ids."""
    ends = ranged(members.where("depth = length").select("n1", "n2", "conv_id"), "n1", "n2", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, first = None, [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["n1", "n2", "first", "ids"])

        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("n1", "n2", "conv_id"))):
                if held and ((a, b) != key or size > PIECE):
                    yield out()
                    held, size = [], 0
                if not held:
                    key, first = (a, b), c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found: list[tuple[int, int, str]] = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("n1", "n2", "ids"))):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            if found:
                yield pa.record_batch([pa.array(np.array([f[k] for f in found], np.int64)) for k in (0, 1)] + [pa.array([f[2] for f in found])], names=["n1", "n2", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["n1", "n2", "ends_sha256"])

    parts = ends.mapInArrow(lean(pieces), "n1 long, n2 long, first long, ids string")
    return parts.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first").mapInArrow(lean(digests), "n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie of these turns (conv_id, length, depth, digest, chars), depth 0 included.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves and saved_tokens of the subtree, ends_sha256.
    """
    members = stash(_members(turns), "in_nodes")
    nodes = stash(_nodes(members), "tree")
    side = _peeled(nodes)
    zero = lambda c: F.coalesce(c, F.lit(0))
    last = F.col("depth") == F.col("length")
    whole = nodes.join(side, ["path", "depth"], "left").select("n1", "n2", "conv_id", "depth", "parent_conv_id", "n_convs", "path", (-F.col("depth")).alias("from_below"),
        (zero("n_side") + F.when(last, 0).otherwise(1)).cast("long").alias("n_children"), (F.col("own") + zero("saved")).alias("saved"), (zero("leaves") + F.when(last, 1).otherwise(0)).alias("leaves"))
    totals = running(whole, "path", ["from_below"], ["saved", "leaves"], "totals")
    out = totals.join(_ends(members), ["n1", "n2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with the first turns they borrow."""
    return trie(borrowed(numbered(conversations)))


#: The same rows in DuckDB's SQL; CRC-32 by its polynomial, subtrees by the prefixes of each node's smallest member.
SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
bytes as (select distinct conv_id, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint) as b from t),
ids as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_concat([4294967295::bigint], b), lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)), 4294967295::bigint) % 6 as h from bytes),
sizes as (select conv_id, count(*) as n from t group by conv_id),
used as (select ids.*, least(h, coalesce(n, 0)) as used from ids left join sizes on sizes.conv_id = ids.base),
turns as (
  select used.conv_id, place as depth, digest, chars from used join t on t.conv_id = used.base and place <= used.used
  union all select used.conv_id, used.used + place - h, digest, chars from used join t using (conv_id) where place > h
  union all select conv_id, 0, '', 0 from used),
lists as (select conv_id, list(digest order by depth) as l, max(depth) as length from turns group by conv_id),
m as (
  select turns.conv_id, depth, chars, length, sha256(array_to_string(l[1:depth + 1], ',')) as node, case when depth > 0 then sha256(array_to_string(l[1:depth], ',')) end as parent
  from turns join lists using (conv_id)),
nodes as (
  select node, parent, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(chars) as own,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = length) as ends from m group by node, parent, depth),
kids as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
sub as (
  select p.node, sum(u.own) as saved, count(*) filter (where k.n is null) as leaves
  from nodes u join m p on p.conv_id = u.conv_id and p.depth <= u.depth left join kids k on k.node = u.node group by p.node)
select nodes.conv_id, nodes.depth::bigint as depth, up.conv_id as parent_conv_id, nodes.n_convs::bigint as n_convs, coalesce(kids.n, 0)::bigint as n_children,
  sub.leaves::bigint as n_leaves, sub.saved::bigint as saved_tokens, sha256(coalesce(nodes.ends, '')) as ends_sha256
from nodes join sub using (node) left join kids using (node) left join nodes up on up.node = nodes.parent
"""
