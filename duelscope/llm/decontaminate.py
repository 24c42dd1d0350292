"""Benchmark decontamination with a positional inverted index.

The index holds postings (term, doc_id, pos) of the training text.  A test
item is searched from its rarest terms: the lists of the two rarest terms of
each window are shifted by the terms' offsets, so that a document position
that starts the window is the same number in both, and intersected; windows
that survive are compared word by word.  Only the lists that a search reads
are stored: the postings of the terms that are rarest somewhere, over all
documents, and of each item's three rarest, which proximity search reads.

Terms are 64-bit hashes in the index; the last comparison is of the words
themselves, so results are exact.  Documents are told apart by doc_id and a
64-bit key of their text.

Defined cases: null text has no words and no hits; an item without words has no
window; an item of fewer words than a window is one window of its own length;
items count by their item_id, a null one is left out; a repeated item is one,
and texts that share an item_id are searched each by itself; repeated and null
doc_ids give one row per row, each judged and dropped by its own text; very
long texts and items are searched whole; an empty table on either side gives
zero hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, keyed, row_key, rows_but, sent, stash

#: Everything that is not in a word, A-Z being folded to a-z.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
#: Words within which the rarest terms of an item count as near each other.
SPAN = 30


def fold(text: Column) -> Column:
    """A-Z to a-z, other letters as they are; pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, key, pos) of every occurrence of the given distinct terms, positions from 0; key is of the text."""
    every = docs.select("doc_id", row_key(docs, "text").alias("key"), F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    return keyed(every.select(F.xxhash64(fold(F.col("word"))).alias("term"), "doc_id", "key", "pos"), terms, ["term"], "inner")


def counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of the given distinct terms in all documents, 0 for those that never occur."""
    every = docs.select(F.explode(raw_words(F.col("text"))).alias("word")).select(F.xxhash64(fold(F.col("word"))).alias("term"))
    seen = keyed(every, terms, ["term"], "inner").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words): each distinct item with words under a number of its own.

    The numbers are dealt out anew by each run, so the table is written before joins by them.
    """
    own = items.where("item_id is not null").select("item_id", raw_words(fold(F.col("text"))).alias("words"))
    return own.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id())


def item_terms(own: DataFrame) -> DataFrame:
    """(item, item_id, size, j, word, term): a row per word of an item."""
    each = own.select("item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("j", "word"))
    return each.withColumn("term", F.xxhash64("word"))


def windows(terms: DataFrame, rarity: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, s, len, first, second): the item offsets of the two rarest terms of each window."""
    ranked = terms.join(sent(rarity), "term").select("item", "j", "size", F.struct("n", "term", "j").alias("rank"))
    last = F.greatest(F.col("size") - width, F.lit(0))
    spread = ranked.select("item", "size", "rank", F.explode(F.sequence(F.greatest(F.col("j") - width + 1, F.lit(0)), F.least(F.col("j"), last))).alias("s"))
    lists = spread.groupBy("item", "s").agg(F.first("size").alias("size"), F.slice(F.array_sort(F.collect_list("rank")), 1, 2).alias("rarest"))
    return lists.select("item", "s", F.least("size", F.lit(width)).alias("len"), F.col("rarest")[0]["j"].alias("first"), F.get("rarest", F.lit(1))["j"].alias("second"))


def candidates(index: DataFrame, terms: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, key, item, diagonal, len, starts): windows whose two rarest terms stand at their offsets.

    A posting at ``pos`` of the item's word ``j`` shifts to the diagonal
    ``pos - j``; both lists of a window meet in the same one.
    """
    used = wins.select("item", F.explode(F.array("first", "second")).alias("j")).where("j is not null").distinct()
    lists = stash(terms.join(used, ["item", "j"]).select("item", "j", "term"), "lists")
    shifted = keyed(index, lists, ["term"], "inner").select("doc_id", "key", "item", (F.col("pos") - F.col("j")).alias("diagonal"), "j")
    met = shifted.groupBy("doc_id", "key", "item", "diagonal").agg(F.collect_set("j").alias("js"))
    begun = met.withColumn("first", F.explode("js"))
    pairs = keyed(begun, wins, ["item", "first"], "inner").where((F.col("diagonal") + F.col("s") >= 0) & (F.col("second").isNull() | F.array_contains("js", F.col("second"))))
    return pairs.groupBy("doc_id", "key", "item", "diagonal", "len").agg(F.sort_array(F.collect_list("s")).alias("starts"))


def rarest(terms: DataFrame, rarity: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, term, k, of): the rarest terms of each item, that proximity search looks for; equal counts go by the word."""
    distinct = terms.groupBy("item_id", "term").agg(F.min("word").alias("word")).join(sent(rarity), "term")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "word"))
    chosen = distinct.withColumn("k", rank).where(F.col("k") <= most)
    return chosen.withColumn("of", F.count("*").over(Window.partitionBy("item_id"))).select("item_id", "term", "k", "of")


def nearby(index: DataFrame, rare: DataFrame, span: int = SPAN) -> DataFrame:
    """Proximity matches (doc_id, key, item_id): all of an item's rarest terms within ``span`` words of the rarest one.

    rare: a stashed result of ``rarest``, whose postings the index holds.
    """
    # equal rows of a document have the same postings; each counts once, or pairs of them would meet
    there = keyed(index, rare, ["term"], "inner").select("doc_id", "key", "item_id", "pos", "k", "of").distinct()
    cell = F.floor(F.col("pos") / span)
    anchor = there.where("k = 1").select("doc_id", "key", "item_id", F.col("pos").alias("at"), "of", cell.alias("cell"))
    other = there.where("k > 1").select(F.col("doc_id").alias("d"), F.col("key").alias("t"), F.col("item_id").alias("i"), "pos", F.col("k").alias("other"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("c"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")) & (F.col("item_id") == F.col("i")) & (F.col("cell") == F.col("c")) & (F.abs(F.col("pos") - F.col("at")) < span)
    near = anchor.join(other, same).groupBy("doc_id", "key", "item_id", "at", "of").agg(F.countDistinct("other").alias("got")).where("got = of - 1")
    return anchor.where("of = 1").select("doc_id", "key", "item_id").unionByName(near.select("doc_id", "key", "item_id")).distinct()


def _covered(spans: str) -> Column:
    """How many words sorted spans (start, len) cover."""
    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(s["start"], end))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """A row per document: doc_id, key, n_words, n_hit, n_items, items, spans (start, len), near_items.

    key is of the text; n_hit counts the words inside occurrences of windows;
    items lists the item_ids with an occurring window, as sorted strings;
    near_items counts the items found by proximity.
    """
    docs = docs.select("doc_id", "text")
    own = stash(item_words(items.select("item_id", "text")), "items")
    terms = stash(item_terms(own), "terms")
    rarity = stash(counts(docs, stash(terms.select("term").distinct(), "vocabulary")), "rarity")
    wins = stash(windows(terms, rarity, width), "windows")
    near = stash(rarest(terms, rarity), "rarest")
    used = wins.select("item", F.explode(F.array("first", "second")).alias("j")).where("j is not null").distinct()
    searched = stash(terms.join(used, ["item", "j"], "left_semi").select("term").unionByName(near.select("term")).distinct(), "searched")
    index = stash(postings(docs, searched), "postings")
    found = candidates(index, terms, wins).groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "diagonal", "len", "starts")).alias("maybe"))
    close = nearby(index, near, span).groupBy("doc_id", "key").agg(F.count("*").alias("near_items")).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "near_items")
    both = found.join(close, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "full")
    known = stash(both.select(F.coalesce("doc_id", "d").alias("d"), F.coalesce("key", "k").alias("k"), "maybe", "near_items"), "matched")

    # the words at the places of candidates leave with the document's row; whole texts meet nothing but these places
    keyed_docs = docs.select("doc_id", row_key(docs, "text").alias("key"), "text")
    joined = keyed_docs.join(sent(known), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    counted = joined.select("doc_id", "key", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"), "near_items", "maybe", F.when(F.col("maybe").isNotNull(), raw_words(fold(F.col("text")))).alias("words"))

    # words are read twice here, so that they stay a column and are not taken from the text for each place
    def piece(m: Column) -> Column:
        lo, hi = m["starts"][0], F.element_at(m["starts"], -1) + m["len"]
        return F.struct(m["item"].alias("item"), m["diagonal"].alias("diagonal"), m["len"].alias("len"), m["starts"].alias("starts"), F.slice("words", m["diagonal"] + lo + 1, F.least(hi - lo, F.size("words"))).alias("there"))

    rows = counted.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "n_words", "near_items", F.transform("maybe", piece).alias("pieces"))
    rows = stash(rows, "pieces")
    pieces = rows.where("pieces is not null").select("row", F.explode("pieces").alias("p")).select("row", "p.*").join(sent(own), "item")
    equal = lambda s: F.slice("there", s - F.col("starts")[0] + 1, F.col("len")) == F.slice("words", s + 1, F.col("len"))
    true = pieces.select("row", "item_id", "len", F.explode(F.transform(F.filter("starts", equal), lambda s: F.col("diagonal") + s)).alias("start"))
    hits = true.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.array().cast("array<struct<start:int,len:int>>")
    out = rows.select("row", "doc_id", "key", "n_words", "near_items").join(sent(stash(hits, "hits")), "row", "left")
    out = out.select("doc_id", "key", "n_words", "near_items", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "key", "n_words", _covered("spans").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", F.coalesce("near_items", F.lit(0)).alias("near_items"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    gone = contamination(docs, items, width).where("n_hit > 0").select("doc_id", "key").distinct()
    return rows_but(docs, stash(gone, "contaminated"), "text")


#: The query in DuckDB's SQL, from words instead of an index.
SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
wins as (
  select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: w[s:s + least(len(w), 10) - 1])) as win from items where len(w) > 0),
sizes as (select distinct n from wins),
places as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as p, w from docs, sizes where len(w) >= n),
hits as (select q.doc_id, q.n, q.p, x.item_id from (select doc_id, n, p, w[p:p + n - 1] as win from places) q join wins x on q.win = x.win),
covered as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(p, p + n)) as spot from (select distinct doc_id, p, n from hits)) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id),
tokens as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from docs),
vocabulary as (select distinct item_id, unnest(w) as word from items),
seen as (select word, count(*) as n from tokens where word in (select word from vocabulary) group by word),
ranked as (select v.item_id, v.word, row_number() over (partition by v.item_id order by coalesce(s.n, 0), v.word) as k from vocabulary v left join seen s on s.word = v.word),
chosen as (select *, count(*) over (partition by item_id) as total from ranked where k <= 3),
there as (select t.doc_id, c.item_id, t.pos, c.k, c.total from tokens t join chosen c on c.word = t.word),
near as (
  select a.doc_id, a.item_id from there a join there b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.k > 1 and abs(a.pos - b.pos) < 30
  where a.k = 1 group by a.doc_id, a.item_id, a.pos, a.total having count(distinct b.k) = a.total - 1
  union select doc_id, item_id from there where k = 1 and total = 1),
closeby as (select doc_id, count(distinct item_id) as n from near group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items, sha256(coalesce(f.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated, coalesce(k.n, 0) as n_near_items
from docs d left join covered c on c.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id left join closeby k on k.doc_id = d.doc_id
"""
