"""Keys that hold a large part of the rows, and pages that are hard to read."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from duelscope.llm import decontaminate, htmlextract, linededup, ngramjoin
from tests.llm.test_llm import DOCS, brute_groups, prose


def test_common_buckets_are_dealt_out_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(7)
    base = prose(rng, 60).split()
    rows = [(i, " ".join("zz%d" % i if k == i % 60 else w for k, w in enumerate(base)), "en", "a", 0) for i in range(120)]
    rows += [(1000 + i, prose(rng, rng.randint(1, 50)), "en", "a", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(tuple(r) for r in ngramjoin.groups(docs).collect())
    monkeypatch.setattr(ngramjoin, "common_classes", lambda counts: 1)  # nearly all are common
    got = sorted(tuple(r) for r in ngramjoin.groups(docs.repartition(7)).collect())
    assert got == want and {i: (n, c) for i, n, c in got} == brute_groups(rows)


def test_common_classes_follow_the_mean():
    import numpy as np

    counts = np.zeros(1 << ngramjoin.CLASS_BITS, dtype=np.uint32)
    assert ngramjoin.common_classes(counts) == ngramjoin.COMMON
    assert ngramjoin.common_classes(counts + 100_000) == 800_000


def test_one_text_in_many_rows_loses_its_lines_once_each(spark):
    text = "the first line of it\nthe first line of it\nsomething else altogether here"
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = Counter(r["n"] for r in linededup._gathered(linededup._read(docs.withColumn("key", F.lit(1).cast("long")), 8, 10, 4)).where("line >= 0").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2 * 60_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = linededup.deduplicated(docs).groupBy("text").count().collect()
    assert {(r["text"], r["count"]) for r in got} == {("the first line of it\nsomething else altogether here", 1), ("", 19_999)}


def test_equal_rows_do_not_pair_their_postings(spark):
    words = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, words)] * 300 + [(2, "w0 w1 other")], "doc_id long, text string")
    items = spark.createDataFrame([("a", words)], "item_id string, text string")
    got = Counter((r["doc_id"], r["n_hit"], r["near_items"]) for r in decontaminate.contamination(docs, items).select("doc_id", "n_hit", "near_items").collect())
    assert got == {(1, 12, 1): 300, (2, 0, 0): 1}


def test_end_tags_are_read_in_linear_time():
    began = time.perf_counter()
    htmlextract.parse("<table><tr><td>" * 60_000 + "</caption>" * 60_000)
    assert time.perf_counter() - began < 20


def test_shown_raw_text_is_kept():
    nodes = htmlextract.elements(htmlextract.parse("<article><p>a</p><xmp>x &lt; <b>y</b></xmp><p>z</p></article>"))
    assert [(e.tag, e.children) for e in nodes if e.tag == "xmp"] == [("xmp", ["x &lt; <b>y</b>"])]
    assert [e.tag for e in nodes][-1] == "p"
