"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballkmeans, chat, decontaminate, htmlextract, licences, linededup, mixing, neardup, ngramjoin, prefixtrie, quality, urlfilter, warc
from .shared import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.col("near_items").alias("n_near_items"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return docs.select("doc_id", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed_lines"), F.sha2("text", 256).alias("text_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.groups(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judged(pages, urlfilter.labelled_pages(pages, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("d2", "key")


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.paired(chat.preferences(*chat.stale_replies(table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["len"].cast("string"))), ",")
    return pairs.withColumns({c: spans(c) for c in ("chosen_loss", "rejected_loss")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefixes(table(spark, sf_dir, "conversations"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.clustered(table(spark, sf_dir, "embeddings"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_license_scan": op5_license_scan,
    "op6_html_extraction": op6_html_extraction,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_preference_format": op9_preference_format,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_embedding_neardup": op13_embedding_neardup,
}

#: Only what SQL can express over whole tables in reasonable time.
SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_ngram_join": ngramjoin.SQL,
    "op4_mix_sources": mixing.SQL,
    "op5_license_scan": licences.SQL,
    "op9_preference_format": chat.SQL,
    "op10_warc": warc.SQL,
    "op11_prefix_trie": prefixtrie.SQL,
    "op12_ball_kmeans": ballkmeans.SQL,
    "op13_embedding_neardup": neardup.SQL,
}
