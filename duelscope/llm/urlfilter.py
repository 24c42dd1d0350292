"""URL filters: a rule list, and association rules mined from labels.

FP-growth finds combinations of URL tokens that go with blocked labels.  A rule
stays if its support is enough and its confidence is, even at the lower end of
its interval (Wilson's, at Z standard errors): the fewer labelled URLs a rule
rests on, the purer it has to be, whatever the size of the table.  The rules
left stand in an inverted index under their rarest token; a URL meets only the
rules of its own tokens and is blocked when it has all tokens of one.

Tokens are all labels of the host by their place from the end, all path
segments by place, file type, query keys, scheme, and whether there is a
fragment or a last slash; runs of digits are one.  Tokens that stand in exactly
the same labelled URLs are mined as one, and a rule has all of them, so a long
path that labelled URLs share does not multiply the combinations.

Labelled URLs beyond FIT_ROWS are thinned before mining, each url and label in
proportion to its rows; that bound concerns the fit alone, every URL is judged.

Defined cases: null urls and urls without ``://`` have an empty host and path,
fit no rule of the list and have no tokens, so they are allowed; repeated rows
are judged alike and count as often as they are labelled; of tokens that are
equally rare the first by order is a rule's key; very long urls are read whole;
without labels, or with labels that have nothing to do with the url, nothing is
mined and the list decides alone; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, keyed, sent, stash

#: (host and path, verdict): a rule fits its host and all subdomains; the longest that fits wins.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FIT_ROWS = 200_000
#: Least share of labelled URLs that have all tokens of a rule and are blocked.
MIN_SUPPORT = 0.002
#: Least confidence, to be reached by the lower end of its interval.
MIN_CONFIDENCE = 0.5
#: Standard errors of that interval.
Z = 2.58


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(rest(url), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, under = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{under}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a whole URL."""
    host, path = host_and_path(url)
    query = F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1)
    named = lambda name: lambda s, k: F.concat(F.lit(name), (k + 1).cast("string"), F.lit(":"), s)
    labels = F.transform(F.reverse(F.split(host, r"\.")), named("host"))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda s: s != "")
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.regexp_extract(s, r"^[^=]*", 0)))
    kind = F.regexp_extract(path, r"\.([A-Za-z][A-Za-z0-9]*)$", 1)
    more = F.array_compact(F.array(
        F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^(.*?)://", 1)),
        F.when(kind != "", F.concat(F.lit("type:"), ascii_lower(kind))),
        F.when(F.regexp_extract(rest(url), r"#", 0) != "", F.lit("fragment")),
        F.when(path.endswith("/"), F.lit("folder")),
    ))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(labels, F.transform(segments, named("path")), keys, more))).otherwise(F.array().cast("array<string>"))


def lower_end(share: Column, n: Column, z: float) -> Column:
    """Of Wilson's interval for a share of n."""
    return (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def mined(labelled: DataFrame, fit_rows: int = FIT_ROWS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, z: float = Z) -> DataFrame:
    """(rule, tokens, key, confidence, support, lower) for blocking, from (url, blocked)."""
    schema = "rule long, tokens array<string>, key string, confidence double, support double, lower double"
    spark = labelled.sparkSession
    told = stash(labelled.where("url is not null and blocked is not null").groupBy("url", "blocked").agg(F.count("*").alias("n")), "labelled")
    every = told.agg(F.sum("n")).first()[0] or 0
    if not every:
        return spark.createDataFrame([], schema)
    part = F.col("n") * min(1.0, fit_rows / every)
    drawn = F.floor(part) + (F.pmod(F.xxhash64("url", "blocked"), F.lit(1 << 20)) / float(1 << 20) < part - F.floor(part)).cast("long")
    rows = told.where(drawn > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), drawn)))
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), "blocked", tokens(F.col("url")).alias("own")), "baskets")
    n, blocked = rows.agg(F.count("*"), F.sum(F.col("blocked").cast("int"))).first()
    # fewer rows than this can't reach the confidence though all were blocked
    least = max(math.ceil(min_support * n), math.ceil(min_confidence * z * z / (1 - min_confidence)))
    if (blocked or 0) < least:
        return spark.createDataFrame([], schema)
    each = rows.select("row", F.explode("own").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("rows")).where(F.col("n") >= least)
    same = Window.partitionBy("n", "rows").orderBy("token")
    often = stash(often.withColumn("item", F.first("token").over(same)), "tokens")
    items = keyed(each, often.where("token = item").select("token"), ["token"], "left_semi").groupBy("row").agg(F.collect_list("token").alias("items"))
    label = F.when(F.col("blocked"), F.lit("label:block")).otherwise(F.lit("label:allow"))
    baskets = rows.select("row", label.alias("label")).join(items, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min_confidence).fit(stash(baskets, "baskets"))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == "label:block") & ~F.exists("antecedent", lambda t: t.startswith("label:")))
    rules = rules.withColumn("lower", lower_end(F.col("confidence"), F.round(F.col("support") * n / F.col("confidence")), z))
    rules = stash(rules.where((F.col("lower") >= min_confidence) & (F.col("lower") > blocked / n)).select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), "antecedent", "confidence", "support", "lower"), "rules")
    whole = rules.select("rule", F.explode("antecedent").alias("item")).join(often, "item")
    whole = whole.groupBy("rule").agg(F.sort_array(F.collect_set("token")).alias("tokens"), F.min(F.struct("n", "token"))["token"].alias("key"))
    return rules.join(whole, "rule").select("rule", "tokens", "key", "confidence", "support", "lower")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rules): the mined rules that each distinct url meets, for urls that meet any. rules: a stashed table."""
    own = urls.select("url").where("url is not null").distinct().withColumn("own", tokens(F.col("url")))
    asked = own.select("url", "own", F.explode("own").alias("key"))
    index = sent(rules).select("key", "rule", F.col("tokens").alias("needed"))
    met = asked.join(index, "key").where(F.size(F.array_except("needed", "own")) == 0)
    return met.groupBy("url").agg(F.count("*").alias("rules"))


def judged(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and n_mined (mined rules met) for every page."""
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    met = stash(matched(pages, stash(mined(labelled), "mined")), "met")
    rows = keyed(own, met, ["url"], "left")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("rules") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.coalesce("rules", F.lit(0)).alias("n_mined"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): pages whose path names a labelled document; low quality and toxic ones are blocked."""
    number = F.regexp_extract(F.col("url"), r"://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[^0-9/?#][^/?#]*)?/?(?:[?#]|$)", 1)
    of = pages.select("url", F.when(number != "", number.cast("bigint")).alias("doc_id")).where("doc_id is not null")
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return of.join(bad, "doc_id").select("url", "blocked")
