"""Quality rules: fixed limits first, then robust multivariate outliers.

Every document gets a vector of five transformed statistics.  For each
language and source, the minimum covariance determinant estimate of its
centre and scatter is found from a deterministic start (medians and quartile
ranges) by concentration steps: each keeps the three quarters of the rows that
lie nearest and estimates again.  Steps go on until no group's determinant
falls by more than a thousandth, STEPS at most.  A document is rejected when
its squared Mahalanobis distance exceeds ``LIMIT``.

Every group has its own estimate, however small.  Statistics such as the share
of repeated lines are zero for most clean text, and a group may have a handful
of rows; a bare scatter estimate would then be singular and call every other
value an outlier.  As in the regularised form of the estimate, the scatter of
the nearest rows is blended with a target, here by adding a floor to each
variance: the spread that is never held against a document.

Everything is column expressions: distances come from a Cholesky factor that
is worked out in columns, one row per group, and moments and quantiles are
partial aggregates, so a group of any size is summed in pieces.  Quantiles are
those of ``percentile_approx`` at its default accuracy: the place among n rows
is off by n / 10000 at most, and exact for smaller groups.

Defined cases: null text counts as empty and fails the word limit; null lang
and null source are groups of their own; rows that tie with the quantile are
kept; repeated rows are judged alike, and rows that share a doc_id or have none
each by its own text; a group of one row is its own centre and keeps it; very
long texts are counted whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, forget, lookup, row_key, rows_but, small_enough, stash, words

MIN_WORDS = 10
#: Per cent of words in repeated windows above which a text fails.
MAX_REPEAT = 20
WINDOW = 5
#: Concentration steps at most; the first ones do nearly all.
STEPS = 10
#: Fall of a determinant's logarithm below which a group is settled.
SETTLED = 1e-3
KEEP = 0.75
#: Rescales the scatter of the nearest three quarters of five normal variables:
#: 0.75 / P(chi2_7 <= 6.626), 6.626 being the 0.75 quantile of chi2_5.
CONSISTENCY = 1.41
#: Squared distance beyond which a document goes; chi2_5 exceeds it once in seven million.
LIMIT = 40.0
#: Least spreads: log of words, log of word length, root of symbols per word,
#: root of the share of repeated lines, share of repeated words.
FLOORS = (1.0, 0.25, 0.08, 0.4, 0.1)
VECTOR = ("x0", "x1", "x2", "x3", "x4")
D = len(VECTOR)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    own = docs.select("doc_id", row_key(docs, "text", "lang", "source").alias("key"), "lang", "source", text.alias("text"), words(F.col("text")).alias("words"), lines.alias("lines"))
    hashed = own.select(
        "doc_id", "key", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    at = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))
    rows = hashed.withColumn("g", windows).drop("h")
    repeated = F.size(F.array_distinct("g")) < F.size("g")
    rows = rows.withColumn("s", F.when(repeated, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("g")
    same = lambda e, i: F.coalesce(e["x"] == F.get("s", i)["x"], F.lit(False))
    twin = lambda e, i: same(e, i - 1) | same(e, i + 1)
    at_twins = F.sort_array(F.transform(F.filter("s", twin), lambda e: e["i"]))
    rows = rows.withColumn("q", at_twins).drop("s")
    covered = F.aggregate("q", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")))["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("q")


def _vector(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "x0": F.log(n.cast("double")),
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x2": F.sqrt(F.col("n_symbols") / n),
        "x3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x4": F.col("n_repeat_words") / n,
    })


def _factor(estimates: DataFrame, scale: float) -> DataFrame:
    """(g, centre m0.., l00, l10, l11, .., logdet): the Cholesky factor of the scaled scatter plus the floors, column by column."""
    c = lambda i, j: F.col(f"c{max(i, j)}{min(i, j)}")
    rows = estimates
    for j in range(D):
        diagonal = scale * c(j, j) + FLOORS[j] ** 2
        for k in range(j):
            diagonal = diagonal - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-12))))
        below = {}
        for i in range(j + 1, D):
            value = scale * c(i, j)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = value / F.col(f"l{j}{j}")
        if below:
            rows = rows.withColumns(below)
    logdet = sum((F.log(f"l{i}{i}") for i in range(D)), F.lit(0.0))
    return rows.select("g", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)], logdet.alias("logdet"))


def _distances(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """The rows with their squared distance ``d2`` from their group's centre."""
    keep = rows.columns
    out = lookup(rows, factors, "g")
    for i in range(D):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    total: Column = F.lit(0.0)
    for i in range(D):
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return out.select(*keep, total.alias("d2"))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(D)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)])


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as standard deviations, without covariances."""
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75]).alias(f"p{i}") for i in range(D)])
    sd = lambda i: (F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349
    return quartiles.select("g", *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(D)], *[(sd(i) * sd(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)])


def estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """(g, centre, Cholesky factor) of the minimum covariance determinant estimate of each group's rows."""
    factors = stash(_factor(_start(vectors), 1.0), "start")
    for step in range(steps):
        far = _distances(vectors, factors)
        bound = far.groupBy("g").agg(F.percentile_approx("d2", KEEP).alias("bound"))
        # as many rows as factors, and shorter ones
        near = far.join(F.broadcast(bound), "g") if small_enough(factors) else lookup(far, stash(bound, "bounds"), "g")
        closer = _factor(_moments(near.where("d2 <= bound")), CONSISTENCY).withColumnRenamed("logdet", "now")
        before = factors.select(F.col("g").alias("old"), "logdet")
        before = F.broadcast(before) if small_enough(factors) else before
        closer = closer.join(before, F.col("g") == F.col("old")).withColumn("moved", F.abs(F.col("now") - F.col("logdet")) > SETTLED)
        nearer = stash(closer.drop("old", "logdet").withColumnRenamed("now", "logdet"), "factors")
        forget(factors)
        factors = nearer
        if step and factors.where("moved").isEmpty():
            break
    return factors.drop("moved")


def _group() -> Column:
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.concat_ws("\x1f", name("lang"), name("source"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and d2 (null where the limits failed)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    stats = stash(_vector(statistics(docs)).withColumn("base_failed", failed).withColumn("g", _group()), "stats")
    factors = estimates(stats.where("not base_failed").select("g", *VECTOR))
    out = _distances(stats.drop("lang", "source", "n_lines"), factors)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return out.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(d2 <= LIMIT, F.lit(True))).alias("kept"), d2.alias("d2"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; each row by its own text."""
    gone = stash(judged(docs).where("not kept").select("doc_id", "key").distinct(), "rejected")
    return rows_but(docs, gone, "text", "lang", "source")
