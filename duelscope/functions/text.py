"""Text columns: trimming, tolerant parsing, name keys and signatures."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def original(c: Column) -> Column:
    """The text as it is, null where only white space is there."""
    return F.when(F.trim(c) != "", c)


def whole_number(c: Column, kind: str = "int") -> Column:
    return trimmed(c).try_cast(kind)


def compact_date(c: Column) -> Column:
    """A date written yyyyMMdd; null otherwise."""
    return F.when(trimmed(c).rlike(r"^\d{8}$"), F.try_to_date(trimmed(c), "yyyyMMdd"))


def identity(id_: Column, name: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    return F.coalesce(F.concat(F.lit("id:"), id_.cast("string")), F.concat(F.lit("name:"), F.nullif(squeezed, F.lit(""))), F.lit("unknown"))


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what has no ASCII form; only non-ASCII text needs it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def key(c: Column, folded: Column | None = None) -> Column:
    """Lower-case ASCII words with single spaces; null gives an empty key.

    ``folded``: the column after ``ascii_fold``; without it the text must be ASCII.
    """
    base = F.lower(F.coalesce(folded if folded is not None else c, F.lit("")))
    return F.trim(F.regexp_replace(base, r"[^a-z0-9]+", " "))


def full_name_signatures(words: Column) -> Column:
    """``surname:initial`` for every way to divide a full name."""
    n = F.size(words)
    cut = lambda i: F.concat(F.array_join(F.slice(words, i + 1, n), ""), F.lit(":"), F.substring(F.element_at(words, 1), 1, 1))
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), cut))).otherwise(F.array().cast("array<string>"))


def short_name_signatures(words: Column) -> Column:
    """Signatures of a name with initials after or before the surname, besides those of a full name."""
    n = F.size(words)
    initials = lambda ws: F.aggregate(ws, F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda a, w: F.when(a["on"] & (F.length(w) == 1), F.struct((a["k"] + 1).alias("k"), F.lit(True).alias("on"))).otherwise(F.struct(a["k"].alias("k"), F.lit(False).alias("on"))))["k"]
    last, first = initials(F.reverse(words)), initials(words)
    after = F.when((last > 0) & (last < n), F.concat(F.array_join(F.slice(words, 1, n - last), ""), F.lit(":"), F.element_at(words, n - last + 1)))
    before = F.when((first > 0) & (first < n), F.concat(F.array_join(F.slice(words, first + 1, n), ""), F.lit(":"), F.element_at(words, 1)))
    return F.when(n >= 2, F.array_union(F.array_compact(F.array(after, before)), full_name_signatures(words))).otherwise(F.array().cast("array<string>"))
