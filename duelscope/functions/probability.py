"""Rating and price arithmetic as columns: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def elo(r1: Column, r2: Column, scale: float = 400.0) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (num(r2) - num(r1)) / scale))


def best_of_three(q: Column) -> Column:
    return q * q * (3.0 - 2.0 * q)


def best_of_five(q: Column) -> Column:
    return q * q * q * (10.0 - 15.0 * q + 6.0 * q * q)


def set_probability(p: Column) -> Column:
    """The set probability whose best-of-three is ``p``, in closed form."""
    return 0.5 - F.sin(F.asin(1.0 - 2.0 * clamp(p)) / 3.0)


def for_format(p: Column, best_of: Column, convert: Column) -> Column:
    """Best-of-five contests convert where ``convert`` says so; all are clamped."""
    return clamp(F.when(convert & (best_of == 5), best_of_five(set_probability(p))).otherwise(p))


def rank_rating(rank: Column) -> Column:
    raw = 1500.0 + 400.0 * F.log10(100.0 / rank)
    return F.when(rank > 0, F.greatest(F.lit(900.0), F.least(F.lit(2200.0), raw))).otherwise(F.lit(1500.0))


def decayed(rating: Column, days: Column, half_life: Column) -> Column:
    return F.when((days > 0) & half_life.isNotNull(), 1500.0 + (rating - 1500.0) * F.pow(F.lit(0.5), days / half_life)).otherwise(rating)


def log_loss(p: Column, won: Column) -> Column:
    return -F.log(clamp(F.when(won == 1, p).otherwise(1.0 - p)))


def decimal_price(c: Column) -> Column:
    """A usable decimal price: finite and above 1."""
    x = c.try_cast("double")
    return F.when((x > 1.0) & (x < float("inf")), x)


def proportional(w: Column, l: Column) -> Column:  # noqa: E741
    return (1.0 / w) / (1.0 / w + 1.0 / l)


def additive(w: Column, l: Column) -> Column:  # noqa: E741
    """Half of the margin off either inverse price; null where that leaves [0, 1]."""
    p = 1.0 / w - (1.0 / w + 1.0 / l - 1.0) / 2.0
    return F.when((p >= 0) & (p <= 1), p)


#: Newton's steps: prices of bookmakers take about eight, 1.000001 takes about thirty.
STEPS = 40


def power(w: Column | str, l: Column | str) -> Column:  # noqa: E741
    """The power method: p = q_w ** k with q_w ** k + q_l ** k = 1; null without two prices or a root.

    The sum falls in k and is convex, so Newton's steps from k = 0 rise to the
    root and need no bracket.  They are a fold within the row, over the logs.
    """
    a, b = (-F.log(F.col(x) if isinstance(x, str) else x) for x in (w, l))
    start = F.struct(F.lit(0.0).alias("k"), a.alias("a"), b.alias("b"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))

    def step(acc: Column, _: Column) -> Column:
        k = acc["k"] - (acc["x"] + acc["y"] - 1.0) / (acc["a"] * acc["x"] + acc["b"] * acc["y"])
        return F.struct(k.alias("k"), acc["a"].alias("a"), acc["b"].alias("b"), F.exp(acc["a"] * k).alias("x"), F.exp(acc["b"] * k).alias("y"))

    def root(acc: Column) -> Column:
        return F.when(F.abs(acc["x"] + acc["y"] - 1.0) <= 1e-12, acc["x"] / (acc["x"] + acc["y"]))

    return F.when((a < 0) & (b < 0), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, root))
