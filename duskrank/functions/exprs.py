"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Bound ``value``; a null stays null (bare greatest/least would turn it into a bound)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def watch_ratio(timespent: Column, duration: Column, high: float | None = None) -> Column:
    """timespent / duration, optionally clipped to [0, high].

    Zero duration: with a bound, positive time gives the bound and zero time gives null;
    without a bound there is nothing to fall back on, so null.
    """
    ratio = F.try_divide(timespent, duration)
    if high is None:
        return ratio
    return (
        F.when((duration == 0) & (timespent > 0), F.lit(float(high)))
        .when((duration == 0) & (timespent < 0), F.lit(0.0))
        .otherwise(clip(ratio, 0.0, float(high)))
    )


def positive_feedback() -> Column:
    return F.col("like") + F.col("share") + F.col("bookmarks")


def any_reaction() -> Column:
    return F.col("like") + F.col("dislike") + F.col("share") + F.col("bookmarks")


def target() -> Column:
    return (F.col("like").cast("int") - F.col("dislike").cast("int")).alias("target")


def mean_where(predicate: Column, value: Column) -> Column:
    return F.avg(F.when(predicate, value))


def sum_where(predicate: Column, value: Column) -> Column:
    """Sum over the rows that satisfy ``predicate``; 0 when there are none."""
    return F.coalesce(F.sum(F.when(predicate, value)), F.lit(0))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(
        left, right, lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def gender_likelihood(mean_gender: Column, gender: Column) -> Column:
    """(m-1)^(g-1) * (2-m)^(2-g): chance of gender code g in {1, 2} when the mean code is m."""
    return F.when(
        gender.isin(1.0, 2.0),
        F.pow(mean_gender - 1, gender - 1) * F.pow(2 - mean_gender, 2 - gender),
    )
