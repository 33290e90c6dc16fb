"""Ordinals and running sums within large groups, in two levels so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the leading order column that share one inner window.
SPAN = 256


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to this one, in the order of ``order``.

    The first order column is an integer without nulls; rows are summed per ``SPAN`` of its values, the sums of the
    spans are accumulated, and each span is ordered on its own. Rows that tie in ``order`` are ordered arbitrarily.
    """
    span = F.floor(F.col(order[0]) / SPAN)
    tagged = df.withColumn("_span", span)
    sums = tagged.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*keys, "_span", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        tagged.withColumn("_own", F.sum(value).over(inner)).join(bases, [*keys, "_span"])
        .withColumn(name, F.col("_base") + F.col("_own")).drop("_span", "_own", "_base")
    )


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Add the row's number (from 1) within its group."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", name).drop("_one")
