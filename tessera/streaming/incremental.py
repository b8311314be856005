"""Relevance counts kept up to date while battles arrive.

The count-based operators are sums over rows, so a stream of coded battles needs only the sums per
feature as state; the statistics are read off the sums at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import stats as S


def relevance_counts(coded: DataFrame) -> DataFrame:
    """Sums per feature of a (streaming) table (feature_id, z, human_pref)."""
    y = schema.label()
    c, s = 2 * y - 1, F.signum("z")
    more, less = F.col("z") > 0, F.col("z") < 0
    return coded.filter((F.col("z") != 0) & y.isNotNull()).groupBy("feature_id").agg(
        F.count("*").alias("n_fire"), F.sum(more.cast("long")).alias("p"), F.sum(less.cast("long")).alias("q"),
        F.sum(F.when(more, y).otherwise(0.0)).alias("y_more"), F.sum(F.when(less, y).otherwise(0.0)).alias("y_less"),
        F.sum(c).alias("sc"), F.sum(c * c).alias("scc"), F.sum(s * c).alias("ssc"),
    )


def relevance(counts: DataFrame, n_rows: int) -> DataFrame:
    """The statistics of ``operators.relevance.win_relevance`` from the sums."""
    p, q, n = F.col("p"), F.col("q"), F.col("n_fire")
    more, less = S.ratio(F.col("y_more"), p), S.ratio(F.col("y_less"), q)
    r = F.when((p > 0) & (q > 0), S.pearson(n, (p - q).cast("double"), n.cast("double"), F.col("sc"), F.col("scc"), F.col("ssc")))
    return counts.select(
        "feature_id", "n_fire", S.ratio(n, F.lit(n_rows)).alias("fire_rate"), more.alias("win_rate_a_more"), less.alias("win_rate_a_less"),
        (more - less).alias("win_assoc"), r.alias("correlation"),
    )
