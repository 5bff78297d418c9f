"""Min-max complexity scores over a set of candidates, shared by hotspots and stale files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.scalar import min_max


def scored(candidates: DataFrame, measure: Column) -> DataFrame:
    """``candidates`` with ``score``: the product of ``measure`` and complexity, each scaled over all candidates.

    Complexity is cyclomatic where above zero, else lines of code, else 0. The window has no key, for scores are relative
    to the whole set; callers limit the set first.
    """
    every = Window.partitionBy()
    cyclo, loc = F.col("cyclomatic_complexity"), F.col("loc")

    def scaled(value: Column) -> Column:
        positive = F.when(value > 0, value)
        return min_max(value.cast("double"), F.coalesce(F.min(positive).over(every), F.lit(0)).cast("double"), F.coalesce(F.max(positive).over(every), F.lit(1)).cast("double"))

    complexity = F.when(cyclo > 0, scaled(cyclo)).when(loc > 0, scaled(loc)).otherwise(0.0)
    m = measure.cast("double")
    return candidates.withColumn("score", min_max(m, F.min(m).over(every), F.max(m).over(every)) * complexity)
