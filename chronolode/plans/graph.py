"""Connected components over an edge list, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.session import cut_lineage


def without_estimate(df: DataFrame) -> DataFrame:
    """The same rows with no estimate of their size.

    A checkpoint keeps the optimizer's estimate, and that of a join is the product of its sides': in a loop its digits
    multiply with every round, until the numbers alone fill the driver's memory.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component``: every endpoint of ``edges`` with the smallest node it can reach.

    Each round lowers a node's label to the least label among its neighbours and then to its label's
    own label, so long chains shorten by halves. Labels and edges stay distributed; a round is cut by a
    reliable checkpoint, and only the number of changed labels comes to the driver. Minima combine on
    the map side, and a hot label is only ever the probing side of a join, which adaptive execution splits.
    Null endpoints are dropped; self-loops give single-node components.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = without_estimate(cut_lineage(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()))
    rows = both.count()  # bounds the rows of all that follows
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), rows)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        step = lowered.alias("a").join(labels.select(F.col("node").alias("lower"), F.col("component").alias("up")), "lower")
        step = cut_lineage(step.select("node", F.least("lower", "up").alias("component"), (F.least("lower", "up") != F.col("a.component")).alias("changed")), rows)
        labels = without_estimate(step.select("node", "component"))
        if step.where("changed").isEmpty():
            return labels
