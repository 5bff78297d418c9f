"""Renames: a deletion and an addition of one base name in one commit, resolved along chains.

``ord`` orders commits, oldest first. A pair is a rename if the base name is deleted once and added once in the
commit and the new path was not touched before. A touch of an old path at or before a rename belongs to the new path, and so on
along the chain; a path made anew after a rename is another file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.scalar import basename
from chronolode.session import cut_lineage


def detect_renames(entries: DataFrame) -> DataFrame:
    """ord, old, new of the renames in ``entries`` (ord, path, status)."""
    pairs = entries.where(F.col("status").isin("A", "D")).groupBy("ord", basename(F.col("path")).alias("base")).agg(
        F.count_if(F.col("status") == "D").alias("d"), F.count_if(F.col("status") == "A").alias("a"),
        F.max(F.when(F.col("status") == "D", F.col("path"))).alias("old"), F.max(F.when(F.col("status") == "A", F.col("path"))).alias("new"),
    ).where("d = 1 and a = 1 and old <> new")
    known = entries.groupBy(F.col("path").alias("new")).agg(F.min("ord").alias("first_ord"))
    return pairs.join(known, "new").where("first_ord >= ord").select("ord", "old", "new")


def resolve_renames(entries: DataFrame) -> DataFrame:
    """``entries`` with ``final_path``; the deleted side of a rename is left out.

    Only distinct touches of renamed paths travel along the chain, a join a hop, until none moves. Each hop is to a later
    commit, so chains end.
    """
    renames = cut_lineage(detect_renames(entries))
    gone = renames.select("ord", F.col("old").alias("path"), F.lit("D").alias("status"))
    kept = entries.join(gone, ["ord", "path", "status"], "left_anti")
    at = kept.join(renames.select(F.col("old").alias("path")).distinct(), "path", "left_semi").select("ord", "path").distinct().withColumns({"now": F.col("path"), "since": F.col("ord")})
    while True:
        later = renames.select(F.col("old").alias("now"), F.struct(F.col("ord").alias("next_ord"), F.col("new").alias("next")).alias("hop"))
        hops = at.join(later, "now", "left").groupBy("ord", "path", "now", "since").agg(F.min(F.when(F.col("hop.next_ord") >= F.col("since"), F.col("hop"))).alias("hop"))
        moved = cut_lineage(
            hops.select("ord", "path", F.coalesce("hop.next", "now").alias("now"), F.coalesce(F.col("hop.next_ord") + 1, F.col("since")).alias("since"), F.col("hop").isNotNull().alias("moved"))
        )
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return kept.join(at.select("ord", "path", "now"), ["ord", "path"], "left").select(*entries.columns, F.coalesce("now", "path").alias("final_path"))
