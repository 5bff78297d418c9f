"""Requests on files that change together: pairs, one file's partners, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.scalar import like_any_case, like_exact_case, ratio
from chronolode.operators.people import require_path
from chronolode.plans.coupling import coupling_since
from chronolode.plans.graph import connected_components
from chronolode.plans.model import RepoModel
from chronolode.session import cut_lineage

EDGE_CAP = 10_000


class EdgeCapReached(RuntimeError):
    pass


def pair_ratios(model: RepoModel, since_ms: int | None, smaller: bool) -> DataFrame:
    """Coupled pairs with ``r``: co-changes over the smaller or larger total; pairs with an undefined ratio drop out."""
    pairs = model.file_coupling if since_ms is None else coupling_since(model.file_changes, model.commits, since_ms)
    base = (F.least if smaller else F.greatest)("total_changes_a", "total_changes_b")
    return pairs.withColumn("r", ratio(F.col("co_changes"), base)).where("r is not null")


def _with_paths(pairs: DataFrame, model: RepoModel) -> DataFrame:
    # files are as many as the repository has, and much wider in memory than stored: merged, not held by the driver for a broadcast
    a = model.files.select(F.col("file_id").alias("file_a_id"), F.col("path").alias("fileA")).hint("merge")
    b = model.files.select(F.col("file_id").alias("file_b_id"), F.col("path").alias("fileB")).hint("merge")
    return pairs.join(a, "file_a_id").join(b, "file_b_id")


def temporal_coupling(model: RepoModel, top_n: int = 20, min_coupling: float = 0.3, file_filter: str | None = None, since_ms: int | None = None) -> DataFrame:
    """The most coupled pairs, by co-changes over the smaller total."""
    pairs = pair_ratios(model, since_ms, smaller=True).where((F.col("r") >= min_coupling) & (F.col("total_changes_a") > 0) & (F.col("total_changes_b") > 0))
    rows = _with_paths(pairs, model)
    if file_filter is not None:
        rows = rows.where(like_any_case(F.col("fileA"), file_filter) | like_any_case(F.col("fileB"), file_filter))
    return rows.select(
        "fileA", "fileB", F.col("co_changes").alias("coChanges"), F.col("total_changes_a").alias("totalChangesA"), F.col("total_changes_b").alias("totalChangesB"), F.col("r").alias("couplingRatio")
    ).orderBy(F.desc("couplingRatio"), F.desc("coChanges"), "fileA", "fileB").limit(top_n)


def file_coupling(model: RepoModel, file_path: str | None, top_n: int = 10, min_coupling: float = 0.1, since_ms: int | None = None) -> DataFrame:
    """The partners of one file. Two equi-joins, a side each, rather than one join on either side."""
    target = model.files.where(F.col("path") == require_path(file_path)).select("file_id")
    if since_ms is None:
        pairs = pair_ratios(model, None, smaller=True).where(F.col("r") >= min_coupling)
    else:  # only commits that touch the file
        recent = model.file_changes.join(model.commits.where(F.col("author_date") >= since_ms).select("commit_id"), "commit_id", "left_semi")
        pairs = _partners_since(recent.select("commit_id", "file_id").distinct(), target).where(F.col("r") >= min_coupling)
    a, b = target.withColumnRenamed("file_id", "file_a_id"), target.withColumnRenamed("file_id", "file_b_id")
    left = pairs.join(a, "file_a_id", "left_semi").select(F.col("file_b_id").alias("file_id"), "co_changes", F.col("total_changes_a").alias("t"), F.col("total_changes_b").alias("p"), "r")
    right = pairs.join(b, "file_b_id", "left_semi").select(F.col("file_a_id").alias("file_id"), "co_changes", F.col("total_changes_b").alias("t"), F.col("total_changes_a").alias("p"), "r")
    # since a date the pairs have the target on the left alone
    rows = (left.union(right) if since_ms is None else left).join(model.files, "file_id")
    return rows.select(
        F.col("path").alias("partnerPath"), F.col("co_changes").alias("coChanges"), F.col("t").alias("targetTotalChanges"), F.col("p").alias("partnerTotalChanges"), F.col("r").alias("couplingRatio")
    ).orderBy(F.desc("couplingRatio"), F.desc("coChanges"), "partnerPath").limit(top_n)


def _partners_since(recent: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs (target, partner) of distinct recent touches, in the columns of ``pair_ratios``."""
    mine = recent.join(target, "file_id", "left_semi").select("commit_id", F.col("file_id").alias("file_a_id"))
    pairs = recent.withColumnRenamed("file_id", "file_b_id").join(mine, "commit_id").where("file_a_id <> file_b_id")
    counted = pairs.groupBy("file_a_id", "file_b_id").agg(F.count(F.lit(1)).cast("int").alias("co_changes"))
    partners = counted.select(F.col("file_b_id").alias("file_id")).distinct()
    totals = recent.join(partners, "file_id", "left_semi").groupBy(F.col("file_id").alias("file_b_id")).agg(F.count(F.lit(1)).cast("int").alias("total_changes_b"))
    own = mine.groupBy("file_a_id").agg(F.count(F.lit(1)).cast("int").alias("total_changes_a"))
    rows = counted.join(totals, "file_b_id").join(own, "file_a_id")
    return rows.withColumn("r", ratio(F.col("co_changes"), F.least("total_changes_a", "total_changes_b")))


def _named_edges(edges: DataFrame, model: RepoModel) -> DataFrame:
    return _with_paths(edges, model).select(
        "file_a_id", "file_b_id", "fileA", "fileB", F.col("co_changes").alias("coChanges"), F.col("r").alias("couplingRatio")
    )


def cluster_edges(model: RepoModel, min_coupling: float, since_ms: int | None = None, capped: bool = True) -> DataFrame:
    """Edges of ratio (over the larger total) at least ``min_coupling``; where ``capped``, an error at ``EDGE_CAP`` of them or more."""
    strong = pair_ratios(model, since_ms, smaller=False).where(F.col("r") >= min_coupling)
    if not capped:
        return cut_lineage(strong)
    edges = strong.limit(EDGE_CAP).cache()
    if edges.count() == EDGE_CAP:
        raise EdgeCapReached("Edge cap reached (10 000 edges). Increase minCoupling to reduce graph size.")
    return edges


def labelled_edges(model: RepoModel, min_coupling: float, since_ms: int | None = None, capped: bool = True) -> DataFrame:
    """Named edges with ``cluster``, the smallest file id of the component."""
    edges = cluster_edges(model, min_coupling, since_ms, capped)
    labels = component_labels(edges)
    return _named_edges(edges, model).join(labels.select(F.col("node").alias("file_a_id"), F.col("component").alias("cluster")), "file_a_id")


def component_labels(edges: DataFrame) -> DataFrame:
    """node, component: by union-find on the driver for fewer than ``EDGE_CAP`` edges, distributed for more."""
    pairs = edges.select("file_a_id", "file_b_id").limit(EDGE_CAP).collect()
    if len(pairs) == EDGE_CAP:
        return connected_components(edges, "file_a_id", "file_b_id")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return edges.sparkSession.createDataFrame([(x, root(x)) for x in list(parent)], "node long, component long")


def coupling_clusters(
    model: RepoModel, min_coupling: float = 0.3, min_size: int = 3, max_size: int | None = None, path_filter: str | None = None, top_n: int = 20, since_ms: int | None = None,
    capped: bool = True,
) -> DataFrame:
    """clusterIndex, files, edges, avgCoupling: the components by mean ratio. ``capped``: the request's error at ``EDGE_CAP`` edges."""
    edges = labelled_edges(model, min_coupling, since_ms, capped)
    clusters = _clusters(edges, "cluster").where(F.size("files") >= min_size)
    if max_size is not None:
        clusters = clusters.where(F.size("files") <= max_size)
    if path_filter is not None:
        clusters = clusters.where(F.exists("files", lambda f: like_exact_case(f, path_filter)))
    best = clusters.orderBy(F.desc("avgCoupling"), F.col("files")[0]).limit(top_n)
    index = F.row_number().over(Window.orderBy(F.desc("avgCoupling"), F.col("files")[0])).alias("clusterIndex")
    return best.select(index, "files", "edges", "avgCoupling").orderBy("clusterIndex")


def _clusters(edges: DataFrame, *keys: str) -> DataFrame:
    e = F.struct("fileA", "fileB", "coChanges", "couplingRatio")
    by_ratio = lambda x, y: F.when(x["couplingRatio"] > y["couplingRatio"], -1).when(x["couplingRatio"] < y["couplingRatio"], 1).when(x["fileA"] < y["fileA"], -1).when(x["fileA"] > y["fileA"], 1).when(x["fileB"] < y["fileB"], -1).otherwise(1)
    rows = edges.groupBy(*keys).agg(
        F.sort_array(F.array_distinct(F.concat(F.collect_list("fileA"), F.collect_list("fileB")))).alias("files"), F.collect_list(e).alias("edges"), F.avg("couplingRatio").alias("avgCoupling")
    )
    return rows.withColumn("edges", F.array_sort("edges", by_ratio))


def cluster_of_file(model: RepoModel, file_path: str, min_coupling: float = 0.3, max_size: int | None = None, since_ms: int | None = None) -> DataFrame:
    """The one cluster that holds a file, as ``coupling_clusters`` gives it, or no row.

    Without ``since_ms`` all coupled pairs inside the component are returned, those under ``min_coupling`` too.
    """
    edges = cluster_of_file_edges(model, file_path, min_coupling, since_ms)
    found = _clusters(edges.withColumn("clusterIndex", F.lit(1)), "clusterIndex")
    return found if max_size is None else found.where(F.size("files") <= max_size)


def cluster_of_file_edges(model: RepoModel, file_path: str, min_coupling: float = 0.3, since_ms: int | None = None, strong: DataFrame | None = None) -> DataFrame:
    """The named edges of that cluster. ``strong``: what ``strong_since`` has found, where that is at hand."""
    if since_ms is None:
        pairs = pair_ratios(model, None, smaller=False)
        strong = pairs.where(F.col("r") >= min_coupling)
    elif strong is None:
        strong = strong_since(model, min_coupling, since_ms)
    mine = reachable(strong, model.files.where(F.col("path") == file_path).select(F.col("file_id").alias("node")))
    inside = (pairs if since_ms is None else strong).join(mine.withColumnRenamed("node", "file_a_id"), "file_a_id", "left_semi").join(mine.withColumnRenamed("node", "file_b_id"), "file_b_id", "left_semi")
    return _named_edges(inside, model)


def strong_since(model: RepoModel, min_coupling: float, since_ms: int) -> DataFrame:
    """Recent pairs of ratio (over the larger total) at least ``min_coupling``, kept, as they are counted from the changes."""
    return cut_lineage(pair_ratios(model, since_ms, smaller=False).where(F.col("r") >= min_coupling))


def reachable(edges: DataFrame, seed: DataFrame, rounds: int = 30) -> DataFrame:
    """node: the nodes of ``edges`` in the component of the one in ``seed``; none where no edge has it.

    A frontier grows from the seed, so the work is that of the component. One that is still growing after ``rounds``, a long chain,
    is taken from the components of the whole graph, whose rounds are few.
    """
    pairs = edges.select(F.col("file_a_id").alias("u"), F.col("file_b_id").alias("v"))
    both = cut_lineage(pairs.union(pairs.select("v", "u")))
    seen = frontier = cut_lineage(seed.join(both.select(F.col("u").alias("node")).distinct(), "node", "left_semi"))
    for _ in range(rounds):
        next_ = both.join(frontier.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).distinct()
        frontier = cut_lineage(next_.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.union(frontier))
    labels = connected_components(both, "u", "v")
    return labels.join(labels.join(seed, "node", "left_semi").select("component"), "component", "left_semi").select("node")
