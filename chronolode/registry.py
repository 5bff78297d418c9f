"""Every query of the library over the star-schema tables, with the DuckDB SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions.scalar import basename, extension, is_binary_path, line_count, ticket_slug
from chronolode.operators import changes, coupling, overview, people
from chronolode.plans.complexity import file_metrics
from chronolode.plans.coupling import build_coupling
from chronolode.plans.renames import resolve_renames
from chronolode.session import cut_lineage, shared_path
from chronolode.sources import starschema, store
from chronolode.sources.mailmap import mailmap_frame, resolve_identities
from chronolode.sources.starschema import MAX_PATHS, NOW_MS, model
from chronolode.streaming.incremental import IncrementalIndex

SINCE_MS = 946_684_800_000


def coupled_model(spark: SparkSession, sf_dir: str):
    return model(spark, sf_dir, coupling=True)


def seed_path(m, smaller: bool) -> str:
    """The path of the file with the most partners (smaller) or of the largest cluster's first file; a single value."""
    if smaller:
        pairs = coupling.pair_ratios(m, None, smaller=True).where("r >= 0.05")
        ends = pairs.select(F.col("file_a_id").alias("file_id")).unionAll(pairs.select("file_b_id"))
        best = ends.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    else:
        labels = coupling.component_labels(coupling.cluster_edges(m, 0.07, capped=False))
        best = labels.groupBy(F.col("component").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    top = best.orderBy(F.desc("n"), "file_id").limit(1).join(m.files, "file_id").first()
    return top["path"] if top else "-"


def first_touched_path(m) -> str:
    """The path of the smallest file id with the most changes; a single value."""
    top = m.file_changes.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_id").limit(1)
    row = top.join(m.files, "file_id").first()
    return row["path"] if row else "-"


def stored_coupling(spark: SparkSession, sf_dir: str):
    m = coupled_model(spark, sf_dir)
    return type(m)(m.commits, m.files, m.file_changes, m.file_metrics, cut_lineage(m.file_coupling))


def q_file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    rows = overview.file_history(m, first_touched_path(m), limit=20)
    return rows.select("hash", "authorDate", "firstLine", "jiraSlug", F.array_join("filesChanged", "|").alias("filesChanged"))


def q_file_history_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    rows = overview.file_history(m, first_touched_path(m), since_ms=800_000_000_000, jira_slug="abc-%")
    return rows.select("hash", "authorDate", "firstLine", "jiraSlug", F.array_join("filesChanged", "|").alias("filesChanged"))


def q_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = coupling.labelled_edges(stored_coupling(spark, sf_dir), 0.07, capped=False)
    ends = edges.select("cluster", F.col("fileA").alias("path")).union(edges.select("cluster", F.col("fileB").alias("path")))
    return ends.distinct()


def flat_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.select("clusterIndex", F.array_join("files", "|").alias("files"), F.size("edges").alias("nEdges"), F.round("avgCoupling", 6).alias("avgCoupling"))


def q_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_clusters(coupling.coupling_clusters(stored_coupling(spark, sf_dir), 0.07, min_size=3, max_size=150, path_filter="src/%", top_n=20, capped=False))


def q_cluster_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_clusters(coupling.coupling_clusters(model(spark, sf_dir), 0.25, min_size=2, top_n=50, since_ms=SINCE_MS, capped=False))


def q_cluster_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_coupling(spark, sf_dir)
    return coupling.cluster_of_file_edges(m, seed_path(m, smaller=False), 0.07).select("fileA", "fileB", "coChanges", "couplingRatio")


def q_cluster_file_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of a file of the strongest recent pair."""
    m = model(spark, sf_dir)
    strong = coupling.strong_since(m, 0.2, SINCE_MS)  # the strongest of all pairs is here, or none has a cluster
    top = strong.orderBy(F.desc("r"), "file_a_id", "file_b_id").limit(1)
    seed = top.join(m.files, F.col("file_id") == F.col("file_a_id")).first()
    return coupling.cluster_of_file_edges(m, seed["path"] if seed else "-", 0.2, SINCE_MS, strong).select("fileA", "fileB", "coChanges", "couplingRatio")


def q_file_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_coupling(spark, sf_dir)
    return coupling.file_coupling(m, seed_path(m, smaller=True), top_n=50, min_coupling=0.05)


def q_file_coupling_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_coupling(spark, sf_dir)
    return coupling.file_coupling(m, seed_path(m, smaller=True), top_n=50, min_coupling=0.05, since_ms=SINCE_MS)


def q_file_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return people.file_authors(m, first_touched_path(m))


def q_slug_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starschema.commits(spark, sf_dir).select("hash", "first_line", ticket_slug(F.col("first_line")).alias("slug"))


def q_mailmap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are commit identities, regions the proper ones; the four forms of a line in turn."""
    nations = starschema.table(spark, sf_dir, "nation").join(starschema.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = ["# nations", ""]
    for r in nations.orderBy("n_nationkey").collect():  # a mailmap is a file that the driver reads
        commit, proper = f"<{r.n_name.upper()}@EXAMPLE.com>", f"<{r.r_name.lower()}@example.org>"
        forms = (f"{r.r_name} {commit}", f"{proper} {commit}", f"{r.r_name} {proper} {commit}", f"{r.r_name} {proper} {r.n_name.lower()} {commit}")
        lines += [forms[r.n_nationkey % 4], f"Too Late <late@example.org> {commit}"]
    commits = starschema.commits(spark, sf_dir).select("hash", F.col("author_name").alias("raw_name"), F.col("author_email").alias("raw_email"))
    return resolve_identities(commits, mailmap_frame(spark, lines)).select("hash", "author_name", "author_email")


def q_loc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starschema.table(spark, sf_dir, "documents").select("doc_id", line_count(F.col("text")).alias("loc"))


def q_binary_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = starschema.files(spark, sf_dir).select(F.when(F.col("file_id") % 3 == 0, F.concat("path", F.lit(".PNG"))).otherwise(F.col("path")).alias("path"))
    return paths.select("path", is_binary_path(F.col("path")).alias("is_binary"), basename(F.col("path")).alias("basename"), extension(F.col("path")).alias("extension"))


def rename_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of each part's file: made, renamed once or twice, changed under old and new names, made anew, or with two candidates."""
    p, part = F.col("p_partkey"), starschema.table(spark, sf_dir, "part")
    kinds = [  # which parts, commit after the part's first, path, status
        (F.lit(True), 0, "a", "A"), (p % 2 == 0, 1, "a", "M"), (p % 3 == 0, 2, "a", "D"), (p % 3 == 0, 2, "b", "A"), (p % 5 == 0, 3, "b", "M"),
        (p % 6 == 0, 4, "b", "D"), (p % 6 == 0, 4, "c", "A"), (p % 4 == 0, 5, "a", "A"), (p % 4 == 0, 6, "a", "M"), (p % 9 == 0, 4, "d", "A"), (p % 12 == 0, 7, "c", "D"), (p % 12 == 0, 7, "a", "A"), (p % 7 == 0, 8, "c", "M"),
    ]
    moves = F.array(*(F.when(which, F.struct((p * 10 + at).alias("ord"), F.concat(F.lit(f"{folder}/f"), p.cast("string")).alias("path"), F.lit(status).alias("status"))) for which, at, folder, status in kinds))
    return part.select(F.explode(F.filter(moves, lambda m: m.isNotNull())).alias("m")).select("m.ord", "m.path", "m.status")


def q_rename_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_renames(rename_entries(spark, sf_dir)).distinct()


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a class for each part, with a method of as many conditions as its size says and one of nested loops; text for others."""
    size = F.col("p_size")
    java = F.concat(
        F.lit("class C {\n  /* if (x) { */\n  int f(int a) {\n"), F.repeat(F.lit('    if (a > 0) { g("if ("); }\n'), size % 9), F.lit("    return a;\n  }\n  void h(boolean b, boolean c) {\n"),
        F.repeat(F.lit("for (;;) {\n"), size % 4), F.lit("k(b && c);\n"), F.repeat(F.lit("}\n"), size % 4), F.lit("  }\n}\n"),
    )
    is_java = size % 5 == 0
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.when(is_java, ".java").otherwise(".txt"))
    return starschema.table(spark, sf_dir, "part").select(path.alias("path"), F.when(is_java, java).otherwise(F.concat(F.col("p_name"), F.repeat(F.lit("\n"), size % 7))).cast("binary").alias("content"))


def q_incremental_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the index opened anew before each increment, and an increment that comes twice."""
    merges = starschema.commits(spark, sf_dir).select("commit_id", "is_merge")
    rows = starschema.file_changes(spark, sf_dir).join(merges, "commit_id").withColumn("part", F.col("commit_id") % 3)
    at = shared_path(spark, "reopened")
    for part in (0, 1, 1, 2):
        IncrementalIndex(spark, at, MAX_PATHS).absorb(rows.where(F.col("part") == part).drop("part"))
    return IncrementalIndex(spark, at, MAX_PATHS).coupling()


def q_cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each cluster in their order."""
    clusters = coupling.coupling_clusters(stored_coupling(spark, sf_dir), 0.07, min_size=3, max_size=150, top_n=20, capped=False)
    return clusters.select("clusterIndex", F.posexplode("edges").alias("place", "e")).select("clusterIndex", "place", "e.*")


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.summary(model(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("json"))


def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling after three streamed increments; must equal the full build."""
    merges = starschema.commits(spark, sf_dir).select("commit_id", "is_merge")
    rows = starschema.file_changes(spark, sf_dir).join(merges, "commit_id").withColumn("part", F.col("commit_id") % 3)
    root = shared_path(spark, "incremental")
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/landing")
    index = IncrementalIndex(spark, f"{root}/index", MAX_PATHS)
    index.run_available(f"{root}/landing", spark.read.parquet(f"{root}/landing").schema.simpleString()[7:-1].replace(":", " "))
    return index.coupling()


def q_upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with those of every third file measured anew."""
    metrics = starschema.file_metrics(spark, sf_dir).drop("analyzed_at")
    return store.upsert_replace(metrics, metrics.where("file_id % 3 = 0").withColumn("loc", F.col("loc") + 1), "file_id")


def q_upsert_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by file, those of odd commits added to those of even ones."""
    parts = [starschema.file_changes(spark, sf_dir).where(f"commit_id % 2 = {k}").groupBy("file_id").agg(F.count(F.lit(1)).alias("n")) for k in (0, 1)]
    return store.upsert_add(parts[0], parts[1], ["file_id"], ["n"])


def q_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits up to one, then all of them: each once."""
    commits = starschema.commits(spark, sf_dir).select("commit_id", "hash")
    return store.append_new(commits.where("commit_id < 1000"), commits.union(commits), "hash")


def q_delete_and_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without those of XML, and .py renamed."""
    files = starschema.files(spark, sf_dir)
    kept = store.delete_keys(files, files.where(F.col("path").endswith(".xml")).select("file_id"))
    python = kept.where(F.col("path").endswith(".py")).select(F.col("path").alias("old"), F.concat("path", F.lit("i")).alias("new"))
    return store.update_key(kept, "path", python)


def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(starschema.commits(spark, sf_dir), "hash", [f"c{k:010d}" for k in range(0, 600, 3)]).select("commit_id", "hash", "author_email")


def q_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as JSON text with their null fields, a row each."""
    commits = starschema.commits(spark, sf_dir).select(F.struct("hash", "author_date", "first_line", "jira_slug", "is_merge").alias("x"))
    return commits.select(F.to_json("x", {"ignoreNullFields": "false"}).alias("json"))


QUERIES = {
    "upsert_replace": q_upsert_replace,
    "upsert_add": q_upsert_add,
    "append_new": q_append_new,
    "delete_and_rename": q_delete_and_rename,
    "lookup": q_lookup,
    "to_json": q_to_json,
    "hotspots": lambda s, d: changes.hotspots(model(s, d), NOW_MS),
    "hotspots_since_ext_path": lambda s, d: changes.hotspots(model(s, d), NOW_MS, top_n=30, since_ms=SINCE_MS, extension=".java", path_filter="SRC/%"),
    "churn": lambda s, d: changes.churn(model(s, d)),
    "churn_since": lambda s, d: changes.churn(model(s, d), top_n=30, since_ms=SINCE_MS, extension=".ts", path_filter="src/%"),
    "file_authors": q_file_authors,
    "file_history": q_file_history,
    "file_history_slug": q_file_history_slug,
    "bus_factor": lambda s, d: people.bus_factor(model(s, d), top_n=1000, threshold=0.15),
    "ownership_commits": lambda s, d: people.ownership(model(s, d), top_n=500, by="commits", min_ownership=0.1, extension="java"),
    "ownership_lines": lambda s, d: people.ownership(model(s, d), top_n=500, by="lines", min_ownership=0.1, path_filter="src/%"),
    "coupling_build": lambda s, d: build_coupling(starschema.file_changes(s, d), starschema.commits(s, d), MAX_PATHS),
    "temporal_coupling": lambda s, d: coupling.temporal_coupling(coupled_model(s, d), top_n=100, min_coupling=0.08),
    "temporal_coupling_since": lambda s, d: coupling.temporal_coupling(model(s, d), top_n=100, min_coupling=0.3, since_ms=SINCE_MS),
    "temporal_coupling_filter": lambda s, d: coupling.temporal_coupling(coupled_model(s, d), top_n=100, min_coupling=0.05, file_filter="SRC/%.java"),
    "file_coupling": q_file_coupling,
    "file_coupling_since": q_file_coupling_since,
    "cluster_members": q_cluster_members,
    "cluster_summary": q_cluster_summary,
    "cluster_since": q_cluster_since,
    "cluster_file": q_cluster_file,
    "cluster_file_since": q_cluster_file_since,
    "stale_files": lambda s, d: changes.stale_files(model(s, d), NOW_MS, top_n=50),
    "summary_scalars": lambda s, d: overview.summary_scalars(model(s, d)),
    "summary_top_files": lambda s, d: overview.summary_top_files(model(s, d)),
    "summary_top_authors": lambda s, d: overview.summary_top_authors(model(s, d)),
    "language_distribution": lambda s, d: overview.language_distribution(model(s, d)),
    "slug_extract": q_slug_extract,
    "mailmap_resolve": q_mailmap_resolve,
    "loc_count": q_loc_count,
    "binary_class": q_binary_class,
    "rename_resolve": q_rename_resolve,
    "incremental_equals_full": q_incremental,
    "incremental_reopened": q_incremental_reopened,
    "file_metrics": lambda s, d: file_metrics(java_sources(s, d)),
    "cluster_edges": q_cluster_edges,
    "summary": q_summary,
}

BASE = r"""WITH RECURSIVE commits AS (
  SELECT o_orderkey AS commit_id, 'c' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS hash, epoch_ms(o_orderdate) AS author_date, line AS first_line,
         nullif(regexp_extract(trim(line), '^[A-Z]{2,4}-[0-9]+'), '') AS jira_slug,
         lower(n_name) || '@example.com' AS author_email, n_name AS author_name, o_orderstatus = 'P' AS is_merge
  FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE
          CASE o_orderkey % 3 WHEN 0 THEN 'ABC-' WHEN 1 THEN 'PROJ-' ELSE 'XY-' END || CAST(o_orderkey % 50 AS VARCHAR) || ' ' || o_orderpriority END AS line FROM orders)
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
files AS (
  SELECT p_partkey AS file_id, 'src/' || lower(p_type) || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) ||
         (['.java', '.ts', '.py', '.xml', ''])[p_size % 5 + 1] AS path FROM part),
file_changes AS (
  SELECT l_orderkey AS commit_id, l_partkey AS file_id, CAST(l_quantity AS INTEGER) AS lines_added, CAST(l_linenumber AS INTEGER) AS lines_deleted FROM lineitem),
file_metrics AS (
  SELECT p_partkey AS file_id, CAST(p_size * 10 AS INTEGER) AS loc, CAST(CASE WHEN p_size % 5 = 0 THEN p_size ELSE -1 END AS INTEGER) AS cyclomatic_complexity,
         CAST(CASE WHEN p_size % 5 = 0 THEN p_size * 2 ELSE -1 END AS INTEGER) AS cognitive_complexity FROM part WHERE p_size % 7 <> 0),
touched AS (SELECT DISTINCT commit_id, file_id FROM file_changes),
totals AS (SELECT file_id, CAST(count(*) AS INTEGER) AS n FROM file_changes GROUP BY file_id),
paired AS (
  SELECT t.commit_id, t.file_id FROM touched t JOIN commits c USING (commit_id)
  JOIN (SELECT commit_id FROM touched GROUP BY commit_id HAVING count(*) <= 8) USING (commit_id) WHERE NOT c.is_merge),
file_coupling AS (
  SELECT p.*, ta.n AS total_changes_a, tb.n AS total_changes_b FROM (
    SELECT a.file_id AS file_a_id, b.file_id AS file_b_id, CAST(count(*) AS INTEGER) AS co_changes
    FROM paired a JOIN paired b ON a.commit_id = b.commit_id AND a.file_id < b.file_id GROUP BY ALL) p
  JOIN totals ta ON ta.file_id = file_a_id JOIN totals tb ON tb.file_id = file_b_id),
recent AS (SELECT DISTINCT commit_id, file_id FROM file_changes JOIN commits USING (commit_id) WHERE author_date >= 946684800000),
recent_totals AS (SELECT file_id, CAST(count(*) AS INTEGER) AS n FROM recent GROUP BY file_id),
recent_coupling AS (
  SELECT p.*, ta.n AS total_changes_a, tb.n AS total_changes_b FROM (
    SELECT a.file_id AS file_a_id, b.file_id AS file_b_id, CAST(count(*) AS INTEGER) AS co_changes
    FROM recent a JOIN recent b ON a.commit_id = b.commit_id AND a.file_id < b.file_id GROUP BY ALL) p
  JOIN recent_totals ta ON ta.file_id = file_a_id JOIN recent_totals tb ON tb.file_id = file_b_id),
"""


def _hotspots(top_n: int, where: str, files_where: str) -> str:
    return BASE + f"""age AS (SELECT file_id, min(author_date) AS a, max(author_date) AS z FROM file_changes JOIN commits USING (commit_id) GROUP BY file_id),
picked AS (
  SELECT path, count(*) AS n, any_value(loc) AS loc, any_value(cyclomatic_complexity) AS cyclo, any_value(cognitive_complexity) AS cogni, any_value(a) AS a, any_value(z) AS z
  FROM file_changes JOIN commits USING (commit_id) JOIN files USING (file_id) JOIN file_metrics USING (file_id) JOIN age USING (file_id)
  WHERE {where} AND {files_where} GROUP BY path ORDER BY n DESC, path LIMIT {top_n}),
ranged AS (
  SELECT *, min(n) OVER () AS n0, max(n) OVER () AS n1, coalesce(min(CASE WHEN cyclo > 0 THEN cyclo END) OVER (), 0) AS c0, coalesce(max(CASE WHEN cyclo > 0 THEN cyclo END) OVER (), 1) AS c1,
         coalesce(min(CASE WHEN loc > 0 THEN loc END) OVER (), 0) AS l0, coalesce(max(CASE WHEN loc > 0 THEN loc END) OVER (), 1) AS l1 FROM picked)
SELECT path, CAST(n AS INTEGER) AS "changeFrequency", loc AS "linesOfCode", cyclo AS "cyclomaticComplexity", cogni AS "cognitiveComplexity",
       (CASE WHEN n0 = n1 THEN 1.0::DOUBLE ELSE (n - n0)::DOUBLE / (n1 - n0)::DOUBLE END) *
       (CASE WHEN cyclo > 0 THEN CASE WHEN c0 = c1 THEN 1.0::DOUBLE ELSE (cyclo - c0)::DOUBLE / (c1 - c0)::DOUBLE END
             WHEN loc > 0 THEN CASE WHEN l0 = l1 THEN 1.0::DOUBLE ELSE (loc - l0)::DOUBLE / (l1 - l0)::DOUBLE END ELSE 0.0::DOUBLE END) AS "hotspotScore",
       (1000000000000 - a) // 86400000 AS "ageInDays", (1000000000000 - z) // 86400000 AS "daysSinceLastChange"
FROM ranged"""  # fmt: skip


def _churn(top_n: int, where: str) -> str:
    return BASE + f"""dummy AS (SELECT 1)
SELECT path AS "filePath", CAST(sum(lines_added) AS BIGINT) AS "linesAdded", CAST(sum(lines_deleted) AS BIGINT) AS "linesDeleted",
       CAST(sum(lines_added + lines_deleted) AS BIGINT) AS churn, CAST(count(DISTINCT commit_id) AS INTEGER) AS "changeFrequency"
FROM file_changes JOIN files USING (file_id) JOIN commits USING (commit_id) JOIN file_metrics USING (file_id)
WHERE {where} GROUP BY path HAVING sum(lines_added + lines_deleted) > 0 ORDER BY churn DESC, path LIMIT {top_n}"""


def _owners(amount: str, ratio_where: str, top_n: int, columns: str) -> str:
    return BASE + f"""by_author AS (
  SELECT file_id, author_email, max(author_name) AS author_name, CAST({amount} AS BIGINT) AS amount FROM file_changes JOIN commits USING (commit_id) GROUP BY ALL),
sums AS (SELECT file_id, CAST(sum(amount) AS BIGINT) AS total, max(amount) AS best FROM by_author GROUP BY file_id HAVING sum(amount) > 0),
ranked AS (
  SELECT path, author_email, author_name, amount, total, amount::DOUBLE / total::DOUBLE AS r FROM sums JOIN by_author USING (file_id) JOIN files USING (file_id)
  JOIN file_metrics USING (file_id) WHERE amount = best AND {ratio_where} ORDER BY r DESC, total DESC, path, author_email LIMIT {top_n})
SELECT path AS "filePath", author_email AS "topAuthorEmail", author_name AS "topAuthorName", {columns} FROM ranked"""


def _pairs(table: str, where: str, top_n: int) -> str:
    return BASE + f"""named AS (
  SELECT fa.path AS a, fb.path AS b, co_changes, total_changes_a, total_changes_b, co_changes::DOUBLE / least(total_changes_a, total_changes_b)::DOUBLE AS r
  FROM {table} JOIN files fa ON fa.file_id = file_a_id JOIN files fb ON fb.file_id = file_b_id)
SELECT a AS "fileA", b AS "fileB", co_changes AS "coChanges", total_changes_a AS "totalChangesA", total_changes_b AS "totalChangesB", r AS "couplingRatio"
FROM named WHERE {where} ORDER BY r DESC, co_changes DESC, a, b LIMIT {top_n}"""


PARTNER_SEED = """ends AS (
  SELECT unnest([file_a_id, file_b_id]) AS file_id FROM file_coupling WHERE co_changes::DOUBLE / least(total_changes_a, total_changes_b) >= 0.05),
seed AS (SELECT file_id FROM ends GROUP BY file_id ORDER BY count(*) DESC, file_id LIMIT 1),
"""


def _partners(table: str) -> str:
    return BASE + PARTNER_SEED + f"""sided AS (
  SELECT file_b_id AS file_id, co_changes, total_changes_a AS t, total_changes_b AS p FROM {table} WHERE file_a_id = (SELECT file_id FROM seed)
  UNION ALL SELECT file_a_id, co_changes, total_changes_b, total_changes_a FROM {table} WHERE file_b_id = (SELECT file_id FROM seed))
SELECT path AS "partnerPath", co_changes AS "coChanges", t AS "targetTotalChanges", p AS "partnerTotalChanges", co_changes::DOUBLE / least(t, p)::DOUBLE AS "couplingRatio"
FROM sided JOIN files USING (file_id) WHERE co_changes::DOUBLE / least(t, p)::DOUBLE >= 0.05 ORDER BY "couplingRatio" DESC, co_changes DESC, path LIMIT 50"""


def _labelled(table: str, least: float, name: str = "") -> str:
    return f"""edges{name} AS (SELECT *, co_changes::DOUBLE / greatest(total_changes_a, total_changes_b)::DOUBLE AS r FROM {table}
  WHERE co_changes::DOUBLE / greatest(total_changes_a, total_changes_b)::DOUBLE >= {least}),
both_ways{name} AS (SELECT file_a_id AS u, file_b_id AS v FROM edges{name} UNION ALL SELECT file_b_id, file_a_id FROM edges{name}),
reach{name} AS (SELECT u AS node, u AS other FROM both_ways{name} UNION SELECT r.node, b.v FROM reach{name} r JOIN both_ways{name} b ON b.u = r.other),
labels{name} AS (SELECT node, min(other) AS cluster FROM reach{name} GROUP BY node),
"""


CLUSTERS = """named AS (SELECT cluster, fa.path AS a, fb.path AS b, r FROM edges JOIN labels ON node = file_a_id JOIN files fa ON fa.file_id = file_a_id JOIN files fb ON fb.file_id = file_b_id),
members AS (SELECT cluster, string_agg(path, '|' ORDER BY path) AS files, count(*) AS n, min(path) AS least_path, bool_or(path LIKE 'src/%') AS fits
  FROM (SELECT cluster, a AS path FROM named UNION SELECT cluster, b FROM named) GROUP BY cluster),
means AS (SELECT cluster, avg(r) AS m, CAST(count(*) AS INTEGER) AS e FROM named GROUP BY cluster)
"""


def _clusters(table: str, least: float, where: str, top_n: int) -> str:
    return BASE + _labelled(table, least) + CLUSTERS + f"""
SELECT CAST(row_number() OVER (ORDER BY m DESC, least_path) AS INTEGER) AS "clusterIndex", files, e AS "nEdges", round(m, 6) AS "avgCoupling"
FROM members JOIN means USING (cluster) WHERE {where} ORDER BY m DESC, least_path LIMIT {top_n}"""


CLUSTER_SEED = _labelled("file_coupling", 0.07) + """
seed AS (SELECT cluster AS file_id FROM labels GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 1),
"""
EDGE_COLUMNS = """SELECT fa.path AS "fileA", fb.path AS "fileB", co_changes AS "coChanges", co_changes::DOUBLE / greatest(total_changes_a, total_changes_b)::DOUBLE AS "couplingRatio" """
HISTORY_SEED = "seed AS (SELECT file_id FROM file_changes GROUP BY file_id ORDER BY count(*) DESC, file_id LIMIT 1),\n"


def _history(where: str, limit: int) -> str:
    return BASE + HISTORY_SEED + f"""picked AS (
  SELECT * FROM commits WHERE commit_id IN (SELECT commit_id FROM file_changes WHERE file_id = (SELECT file_id FROM seed)) AND {where} ORDER BY author_date DESC, hash LIMIT {limit})
SELECT hash, any_value(author_date) AS "authorDate", any_value(first_line) AS "firstLine", any_value(jira_slug) AS "jiraSlug", string_agg(path, '|' ORDER BY path) AS "filesChanged"
FROM picked JOIN file_changes USING (commit_id) JOIN files USING (file_id) GROUP BY hash"""


RENAME_ENTRIES = """parts AS (SELECT p_partkey::BIGINT AS p FROM part),
raw(ord, path, status) AS (SELECT p * 10, 'a/f' || p, 'A' FROM parts
  UNION ALL SELECT p * 10 + 1, 'a/f' || p, 'M' FROM parts WHERE p % 2 = 0
  UNION ALL SELECT p * 10 + 2, unnest(['a/f' || p, 'b/f' || p]), unnest(['D', 'A']) FROM parts WHERE p % 3 = 0
  UNION ALL SELECT p * 10 + 3, 'b/f' || p, 'M' FROM parts WHERE p % 5 = 0
  UNION ALL SELECT p * 10 + 4, unnest(['b/f' || p, 'c/f' || p]), unnest(['D', 'A']) FROM parts WHERE p % 6 = 0
  UNION ALL SELECT p * 10 + 5, 'a/f' || p, 'A' FROM parts WHERE p % 4 = 0
  UNION ALL SELECT p * 10 + 6, 'a/f' || p, 'M' FROM parts WHERE p % 4 = 0
  UNION ALL SELECT p * 10 + 4, 'd/f' || p, 'A' FROM parts WHERE p % 9 = 0
  UNION ALL SELECT p * 10 + 7, unnest(['c/f' || p, 'a/f' || p]), unnest(['D', 'A']) FROM parts WHERE p % 12 = 0
  UNION ALL SELECT p * 10 + 8, 'c/f' || p, 'M' FROM parts WHERE p % 7 = 0)"""

SQL = {
    "hotspots": _hotspots(20, "true", "true"),
    "hotspots_since_ext_path": _hotspots(30, "author_date >= 946684800000", "path ILIKE '%.java' AND path ILIKE 'SRC/%'"),
    "churn": _churn(20, "true"),
    "churn_since": _churn(30, "author_date >= 946684800000 AND path ILIKE '%.ts' AND path ILIKE 'src/%'"),
    "file_authors": BASE + HISTORY_SEED + """dummy AS (SELECT 1)
SELECT author_email AS "authorEmail", max(author_name) AS "authorName", CAST(count(*) AS INTEGER) AS "commitCount" FROM file_changes JOIN commits USING (commit_id)
WHERE file_id = (SELECT file_id FROM seed) GROUP BY author_email ORDER BY "commitCount" DESC, author_email LIMIT 10""",
    "file_history": _history("true", 20),
    "file_history_slug": _history("author_date >= 800000000000 AND jira_slug ILIKE 'abc-%'", 50),
    "bus_factor": _owners("count(*)", "amount::DOUBLE / total::DOUBLE >= 0.15", 1000, 'CAST(amount AS INTEGER) AS "topAuthorCommits", CAST(total AS INTEGER) AS "totalCommits", r AS "dominanceRatio"'),
    "ownership_commits": _owners("count(*)", "amount::DOUBLE / total::DOUBLE >= 0.1 AND path ILIKE '%.java'", 500, 'amount AS "topAuthorAmount", total AS "totalAmount", r AS "ownershipRatio"'),
    "ownership_lines": _owners("sum(lines_added)", "amount::DOUBLE / total::DOUBLE >= 0.1 AND path ILIKE 'src/%'", 500, 'amount AS "topAuthorAmount", total AS "totalAmount", r AS "ownershipRatio"'),
    "coupling_build": BASE + "dummy AS (SELECT 1) SELECT * FROM file_coupling",
    "temporal_coupling": _pairs("file_coupling", "r >= 0.08", 100),
    "temporal_coupling_since": _pairs("recent_coupling", "r >= 0.3", 100),
    "temporal_coupling_filter": _pairs("file_coupling", "r >= 0.05 AND (a ILIKE 'SRC/%.java' OR b ILIKE 'SRC/%.java')", 100),
    "file_coupling": _partners("file_coupling"),
    "file_coupling_since": _partners("recent_coupling"),
    "cluster_members": BASE + _labelled("file_coupling", 0.07) + "dummy AS (SELECT 1) SELECT cluster, path FROM labels JOIN files ON file_id = node",
    "cluster_summary": _clusters("file_coupling", 0.07, "n >= 3 AND n <= 150 AND fits", 20),
    "cluster_since": _clusters("recent_coupling", 0.25, "n >= 2", 50),
    "cluster_file": BASE + CLUSTER_SEED + f"""mine AS (SELECT node FROM labels WHERE cluster = (SELECT file_id FROM seed))
{EDGE_COLUMNS} FROM file_coupling JOIN files fa ON fa.file_id = file_a_id JOIN files fb ON fb.file_id = file_b_id
WHERE file_a_id IN (FROM mine) AND file_b_id IN (FROM mine)""",
    "cluster_file_since": BASE + _labelled("recent_coupling", 0.2, "_r") + f"""
seed AS (SELECT file_a_id AS file_id FROM recent_coupling ORDER BY co_changes::DOUBLE / greatest(total_changes_a, total_changes_b)::DOUBLE DESC, file_a_id, file_b_id LIMIT 1),
mine AS (SELECT node FROM labels_r WHERE cluster = (SELECT cluster FROM labels_r WHERE node = (SELECT file_id FROM seed)))
{EDGE_COLUMNS} FROM edges_r JOIN files fa ON fa.file_id = file_a_id JOIN files fb ON fb.file_id = file_b_id
WHERE file_a_id IN (FROM mine) AND file_b_id IN (FROM mine)""",
    "stale_files": BASE + """aged AS (
  SELECT path, any_value(loc) AS loc, any_value(cyclomatic_complexity) AS cyclo, max(author_date) AS z, min(author_date) AS a
  FROM file_changes JOIN commits USING (commit_id) JOIN files USING (file_id) LEFT JOIN file_metrics USING (file_id) GROUP BY path
  HAVING max(author_date) <= 1000000000000 - 180::BIGINT * 86400000 ORDER BY z, path LIMIT 150),
filled AS (SELECT path, coalesce(loc, 0) AS loc, coalesce(cyclo, -1) AS cyclo, (1000000000000 - z) // 86400000 AS days, (1000000000000 - a) // 86400000 AS age FROM aged),
ranged AS (
  SELECT *, min(days) OVER () AS n0, max(days) OVER () AS n1, coalesce(min(CASE WHEN cyclo > 0 THEN cyclo END) OVER (), 0) AS c0, coalesce(max(CASE WHEN cyclo > 0 THEN cyclo END) OVER (), 1) AS c1,
         coalesce(min(CASE WHEN loc > 0 THEN loc END) OVER (), 0) AS l0, coalesce(max(CASE WHEN loc > 0 THEN loc END) OVER (), 1) AS l1 FROM filled)
SELECT path AS "filePath", days AS "daysSinceLastChange", age AS "ageInDays", loc, cyclo AS "cyclomaticComplexity",
       (CASE WHEN n0 = n1 THEN 1.0::DOUBLE ELSE (days - n0)::DOUBLE / (n1 - n0)::DOUBLE END) *
       (CASE WHEN cyclo > 0 THEN CASE WHEN c0 = c1 THEN 1.0::DOUBLE ELSE (cyclo - c0)::DOUBLE / (c1 - c0)::DOUBLE END
             WHEN loc > 0 THEN CASE WHEN l0 = l1 THEN 1.0::DOUBLE ELSE (loc - l0)::DOUBLE / (l1 - l0)::DOUBLE END ELSE 0.0::DOUBLE END) AS "stalenessScore"
FROM ranged ORDER BY "stalenessScore" DESC, days DESC, path LIMIT 50""",
    "summary_scalars": BASE + """dummy AS (SELECT 1)
SELECT CAST(count(*) AS INTEGER) AS "totalCommits", CAST(count(DISTINCT author_email) AS INTEGER) AS "uniqueAuthors",
       (SELECT CAST(count(DISTINCT file_id) AS INTEGER) FROM file_changes) AS "totalFilesTracked", (SELECT CAST(count(*) AS INTEGER) FROM file_metrics) AS "filesWithMetrics",
       coalesce(min(author_date), 0) AS "earliestCommitMs", coalesce(max(author_date), 0) AS "latestCommitMs" FROM commits""",
    "summary_top_files": BASE + """dummy AS (SELECT 1)
SELECT path AS "filePath", CAST(count(*) AS INTEGER) AS "changeFrequency" FROM file_changes JOIN files USING (file_id) JOIN file_metrics USING (file_id)
GROUP BY path ORDER BY count(*) DESC, path LIMIT 5""",
    "summary_top_authors": BASE + """dummy AS (SELECT 1)
SELECT max(author_name) AS name, author_email AS email, CAST(count(*) AS INTEGER) AS commits FROM commits GROUP BY author_email ORDER BY count(*) DESC, email LIMIT 5""",
    "language_distribution": BASE + r"""dummy AS (SELECT 1)
SELECT coalesce(nullif(regexp_extract(path, '[.][^.]*$'), ''), '(no ext)') AS extension, CAST(count(*) AS INTEGER) AS "fileCount" FROM files GROUP BY 1""",
    "slug_extract": BASE + "dummy AS (SELECT 1) SELECT hash, first_line, jira_slug AS slug FROM commits",
    "mailmap_resolve": BASE + """dummy AS (SELECT 1)
SELECT hash, CASE WHEN n_nationkey % 4 = 1 THEN n_name ELSE r_name END AS author_name, CASE WHEN n_nationkey % 4 = 0 THEN author_email ELSE lower(r_name) || '@example.org' END AS author_email
FROM commits JOIN nation ON n_name = author_name JOIN region ON r_regionkey = n_regionkey""",
    "loc_count": "SELECT doc_id, CAST(CASE WHEN contains(text, chr(0)) THEN NULL WHEN text = '' THEN 0 ELSE 1 + length(text) - length(replace(text, chr(10), '')) END AS INTEGER) AS loc FROM documents",
    "binary_class": BASE + r"""p AS (SELECT path || CASE WHEN file_id % 3 = 0 THEN '.PNG' ELSE '' END AS path FROM files)
SELECT path, path LIKE '%.PNG' AS is_binary, regexp_extract(path, '[^/]*$') AS basename, coalesce(nullif(regexp_extract(path, '[.][^.]*$'), ''), '(no ext)') AS extension FROM p""",
    "rename_resolve": f"""WITH RECURSIVE {RENAME_ENTRIES},
e AS (SELECT DISTINCT ord, path, status, regexp_extract(path, '[^/]*$') AS base FROM raw),
pairs AS (SELECT ord, max(path) FILTER (status = 'D') AS old, max(path) FILTER (status = 'A') AS new FROM e WHERE status IN ('A', 'D')
  GROUP BY ord, base HAVING count(*) FILTER (status = 'D') = 1 AND count(*) FILTER (status = 'A') = 1),
firsts AS (SELECT path, min(ord) AS first_ord FROM e GROUP BY path),
renames AS (SELECT p.* FROM pairs p JOIN firsts ON path = new WHERE first_ord >= ord),
kept AS (SELECT e.ord, e.path, e.status FROM e LEFT JOIN renames r ON r.ord = e.ord AND r.old = e.path AND e.status = 'D' WHERE r.ord IS NULL),
walk(ord, path, now, since, hop) AS (SELECT DISTINCT ord, path, path, ord, 0 FROM kept
  UNION ALL SELECT w.ord, w.path, r.new, r.ord + 1, w.hop + 1 FROM walk w JOIN renames r ON r.old = w.now AND r.ord >= w.since
    WHERE NOT EXISTS (SELECT 1 FROM renames x WHERE x.old = w.now AND x.ord >= w.since AND x.ord < r.ord)),
ends AS (SELECT ord, path, arg_max(now, hop) AS final_path FROM walk GROUP BY ord, path)
SELECT ord, path, status, final_path FROM kept JOIN ends USING (ord, path)""",
    "file_metrics": """SELECT 'src/p' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '.java' ELSE '.txt' END AS path,
  CAST(CASE WHEN p_size % 5 = 0 THEN 9 + p_size % 9 + 2 * (p_size % 4) ELSE 1 + p_size % 7 END AS INTEGER) AS loc,
  CAST(CASE WHEN p_size % 5 = 0 THEN greatest(1 + p_size % 9, 2 + p_size % 4) ELSE -1 END AS INTEGER) AS cyclomatic_complexity,
  CAST(CASE WHEN p_size % 5 = 0 THEN greatest(p_size % 9, 1 + (p_size % 4) * (p_size % 4 + 1) // 2) ELSE -1 END AS INTEGER) AS cognitive_complexity FROM part""",
    "cluster_edges": BASE + _labelled("file_coupling", 0.07) + """named AS (SELECT cluster, fa.path AS a, fb.path AS b, co_changes, r FROM edges JOIN labels ON node = file_a_id JOIN files fa ON fa.file_id = file_a_id JOIN files fb ON fb.file_id = file_b_id),
members AS (SELECT cluster, count(*) AS n, min(path) AS least_path FROM (SELECT cluster, a AS path FROM named UNION SELECT cluster, b FROM named) GROUP BY cluster),
means AS (SELECT cluster, avg(r) AS m FROM named GROUP BY cluster),
picked AS (SELECT cluster, CAST(row_number() OVER (ORDER BY m DESC, least_path) AS INTEGER) AS "clusterIndex" FROM members JOIN means USING (cluster) WHERE n BETWEEN 3 AND 150 ORDER BY m DESC, least_path LIMIT 20)
SELECT "clusterIndex", CAST(row_number() OVER (PARTITION BY cluster ORDER BY r DESC, a, b) - 1 AS INTEGER) AS place, a AS "fileA", b AS "fileB", co_changes AS "coChanges", r AS "couplingRatio" FROM named JOIN picked USING (cluster)""",
    "summary": BASE + """frequent AS (SELECT path, CAST(count(*) AS INTEGER) AS n FROM file_changes JOIN files USING (file_id) JOIN file_metrics USING (file_id) GROUP BY path ORDER BY n DESC, path LIMIT 5),
authors AS (SELECT max(author_name) AS name, author_email AS email, CAST(count(*) AS INTEGER) AS commits FROM commits GROUP BY author_email ORDER BY count(*) DESC, email LIMIT 5),
languages AS (SELECT coalesce(nullif(regexp_extract(path, '[.][^.]*$'), ''), '(no ext)') AS extension, CAST(count(*) AS INTEGER) AS "fileCount" FROM files GROUP BY 1)
SELECT CAST(to_json(struct_pack("totalCommits" := count(*), "uniqueAuthors" := count(DISTINCT author_email), "totalFilesTracked" := (SELECT count(DISTINCT file_id) FROM file_changes),
  "filesWithMetrics" := (SELECT count(*) FROM file_metrics), "earliestCommitMs" := coalesce(min(author_date), 0), "latestCommitMs" := coalesce(max(author_date), 0),
  "topChangedFiles" := (SELECT list(struct_pack("filePath" := path, "changeFrequency" := n) ORDER BY n DESC, path) FROM frequent),
  "topAuthors" := (SELECT list(struct_pack(name := name, email := email, commits := commits) ORDER BY commits DESC, email) FROM authors),
  "languageDistribution" := (SELECT list(struct_pack(extension := extension, "fileCount" := "fileCount") ORDER BY "fileCount" DESC, extension) FROM languages))) AS VARCHAR) AS json FROM commits""",
}
SQL["upsert_replace"] = BASE + "dummy AS (SELECT 1) SELECT * REPLACE (CAST(loc + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS loc) FROM file_metrics"
SQL["upsert_add"] = BASE + "dummy AS (SELECT 1) SELECT file_id, count(*)::BIGINT AS n FROM file_changes GROUP BY file_id"
SQL["append_new"] = BASE + "dummy AS (SELECT 1) SELECT commit_id, hash FROM commits"
SQL["delete_and_rename"] = BASE + "dummy AS (SELECT 1) SELECT file_id, CASE WHEN path LIKE '%.py' THEN path || 'i' ELSE path END AS path FROM files WHERE path NOT LIKE '%.xml'"
SQL["lookup"] = BASE + "dummy AS (SELECT 1) SELECT commit_id, hash, author_email FROM commits WHERE commit_id < 600 AND commit_id % 3 = 0"
SQL["to_json"] = BASE + """dummy AS (SELECT 1)
SELECT CAST(to_json(struct_pack(hash := hash, author_date := author_date, first_line := first_line, jira_slug := jira_slug, is_merge := is_merge)) AS VARCHAR) AS json FROM commits"""
SQL["incremental_equals_full"] = SQL["coupling_build"]
SQL["incremental_reopened"] = SQL["coupling_build"]
