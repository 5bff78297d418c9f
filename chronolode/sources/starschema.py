"""The star-schema tables read as a repository: orders are commits, parts are files, line items are changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions.scalar import ticket_slug
from chronolode.plans.coupling import build_coupling
from chronolode.plans.model import RepoModel

NOW_MS, MAX_PATHS = 1_000_000_000_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_first_line() -> F.Column:
    key = F.col("o_orderkey")
    prefix = F.when(key % 3 == 0, "ABC-").when(key % 3 == 1, "PROJ-").otherwise("XY-")
    return F.when(key % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat(prefix, (key % 50).cast("string"), F.lit(" "), F.col("o_orderpriority")))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # 25 nations and, against the orders, few customers
    authors = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = table(spark, sf_dir, "orders").join(authors, "o_custkey")
    return rows.select(
        F.col("o_orderkey").alias("commit_id"),
        F.concat(F.lit("c"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("hash"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("author_date"),
        raw_first_line().alias("first_line"),
        ticket_slug(raw_first_line()).alias("jira_slug"),
        F.concat(F.lower("n_name"), F.lit("@example.com")).alias("author_email"),
        F.col("n_name").alias("author_name"),
        (F.col("o_orderstatus") == "P").alias("is_merge"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".java", ".ts", ".py", ".xml", ""))), F.col("p_size") % 5 + 1)
    path = F.concat(
        F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), ending,
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), path.alias("path"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file_id"), F.col("l_quantity").cast("int").alias("lines_added"), F.col("l_linenumber").cast("int").alias("lines_deleted")
    )


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    java = F.col("p_size") % 5 == 0
    return table(spark, sf_dir, "part").where("p_size % 7 <> 0").select(
        F.col("p_partkey").alias("file_id"), (F.col("p_size") * 10).cast("int").alias("loc"),
        F.when(java, F.col("p_size")).otherwise(-1).cast("int").alias("cyclomatic_complexity"),
        F.when(java, F.col("p_size") * 2).otherwise(-1).cast("int").alias("cognitive_complexity"), F.lit(NOW_MS).cast("long").alias("analyzed_at"),
    )


def model(spark: SparkSession, sf_dir: str, coupling: bool = False) -> RepoModel:
    c, changes = commits(spark, sf_dir), file_changes(spark, sf_dir)
    return RepoModel(c, files(spark, sf_dir), changes, file_metrics(spark, sf_dir), build_coupling(changes, c, MAX_PATHS) if coupling else None)
