"""Two-pass external shuffle of documents into shards.

Pass one scatters records into memory-sized buckets by a seeded hash of the whole record. Records of an id and text that repeat over
``HOT_ROWS`` times are first joined into one a distinct record and then numbered, and the number goes into the hash, so that equal records part
and still fall alike in a rerun. Pass two
brings each bucket to one task, puts it in a canonical order, shuffles it by Fisher-Yates with a generator
seeded by (seed, bucket), and writes it. Buckets laid end to end are a global random order; shard s of n takes
positions floor(s N / n) to floor((s + 1) N / n) - 1 of it, so shard counts are at most one apart and a bucket
goes to one or two shard files. A rerun task makes the same rows.

Defined results: a null text has size 1 and the CRC of no bytes; null ids are ordinary. Columns that can't be hashed (maps) are carried, but
rows that differ in nothing else may change places in a rerun, and such rows share a bucket where they repeat.
"""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.session import cut_lineage, shared_path

BUCKET_BYTES, HOT_ROWS, SENT_KEYS, BUCKETS_EACH = 24 << 20, 1000, 100_000, 4096


def fisher_yates(n: int, seed: int) -> list[int]:
    """A uniform permutation of range(n)."""
    order, draw = list(range(n)), random.Random(seed)._randbelow
    for i in range(n - 1, 0, -1):
        j = draw(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def _numbered(rows: DataFrame, id_col: str, hashed: list[Column]) -> DataFrame:
    """``rows`` with ``_copy``, a number that tells equal records of a hot id and text apart; 0 for all others."""
    keys = F.col(id_col).eqNullSafe(F.col("_hot_id")) & (F.col("_crc32") == F.col("_hot_crc")) & (F.col("_size") == F.col("_hot_size"))
    hot = rows.groupBy(F.col(id_col).alias("_hot_id"), F.col("_crc32").alias("_hot_crc"), F.col("_size").alias("_hot_size")).agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(hot.where(F.col("n") > HOT_ROWS).drop("n"))
    n_hot = hot.count()
    if not n_hot or len(hashed) < len(rows.columns):
        return rows.withColumn("_copy", F.lit(0))
    hot = F.broadcast(hot) if n_hot <= SENT_KEYS else hot
    joined = rows.join(hot, keys, "left_semi").groupBy(*(f"`{c}`" for c in rows.columns)).agg(F.count(F.lit(1)).alias("_copies"))
    apart = joined.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1))).select(*(f"`{c}`" for c in rows.columns), "_copy")
    return rows.join(hot, keys, "left_anti").withColumn("_copy", F.lit(0)).unionByName(apart)


def _first_places(counts: DataFrame) -> DataFrame:
    """_bucket, _first: the rows in all buckets before; sums run within spans of ``BUCKETS_EACH`` buckets, then over the spans."""
    spans = cut_lineage(counts.withColumn("span", F.floor(F.col("_bucket") / BUCKETS_EACH)))
    before = lambda w: F.sum("n").over(w) - F.col("n")
    starts = spans.groupBy("span").agg(F.sum("n").alias("n")).select("span", before(Window.orderBy("span")).alias("start"))  # a row for each of many buckets
    inside = spans.select("_bucket", "span", before(Window.partitionBy("span").orderBy("_bucket")).alias("inside"))
    return inside.join(F.broadcast(starts), "span").select("_bucket", (F.col("start") + F.col("inside")).alias("_first"))


def shard_documents(docs: DataFrame, n_shards: int, path: str, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes ``docs`` as Parquet below ``path``, a folder a shard, and returns it read back.

    Added columns, replacing any of the same names: ``_size`` (UTF-8 bytes and 1), ``_crc32``, ``_shard``, ``_slot``.
    """
    own = ("_size", "_crc32", "_shard", "_slot", "_bucket", "_first", "_mark", "_copy")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = docs.drop(*own).columns
    docs = docs.drop(*own).toDF(*(c.replace(".", "\u2024") for c in names))  # grouped functions can't name columns with dots
    rows = docs.withColumn("_size", F.octet_length(body).cast("long") + 1).withColumn("_crc32", F.crc32(body))
    told = rows.agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n_buckets = told["n"], max(1, -(-(told["b"] or 0) // bucket_bytes))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    scattered = _numbered(rows, id_col, hashed).withColumn("_mark", F.xxhash64(F.lit(seed), *hashed, "_copy")).drop("_copy")
    scattered = scattered.withColumn("_bucket", F.pmod("_mark", F.lit(n_buckets)))
    placed = _first_places(scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")))
    gathered = scattered.join(placed, "_bucket")
    kept = [c for c in gathered.columns if c not in ("_bucket", "_first", "_mark")]
    schema = gathered.select(*kept).schema
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["_shard int", "_slot long"])

    def shuffle(table: pa.Table) -> pa.Table:
        bucket, first, n = table.column("_bucket")[0].as_py(), table.column("_first")[0].as_py(), total
        keys = pa.table({"mark": table.column("_mark"), "id": table.column(id_col), "text": table.column(text_col)})
        table = table.select(kept).take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]))
        table = table.take(pa.array(fisher_yates(len(table), seed * 1_000_003 + bucket)))
        at = range(first, first + len(table))
        shard = [((p + 1) * n_shards - 1) // n for p in at]
        slot = [p - s * n // n_shards for p, s in zip(at, shard)]
        return table.append_column("_shard", pa.array(shard, pa.int32())).append_column("_slot", pa.array(slot, pa.int64()))

    shuffled = gathered.groupBy("_bucket").applyInArrow(shuffle, out_schema)
    shuffled.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    back = docs.sparkSession.read.schema(shuffled.schema).parquet(path)
    return back.select(*docs.columns, "_size", "_crc32", "_shard", "_slot").toDF(*names, "_size", "_crc32", "_shard", "_slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(read(spark, sf_dir, "documents"), 16, shared_path(spark, "shards"))
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
