"""Line deduplication by range-partitioned line hashes and per-document keep bitmaps.

The main path is DataFrame functions only. Text never enters the shuffle of lines: a line is its
128-bit key hash and the row and position it is in, cut and hashed once and written to the shared folder. The hashes are
range-partitioned by (hash, document), so a hot line spreads over as many partitions as its documents fill, and sorted by document and
position within. A run is the part of a hash's lines that lies in one span of ``2 ** SPAN_BITS`` document ids; streaming
through it, the first occurrence of the hash in each document is told from those that follow in the same one, and the first of
all is the run's largest document. Runs give a row each, which are combined into the repeated hashes with the document that keeps them.

Defined results: a null or empty text is one empty line. A null doc_id is one id below all others.
Rows that share a doc_id are one document when documents are counted, and each keeps or loses its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.session import cut_lineage, shared_path

STRIPPED = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NULL_ID = -(2**63)
SPAN_BITS = 12


def key_text(bare: Column) -> Column:
    """Text that is equal for two stripped lines just if they are equal after lower-casing A-Z alone.

    ASCII lines: ``lower``. Others: ``lower``, which also changes letters beyond A-Z, and after a line break the
    line's non-ASCII characters as they were, which tell such lines apart. The Kelvin sign is the one other character whose
    lower case is ASCII, so lines with it go through ``translate``, which is exact but slow.
    """
    return (
        F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare))
        .when(F.contains(bare, F.lit("\u212a")), F.translate(bare, UPPER, UPPER.lower()))
        .otherwise(F.concat(F.lower(bare), F.lit("\n"), F.regexp_replace(bare, r"[\x00-\x7f]+", "")))
    )


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("row_hash"), F.split(text, "\n", -1).alias("lines"))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """did, row_hash, pos, key of the lines that are long enough, written to the shared folder and read back."""
    rows = _lines(docs, id_col, text_col).select("did", "row_hash", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= min_chars).withColumn("bare", F.btrim("line", F.lit(STRIPPED)))
    hashed = rows.where(F.char_length("bare") >= min_chars).select("did", "row_hash", "pos", F.unhex(F.md5(key_text(F.col("bare")))).alias("key"))
    path = shared_path(docs.sparkSession, "lines")
    hashed.write.parquet(path)
    return docs.sparkSession.read.schema(hashed.schema).parquet(path)


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """key, span, did, line of the first line of each key in each document; ``line`` counts the lines of a run, the largest document's first.

    Range partitions by (key, span) already hold each run whole, so the window sorts them where they are.
    """
    width = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hashes.select("key", F.shiftright("did", SPAN_BITS).alias("span"), "did", "pos")
    rows = rows.repartitionByRange(width, F.col("key"), F.col("span").desc())
    run = Window.partitionBy("key", "span").orderBy(F.desc("did"), "pos")
    before = F.lag("did").over(run)
    firsts = rows.withColumns({"line": F.row_number().over(run), "fresh": before.isNull() | (before != F.col("did"))})
    return firsts.where("fresh").select("key", "span", "did", "line")


def repeated_keys(hashes: DataFrame, min_docs: int = 5) -> DataFrame:
    """key, keeper, n_docs of the lines found in at least ``min_docs`` documents; ``keeper`` is the largest id."""
    firsts = first_occurrences(hashes)
    # a run's rows are in its partition, so these sums need no exchange; the next ones take a row a run
    runs = firsts.groupBy("key", "span").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("line") == 1, F.col("did"))).alias("first"))
    return runs.groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("first").alias("keeper")).where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """did, row_hash, n_dropped, keep: for each row that loses lines, its compressed keep bitmap.

    ``keep`` lists (word, bits) for the 64-line words in which some line is dropped; bit b of word w is
    line 64 w + b. An absent word keeps all its lines, so a bitmap grows with the drops, not the text.
    """
    hashes = line_hashes(docs, id_col, text_col, min_chars)
    # written out, so that the join below has an exchange of its own on both sides and a hot key can be split
    repeated = cut_lineage(repeated_keys(hashes, min_docs))
    lost = hashes.join(repeated, "key").where("did <> keeper").select("did", "row_hash", "pos")
    words = lost.distinct().groupBy("did", "row_hash", (F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("gone"), F.count(F.lit(1)).alias("n")
    )
    return words.groupBy("did", "row_hash").agg(
        F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` (replacing columns of these names) and the kept text in ``text_col``.

    The bitmap side is hashed and the texts stream past it, so whole texts are exchanged once and never sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("row"), F.col(text_col).alias("txt"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("row_hash"))
    joined = packed.join(bitmaps.hint("shuffle_hash"), ["did", "row_hash"], "left")
    gone = F.flatten(F.transform("keep", lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b)))
    lines = F.split(F.coalesce("txt", F.lit("")), "\n", -1)
    cut = joined.withColumn("n_lines", F.size(lines))
    cut = cut.withColumn("stay", F.when(F.col("keep").isNotNull(), F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), gone)))
    cut = cut.withColumn("parts", F.when(F.col("keep").isNotNull(), lines))
    kept = F.when(F.col("keep").isNull(), F.col("txt")).otherwise(F.array_join(F.transform("stay", lambda i: F.element_at("parts", i + 1)), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return cut.select(*out, F.col("n_lines").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows of ``docs`` with repeated lines removed; see ``apply_bitmaps`` for the added columns."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


# DuckDB; shared with the pipeline's SQL. {docs} is a relation with doc_id and text.
LINES_CTE = r"""
raw_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM {docs}),
keyed_lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM raw_lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed_lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT a.doc_id, a.line, a.pos, r.k IS NOT NULL AND a.doc_id <> r.keeper AS gone
  FROM keyed_lines a LEFT JOIN repeated r ON a.k = r.k)
"""
OP1_SQL = (
    "WITH " + LINES_CTE.format(docs="documents") + """
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
)
