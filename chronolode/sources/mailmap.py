"""Author identities from a mailmap file."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.schema import MAILMAP

_PART = re.compile(r"([^<]*)<([^>]*)>")


def parse_mailmap(lines: Iterable[str]) -> list[tuple[int, str | None, str | None, str | None, str]]:
    """Entries (number, proper name, proper email, commit name, commit email) in file order.

    Forms: ``Name <commit>``, ``<proper> <commit>``, ``Name <proper> <commit>``, ``Name <proper> Other <commit>``.
    """
    out = []
    for line in map(str.strip, lines):
        parts = [] if line.startswith("#") else [(n.strip(), e) for n, e in _PART.findall(line)]
        if not parts:
            continue
        names = [n for n, _ in parts if n]
        alone = len(parts) == 1
        out.append((len(out), names[0] if names else None, None if alone else parts[0][1], names[-1] if len(names) > 1 and not alone else None, parts[-1][1]))
    return out


def mailmap_frame(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(parse_mailmap(lines), MAILMAP)


def read_mailmap(spark: SparkSession, working_tree: DataFrame) -> DataFrame | None:
    """The ``.mailmap`` at the top of a working tree (path, content; best read by that name alone), or None; a file of a few lines."""
    found = working_tree.where(F.col("path") == ".mailmap").select("content").first()
    lines = bytes(found[0]).decode("utf-8", "replace").splitlines() if found else []
    return mailmap_frame(spark, lines) if parse_mailmap(lines) else None


def resolve_identities(people: DataFrame, mailmap: DataFrame) -> DataFrame:
    """``people`` (raw_name, raw_email, ...) with author_name and author_email by the first entry that fits.

    Emails and names fit case aside; what an entry leaves out keeps the commit's value. Distinct identities are
    resolved once and joined back.
    """
    who = people.select("raw_name", "raw_email").distinct()
    named = F.col("commit_name").isNull() | (F.lower("commit_name") == F.lower("raw_name"))
    fits = who.join(mailmap, (F.lower("raw_email") == F.lower("commit_email")) & named)
    first = fits.groupBy("raw_name", "raw_email").agg(F.min_by(F.struct("canonical_name", "canonical_email"), "entry_no").alias("e"))
    rows = people.join(
        first.select(F.col("raw_name").alias("_n"), F.col("raw_email").alias("_e"), "e"),
        F.col("raw_name").eqNullSafe(F.col("_n")) & F.col("raw_email").eqNullSafe(F.col("_e")), "left",
    )
    return rows.select(*people.columns, F.coalesce("e.canonical_name", "raw_name").alias("author_name"), F.coalesce("e.canonical_email", "raw_email").alias("author_email"))
