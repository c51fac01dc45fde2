"""Exact deduplication by skew-safe combining of digest groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.lineage import cut

from .common import SPACE, rows


def normalised(text: str) -> Column:
    """Text with each run of white space as one space; null is empty. Lone spaces are left as they are."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_replace(value, rf"\x20[{SPACE}]+|[\x09-\x0D][{SPACE}]*", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: ``digest, content, keep_id, group_size``.

    Rows are combined where they lie, then per digest and salt, then the
    winners of the salts per digest. The whole text is a key of every stage, so
    texts that share a digest stay apart; ``content`` is set only for those.
    A group of any size sends one row per task to its salt and one per salt to
    its digest.
    """
    d = rows(docs, doc_id="doc_id", content=normalised("text")).drop("row")
    d = d.select("doc_id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = d.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = salted.drop("salt").repartition("digest").groupBy("digest", "content")
    merged = winners.agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1
    return merged.select("digest", F.when(shared, F.col("content")).alias("content"), "keep_id", "group_size")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """Every row with the group of equal texts it belongs to.

    Returns ``row`` (the whole input row), ``doc_id, digest, keep_id,
    group_size, kept``. Texts are equal when they agree after runs of white
    space became one space; null is empty. The smallest id of a group stays; a
    null id counts as larger than all others, and stays (``keep_id`` null) only
    where no row of the group has an id. Rows that repeat the id that stays are
    all ``kept``: an id is one document. An empty table gives an empty result.

    The way back to the rows is a join on the digest alone; the text joins the
    key only where a digest is shared, which SHA-256 never shows in practice.
    Hot digests are left to the skew handling of adaptive execution: the other
    side has one row per text.
    """
    classes = cut(groups(docs, digest, salts)).withColumn("content", F.coalesce(F.concat(F.lit("="), F.col("content")), F.lit("")))
    # the digests that differing texts share: none, or a few for a weak digest
    shared = classes.filter("content != ''").select("digest").distinct().agg(F.collect_list("digest").alias("shared")).first()["shared"]
    d = rows(docs, doc_id="doc_id", text=normalised("text"))
    d = d.withColumn("digest", digest(F.col("text")))
    content = F.when(F.col("digest").isin(shared), F.concat(F.lit("="), F.col("text"))).otherwise("") if shared else F.lit("")
    joined = d.withColumn("content", content).drop("text").join(classes, ["digest", "content"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("row", "doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(content) AS text_sha256
FROM d WINDOW g AS (PARTITION BY content)
"""
