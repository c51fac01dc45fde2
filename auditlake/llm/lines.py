"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.lineage import cut

from .common import join_counted, rows

# fixed values
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    stripped = F.btrim(line, F.lit(BLANK))
    # lines of ASCII alone, where both mean the same, take the faster function
    ascii_only = F.octet_length(stripped) == F.length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(text: str, min_chars: int) -> Column:
    """128-bit hash of each line's key, null for keys that are too short to judge."""
    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))

    return F.transform(_lines(text), hashed)


def drop_shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row with its text less the lines that ``min_docs`` documents hold.

    Lines are split at newlines, their normalised keys hashed to 128 bits, and
    documents counted per hash with partial sums before the shuffle, so that a
    line of any frequency sends one row per task, and its places find that it is
    shared without meeting in one (``join_counted``). A shared line stays in the
    smallest ``doc_id`` that holds it. Only positions of lines to drop travel
    back to the texts, which are put together again by position.

    Returns ``row`` (the whole input row), ``doc_id, kept_text, n_lines,
    n_dropped``. A null or empty text is one empty line. Rows that repeat a
    ``doc_id`` are counted one by one, and all keep the lines their id may keep;
    a null id counts as larger than all others. An empty table gives an empty
    result.
    """
    base = rows(docs, doc_id="doc_id", text="text")
    # an id may be null or repeat: a row's text belongs to its key
    base = base.withColumn("text_key", F.xxhash64("text"))
    # the lines' hashes are stored, as two passes read them: 16 bytes a line
    narrow = cut(base.select("doc_id", "text_key", line_hashes("text", min_chars).alias("keys")))

    once = narrow.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).filter("key IS NOT NULL")
    counted = once.groupBy("key.a", "key.b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    shared = cut(counted.filter(F.col("n") >= min_docs))

    placed = narrow.select("doc_id", "text_key", F.posexplode("keys").alias("at", "key")).filter("key IS NOT NULL")
    placed = placed.select("doc_id", "text_key", "at", "key.a", "key.b")
    dropped = join_counted(placed, shared, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    dropped = dropped.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("dropped"))

    dropped = dropped.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    joined = base.join(dropped, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    lines = _lines("text")
    stay = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.withColumn("lines", lines).select(
        "row", "doc_id", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT doc_id, place, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND s.first_id <> k.doc_id AS gone FROM k LEFT JOIN s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
