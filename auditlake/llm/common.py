"""What the operators share: fixed character classes, row carrying, distributed ranks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the white space of all contracts, as a class body
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def rows(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the named working columns.

    Whatever else a caller's table holds stays inside ``row``, so that its
    names can never clash with working columns; an unused ``row`` is pruned.
    """
    return docs.select(F.struct("*").alias("row"), *[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are wide: at most ``rows`` of them go to a Python worker at once in this session, which keeps workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


_kept: dict[tuple, Any] = {}


def kept(make: Callable, *args) -> Any:
    """``make(*args)``, held by a worker for all its tasks until it is asked to keep something else.

    Workers outlive their stages: what a stage has kept would stay beside what later ones keep.
    """
    key = (make, *args)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make(*args)
    return _kept[key]


def word_count(text: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(seed: str, key: Column) -> Column:
    """A reproducible shuffle order: the digest of seed and key, in hex."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """``df`` with the columns of ``counted``, its rows counted by ``keys`` in ``n`` and some of these dropped.

    Keys with more than one in ``share`` of all that ``counted`` counts are
    fewer than ``share``: these are broadcast, so that however many rows one of
    them has, no task gathers them. The other keys meet in a shuffle.
    ``counted`` should be stored, as it is read three times.
    """
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(counted.filter(F.col("n") * share > total))
    rest = df.join(hot.select(*keys), keys, "left_anti").join(counted.filter(F.col("n") * share <= total), keys)
    return df.join(hot, keys).unionByName(rest)


def ranked(df: DataFrame, key: str, order: list[str], out: str, digits: int = 3) -> DataFrame:
    """``df`` with ``out``: the rank (from 0) of each row within ``key``.

    A key may own any share of the rows: each key is dealt to 16**digits
    buckets by the leading digits of its first order column (a hex digest);
    ranks are counted within a bucket and moved by the buckets before it.
    """
    df = df.withColumn("_bucket", F.substring(order[0], 1, digits))
    counts = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    joined = df.join(counts, [key, "_bucket"])
    return joined.withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_bucket", "_before")
