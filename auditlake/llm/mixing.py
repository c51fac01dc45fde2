"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.lineage import cut

from .common import rows, shuffled, word_count

RANGES = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Words each source should give, from one row ``source, source_size`` a source.

    Sources in order of code points, null last, weigh as in ``weights``,
    repeating. ``share`` times all words is dealt by weight; a source gives
    ``repeats`` times its own size at most, the excess is dealt again by weight.
    Filling by water level finds that fixed point in one sorted pass: sources
    that run dry first come first, and the level is the highest quotient of
    what is left by the weights that are left.
    """
    # one row a source: the table is as long as the list of sources that weights are set for
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    dry = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    return (
        sizes.withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(cycle, F.col("source_no") % len(weights) + 1))
        .withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("given", F.sum("most").over(dry) - F.col("most"))
        .withColumn("left", F.sum("weight").over(dry.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("budget") - F.col("given")) / F.col("left")).over(everything))
        .withColumn("target", F.least("most", F.col("level") * F.col("weight")))
        .select("source", "source_no", "source_size", "weight", "level", "budget", "target")
    )


def _finished(d: DataFrame, offsets: DataFrame) -> DataFrame:
    """``done``: words of the source up to and with this row, in shuffled order.

    A source is dealt to buckets by its shuffle order, and a bucket starts where
    the ones before it end: no task sorts a whole source.
    """
    inside = Window.partitionBy("skey", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(offsets, ["skey", "bucket"]).withColumn("done", F.col("before") + F.sum("size").over(inside))


def _key(repeat: Column | int) -> Column:
    """Place in the queue: virtual finish time, then ties by source, repeat and shuffle order."""
    repeat = F.lit(repeat) if isinstance(repeat, int) else repeat
    finish = (repeat * F.col("source_size") + F.col("done")) / F.col("weight")
    return F.struct(finish.alias("finish"), F.col("source_no"), repeat.cast("int").alias("repeat"), F.col("shuffle"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix", carry: bool = True) -> DataFrame:
    """Documents with the words a mix of their sources takes from them.

    A document of a source finishes, in its ``r``-th repeat, at (``r`` times the
    source's words + words of the source up to it in shuffled order) / weight.
    All copies are dealt to ranges of that virtual time, ranges are summed, and
    only the range in which the budget ends is sorted row by row: the first copy
    that doesn't fit ends the mix.

    Returns ``doc_id, source, size, source_size, target, taken, copies`` and,
    with ``carry``, the whole input row as struct ``row``. Null texts have size
    0, a null source is a source, null ids are shuffled as one id; rows that
    repeat an id are documents of their own. Copies of one id and size in a
    source may be exchanged for one another, with the same result. An empty
    table gives an empty result.
    """
    d = rows(docs, doc_id="doc_id", source="source", size=word_count("text"))
    d = d.withColumn("shuffle", shuffled(seed, F.col("doc_id")))
    d = d.withColumns({"bucket": F.substring("shuffle", 1, 3), "skey": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})
    narrow = d.drop("row")

    sums = cut(narrow.groupBy("skey", "bucket", "source").agg(F.sum("size").alias("words")))
    of_source = targets(sums.groupBy("skey", "source").agg(F.sum("words").alias("source_size")).drop("skey"), weights, share, repeats)
    of_source = of_source.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    before = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")
    offsets = cut(sums.drop("source").withColumn("before", before).join(of_source, "skey").drop("words"))

    queue = cut(_finished(narrow, offsets).drop("skey", "bucket", "before"))
    copies = queue.filter("size > 0").select("size", "level", "budget", F.explode(F.array(*[_key(r) for r in range(repeats)])).alias("at"))
    # near the level, where the budget ends, a range holds a 4096th of it at most
    copies = copies.withColumn("range", F.least(F.lit(2 * RANGES), F.floor(F.col("at.finish") / F.col("level") * RANGES)))
    sums = copies.groupBy("range").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    sums = sums.withColumn("until", F.sum("words").over(Window.orderBy("range")))
    last = sums.filter("until > budget").orderBy("range").select("range", "budget", (F.col("until") - F.col("words")).alias("before")).first()
    end = None
    if last:
        inside = copies.filter(F.col("range") == last["range"])
        inside = inside.withColumn("until", last["before"] + F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        end = inside.filter(F.col("until") > last["budget"]).agg(F.min("at").alias("at")).first()["at"]

    result = _finished(d, offsets) if carry else queue
    fits = [F.lit(1) if end is None else F.when(_key(r) < _literal(end), 1).otherwise(0) for r in range(repeats)]
    count = sum(fits[1:], fits[0])
    result = result.withColumn("copies", count.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return result.select(*(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target", "taken", "copies")


def _literal(end) -> Column:
    return F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["source_no"]).alias("source_no"), F.lit(end["repeat"]).alias("repeat"), F.lit(end["shuffle"]).alias("shuffle"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: Counterpart in SQL, with plain windows over the whole table.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][source_no % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
  FROM s
), l AS (
  SELECT *, (budget - (sum(most) OVER f - most)) / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w WINDOW f AS (ORDER BY most / weight, source_no)
), t AS (
  SELECT *, least(most, max(lev) OVER () * weight) AS target FROM l
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.source_no, t.weight, t.target, t.budget, d.shuffle,
         sum(d.size) OVER (PARTITION BY t.source_no ORDER BY d.shuffle, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, sum(size) OVER (ORDER BY (r * source_size + done) / weight, source_no, r, shuffle ROWS UNBOUNDED PRECEDING) AS until
  FROM q, (VALUES (0), (1)) v(r)
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN until <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM c GROUP BY doc_id, size, source_size, target, shuffle
"""
