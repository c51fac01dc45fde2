"""The incremental paths: scan results as they are appended, review decisions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lineage import cut, release
from ..operators.triage import OUTCOMES, latest
from ..sources.logs import parse_results

#: Parts of the store of review decisions.
REVIEW_BUCKETS = 64
REVIEW_DDL = "finding_id string, outcome string, note string, reviewer string, ts timestamp"


def _known_pages(spark: SparkSession, target: str, batch_id: int) -> DataFrame | None:
    """Addresses that batches before ``batch_id`` have stored, none where there is no store yet."""
    try:
        return spark.read.schema("url string, batch long").parquet(target).filter(F.col("batch") < batch_id).select("url")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_intake(lines: DataFrame, target: str, rejected: str, checkpoint: str, **trigger) -> tuple[StreamingQuery, StreamingQuery]:
    """Append parsed page results to ``target``, each page once, and lines that can't be read to ``rejected``.

    ``lines(value)`` is a stream. Of a page's results in one micro-batch the
    quickest counts, ties going to the smaller line; a page that an earlier
    batch has stored is left out. The store itself tells these: a batch reads
    the addresses of the store, and no other column, against its own, and
    nothing is held in memory between batches. Every micro-batch overwrites its
    own ``batch=`` folder, so one replayed after a failure leaves no duplicate.
    """
    when = trigger or {"availableNow": True}
    present = lines.filter(F.trim("value") != "")
    good, bad = parse_results(present, keep="value")

    def store(batch: DataFrame, batch_id: int) -> None:
        # lines are dealt by page before they are compared, so that no task sorts all it has read
        quickest = F.min(F.struct(F.coalesce("duration_ms", F.lit(1 << 62)), "value"))
        first = batch.repartition("url").groupBy("url").agg(quickest.alias("_best")).select("url", "_best.value")
        known, held = _known_pages(batch.sparkSession, target, batch_id), []
        if known is not None:
            # stored, so that a small batch is known to be small and meets the store without a shuffle
            first = cut(first)
            held.append(first)
            first = first.join(known.join(first.select("url"), "url", "left_semi"), "url", "left_anti")
        # VARIANT records travel as JSON text in the stored table
        parse_results(first.select("value"))[0].withColumn("evidence", F.to_json("evidence")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        release(*held)

    results = good.select("url", "duration_ms", "value").writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/results").trigger(**when).start()
    refused = bad.writeStream.format("parquet").option("path", rejected).option("checkpointLocation", f"{checkpoint}/rejected").trigger(**when).start()
    return results, refused


def review_intake(decisions: DataFrame, target: str, checkpoint: str, buckets: int = REVIEW_BUCKETS, **trigger) -> StreamingQuery:
    """Keep the latest review decision of each finding as decisions arrive.

    ``decisions`` is a stream with the columns of ``REVIEW_DDL``. The store is
    dealt to ``buckets`` by finding: a batch reads the buckets it touches, merges
    them with what it brings, the later decision winning, and replaces just
    these. The store grows with findings, not with decisions, and a batch
    replayed after a failure changes nothing, as the latest of the same rows is
    the same.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        known = batch.filter(F.col("outcome").isin(OUTCOMES) & F.col("finding_id").isNotNull())
        known = cut(latest(known, "finding_id", ["ts"]).withColumn("bucket", F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int")))
        stored = _stored_reviews(batch.sparkSession, target)
        touched = stored.join(known.select("bucket").distinct(), "bucket", "left_semi")
        # stored apart before the buckets it comes from are replaced
        merged = cut(latest(touched.unionByName(known), "finding_id", ["ts"]))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        release(known, merged)

    return decisions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _stored_reviews(spark: SparkSession, target: str) -> DataFrame:
    schema = f"{REVIEW_DDL}, bucket int"
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_reviews(spark: SparkSession, target: str) -> DataFrame:
    """The stored decisions, one row a finding; pass them to ``apply_reviews``."""
    return _stored_reviews(spark, target).drop("bucket")
