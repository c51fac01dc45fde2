"""Recompute, compare and resume runs (M1-M9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .evidence import is_consent_marked
from .findings import Analysis, analyse
from .identity import CONSENT_PREFIX, component_signatures, rederive


def replay_signatures(evidence: DataFrame, stable: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Evidence with recomputed signatures and a ``changed`` mark (M1).

    The raw chain decides where it was recorded; older rows are re-derived from
    their composed signature. The two are split before the join: rows without a
    chain would all meet on the same null key.
    """
    has_chain = F.coalesce("signature_input", F.lit("")) != ""
    recorded, legacy = evidence.filter(has_chain), evidence.filter(~has_chain)
    computed = component_signatures(recorded.select("signature_input"), stable, ids)
    prefix = F.when(is_consent_marked(F.col("data")), F.lit(CONSENT_PREFIX)).otherwise(F.lit(""))
    fresh = recorded.join(computed, "signature_input").withColumn("_new", F.concat(prefix, "signature")).drop("signature")
    # once per distinct signature, of which there are few, and these are stored, so that rows meet them without a shuffle
    rederived = cut(legacy.select("component_signature").dropDuplicates().withColumn("_new", rederive(F.col("component_signature"))))
    older = legacy.join(rederived, "component_signature", "left")
    return (
        fresh.unionByName(older)
        .withColumn("changed", F.col("_new") != F.col("component_signature"))
        .withColumn("component_signature", F.col("_new"))
        .drop("_new")
    )


def replay(evidence: DataFrame, templates: DataFrame, sites: DataFrame, stable: DataFrame, ids: DataFrame | None = None) -> Analysis:
    """Analysis of a stored run under today's signature rules (M2)."""
    return analyse(replay_signatures(evidence, stable, ids).drop("changed"), templates, sites)


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Finding groups by (title, occurrences) whose size changed (M3): ``before``, ``after``, ``change``."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("title", "occurrence_count").agg(F.count("*").alias(name))

    both = counted(before, "before").join(counted(after, "after"), ["title", "occurrence_count"], "full_outer").fillna(0, ["before", "after"])
    change = F.when(F.col("after") < F.col("before"), "shrunk").otherwise("grown")
    return both.filter(F.col("after") != F.col("before")).withColumn("change", change)


def pending_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages not yet in the result log (M4)."""
    return pages.join(done.select("url"), "url", "left_anti")


def resume(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier results and the new ones for pages the log did not hold (M4)."""
    return previous.unionByName(pending_pages(new, previous))


def scan_rollup(results: DataFrame) -> DataFrame:
    """One row: pages read, failed, evidence collected (M8)."""
    return results.agg(
        F.count_if(F.col("error").isNull()).alias("pages_scanned"),
        F.count_if(F.col("error").isNotNull()).alias("pages_failed"),
        F.sum(F.when(F.size("evidence") > 0, F.size("evidence")).otherwise(F.lit(0))).alias("evidence_collected"),
    )


def failed_pages(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull()).select("url", "error")


def flattened_evidence(results: DataFrame) -> DataFrame:
    """Evidence of all pages as rows (M8)."""
    return results.select(F.explode("evidence").alias("e")).select("e.*")


def digest(evidence: DataFrame) -> DataFrame:
    """The multiset a resumed run must reproduce: ``(digest, n)`` (M9)."""
    key = F.concat_ws("|", "page_url", "check_id", "selector", "component_signature")
    return evidence.groupBy(key.alias("digest")).agg(F.count("*").alias("n"))


def same_evidence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either digest missing from the other; empty means equal (M9)."""
    da, db = digest(a), digest(b)
    return da.exceptAll(db).withColumn("side", F.lit("left")).unionByName(db.exceptAll(da).withColumn("side", F.lit("right")))


def reuse_discovery(run_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Keep pages, templates and sites of a stored run; evidence and findings start empty (M7)."""
    emptied = ("evidence", "findings")
    return {name: df.limit(0) if name in emptied else df for name, df in run_tables.items()}


def run_age_hours(started_at: str = "started_at"):
    """Whole hours since a run started, rounded half up."""
    seconds = F.timestamp_diff("SECOND", F.col(started_at), F.current_timestamp())
    return F.floor(seconds / F.lit(3600.0) + F.lit(0.5)).cast("int")
