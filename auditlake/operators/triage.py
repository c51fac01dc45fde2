"""Triage packs out, answers in, human decisions on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .findings import cited_evidence, verdict_rank, with_priority

# Pack sizes, enumerations, outcomes.
PACK_SIZE = 12
PACK_SAMPLES = 3
VERDICTS = ["fail", "needs-review", "pass", "inapplicable"]
OWNERS = ["frontend", "contenuti", "design", "cms", "fornitore-terzo", "da-definire"]
EFFORTS = ["basso", "medio", "alto"]
OUTCOMES = ["non-conforme", "conforme", "irrilevante", "da-approfondire"]
REVIEW_NOTES = 4

ANSWER_DDL = (
    "struct<schemaVersion:string,packId:string,findings:array<struct<id:string,verdict:string,confidence:double,title:string,"
    "description:string,remediation:string,codeExample:string,owner:string,effort:string,rationale:string,reviewQuestion:string>>>"
)


def candidates(findings: DataFrame) -> DataFrame:
    """Findings worth a second look: all but certain, trusted, low-severity failures."""
    obvious = (F.col("verdict") == "fail") & (F.col("confidence") >= 0.95) & (F.col("band") == "bassa")
    return findings.filter(~obvious)


def verdict_cap(can_fail: Column) -> Column:
    return F.when(can_fail, F.lit("fail")).otherwise(F.lit("needs-review"))


def packs(findings: DataFrame, size: int = PACK_SIZE) -> DataFrame:
    """``(finding_id, pack_id, pack_index, pack_total, position)`` in ranking order."""
    total = F.greatest(F.ceil(findings.agg(F.count("*")).scalar() / F.lit(size)), F.lit(1)).cast("int")
    ranked = with_priority(findings).select("finding_id", (F.col("priority") - 1).alias("_i"))
    index = (F.floor(F.col("_i") / size) + 1).cast("int")
    return ranked.select(
        "finding_id",
        F.concat(F.lit("pack-"), F.lpad(index.cast("string"), F.greatest(F.length(index.cast("string")), F.lit(3)), F.lit("0"))).alias("pack_id"),
        index.alias("pack_index"),
        total.alias("pack_total"),
        ((F.col("_i") % size) + 1).cast("int").alias("position"),
    )


def pack_samples(citations: DataFrame, evidence: DataFrame, per_finding: int | None = None) -> DataFrame:
    """Cited evidence of each finding (T2), all of it or the first ``per_finding`` rows."""
    first = citations if per_finding is None else citations.filter(F.col("rank") <= per_finding)
    return cited_evidence(first, evidence, "page_url", "selector", "html", "observation", "data").select(
        "finding_id", "rank", "page_url", "selector", "html", "observation", "data"
    )


def pack_rows(
    findings: DataFrame, citations: DataFrame, evidence: DataFrame, criteria: DataFrame | None = None, per_finding: int = PACK_SAMPLES
) -> DataFrame:
    """One self-contained row per candidate (T2): criterion details, cap, samples.

    A row is a message of bounded size, so it carries ``per_finding`` samples
    beside the full ``evidence_count``, and ``citations`` need hold no more than
    these; ``pack_samples`` has all as rows.
    """
    table = dims.or_own(criteria, dims.criteria(findings.sparkSession))
    chosen = candidates(findings)
    details = (
        chosen.select("finding_id", F.posexplode("criteria").alias("_pos", "criterion"))
        .join(table, "criterion", "left")
        .groupBy("finding_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "_pos",
                        F.col("criterion").alias("id"),
                        F.coalesce(F.col("title"), F.lit("criterio non in catalogo")).alias("title"),
                        F.coalesce("level", F.lit("?")).alias("level"),
                        F.coalesce("automation", F.lit("judgment")).alias("automation"),
                        F.coalesce("plain_language", F.lit("")).alias("plain_language"),
                    )
                )
            ).alias("criteria_details")
        )
    )
    samples = (
        pack_samples(citations, evidence, per_finding)
        .groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "page_url", "selector", "html", "observation", "data"))).alias("samples"))
    )
    return (
        chosen.join(details, "finding_id", "left")
        .join(samples, "finding_id", "left")
        .join(packs(chosen), "finding_id")
        .withColumn("max_verdict", verdict_cap(F.col("can_fail")))
    )


def parse_answers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer files ``(file, content)`` to valid answers and rejected files.

    A surrounding markdown fence is dropped. A file is taken whole or not at all:
    one invalid finding rejects it.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace("content", r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    parsed = files.select("file", F.from_json(body, ANSWER_DDL, {"mode": "PERMISSIVE"}).alias("a"))

    def sound(f: Column) -> Column:
        texts = f["title"].isNotNull() & f["description"].isNotNull() & f["remediation"].isNotNull() & f["rationale"].isNotNull()
        return (
            f["id"].isNotNull()
            & F.coalesce(f["verdict"].isin(VERDICTS), F.lit(False))
            & F.coalesce(f["confidence"].between(0, 1), F.lit(False))
            & F.coalesce(f["owner"].isin(OWNERS), F.lit(False))
            & F.coalesce(f["effort"].isin(EFFORTS), F.lit(False))
            & texts
        )

    valid = F.coalesce(F.col("a.packId").isNotNull() & F.forall("a.findings", sound), F.lit(False))
    marked = parsed.withColumn("valid", valid)
    answers = marked.filter("valid").select(
        "file", F.col("a.packId").alias("pack_id"), F.posexplode("a.findings").alias("position", "f")
    ).select(
        "file", "pack_id", "position", F.col("f.id").alias("finding_id"), "f.verdict", "f.confidence", "f.title", "f.description", "f.remediation",
        F.col("f.codeExample").alias("code_example"), "f.owner", "f.effort", "f.rationale", F.col("f.reviewQuestion").alias("review_question"),
    )
    return answers, marked.filter(~F.col("valid")).select("file")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key by ``order``; a map-side-combined maximum, not a window."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(key, *[f"_l.{c}" for c in [*order, *rest]])


def apply_triage(findings: DataFrame, answers: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings after triage, and the verdicts refused for exceeding the cap (T4).

    Of several answers to one finding the last by ``order`` (file, position)
    counts. Texts replace ours only when not empty. Findings raised from review
    to failure are marked ``promoted``.
    """
    last = latest(answers, "finding_id", order or ["file", "position"])
    t = last.select("finding_id", *[F.col(c).alias(f"t_{c}") for c in
                                    ["verdict", "confidence", "title", "description", "remediation", "code_example", "owner", "effort"]])
    joined = findings.join(t, "finding_id", "left").withColumn("_cap", verdict_cap(F.col("can_fail")))
    answered = F.col("t_verdict").isNotNull()
    over = answered & (verdict_rank(F.col("t_verdict")) < verdict_rank(F.col("_cap")))
    final = F.when(over, F.col("_cap")).otherwise(F.coalesce("t_verdict", "verdict"))

    def text(name: str) -> Column:
        return F.when(F.coalesce(f"t_{name}", F.lit("")) != "", F.col(f"t_{name}")).otherwise(F.col(name))

    new = {
        "verdict": final,
        "confidence": F.coalesce("t_confidence", "confidence"),
        "title": text("title"),
        "description": text("description"),
        "remediation": text("remediation"),
        "code_example": F.coalesce("t_code_example", "code_example"),
        "owner": F.coalesce("t_owner", "owner"),
        "effort": F.coalesce("t_effort", "effort"),
        "ai_generated": answered | F.col("ai_generated"),
    }
    merged = joined.select(
        *[new[c].alias(c) if c in new else F.col(c) for c in findings.columns],
        ((F.col("verdict") == "needs-review") & (final == "fail")).alias("promoted"),
    )
    refused = joined.filter(over).select("finding_id", F.col("t_verdict").alias("asked"), F.col("_cap").alias("cap"))
    return merged, refused


def review_notes(findings: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """All that ``citations`` lead to for findings that wait for a person, one row per record (T5)."""
    waiting = findings.filter(F.col("verdict") == "needs-review").select("finding_id")
    return cited_evidence(citations.join(waiting, "finding_id", "left_semi"), evidence, "page_url", "observation", "selector", "screenshot")


def review_queue(findings: DataFrame, citations: DataFrame, evidence: DataFrame, notes: int = REVIEW_NOTES) -> DataFrame:
    """What a person has to look at, gravest first (T5).

    ``n_pages`` and ``n_rows`` count all evidence. A row of the queue carries the
    first ``notes`` records, so ``citations`` need hold no more than these;
    ``review_notes`` has all as rows.
    """
    waiting = findings.filter(F.col("verdict") == "needs-review").withColumns({"n_pages": F.col("page_count"), "n_rows": F.col("evidence_count")})
    cited = review_notes(waiting, citations.filter(F.col("rank") <= notes), evidence)
    # at most ``notes`` rows per finding from here on
    listed = cited.groupBy("finding_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "page_url", "observation", "selector"))).alias("notes"),
        F.min_by("screenshot", F.when(F.coalesce("screenshot", F.lit("")) != "", F.col("rank"))).alias("screenshot"),
    )
    rows = waiting.join(listed, "finding_id", "left")
    return rows.orderBy(F.col("score").desc(), "finding_id")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Latest decision per finding; unknown outcomes are not decisions."""
    return latest(reviews.filter(F.col("outcome").isin(OUTCOMES)), "finding_id", ["ts"])


def apply_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Human decisions over machine verdicts (T6); a person may exceed the cap."""
    r = latest_reviews(reviews).select("finding_id", F.col("outcome").alias("review_outcome"), F.col("reviewer"), F.col("note").alias("review_note"))
    decided = F.when(F.col("review_outcome") == "non-conforme", "fail").when(F.col("review_outcome") == "conforme", "pass").otherwise(F.col("verdict"))
    return findings.join(r, "finding_id", "left").withColumn("verdict", decided)


def review_progress(reviewed: DataFrame) -> DataFrame:
    """One row: still to review, reviewed."""
    done = F.col("review_outcome").isNotNull()
    return reviewed.agg(
        F.count_if((F.col("verdict") == "needs-review") & ~done).alias("remaining"), F.count_if(done).alias("reviewed")
    )
