"""Gates on the analysis itself.

Issue rows: ``(kind, severity, message, samples array<string>)``. Every gate is
an aggregate. Duplicates, unstable classes and broken texts grow with the
corpus: their issues hold the count alone, and ``examples`` has every one of
them as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.identity import is_bare_word, looks_hashed
from ..functions.text import half_up
from .clusters import MIXED

# Thresholds, severities and patterns.
WEAK_SHARE = 0.15
UNSTABLE_BLOCKING = 5
FRAGMENT_LIMIT = 6
MIXED_SECTIONS = 3
MIXED_SHARE = 0.5
LOSS_NOTE = 0.1
LOSS_BLOCKING = 0.4
IDENTIFIER = r"[.#][A-Za-z0-9_:-]+"
BROKEN_TEXT = r"undefined|NaN|\[object Object\]"
ENGLISH_TITLE = r"^(Ensure|Elements|Documents|Users|Links|Form|Frames|Images)\b"
ISSUE_DDL = "kind string, severity string, message string, samples array<string>"


def _issue(kind: str, severity: Column, message: Column, samples: Column) -> list[Column]:
    return [
        F.lit(kind).alias("kind"),
        severity.alias("severity"),
        message.alias("message"),
        samples.cast("array<string>").alias("samples"),
    ]


def _examples(issue: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """All distinct examples of an issue, one per group, class or text that its gate stops at."""
    found = rows.select(F.col(column).alias("example")).dropDuplicates()
    # one row at most
    return found.crossJoin(F.broadcast(issue.select("kind", "severity"))).select("kind", "severity", "example")


def identifier_spread(evidence: DataFrame, pages_scanned: Column) -> DataFrame:
    """``(token, pages, weak)`` for every class or id named in a signature."""
    tokens = F.regexp_extract_all("component_signature", F.lit(f"({IDENTIFIER})"), F.lit(1))
    # signatures repeat on every page: distinct (page, signature) first
    pairs = evidence.select("page_url", "component_signature").dropDuplicates()
    spread = (
        pairs.select("page_url", F.explode(F.array_distinct(tokens)).alias("token"))
        .dropDuplicates()
        .groupBy("token")
        .agg(F.count("*").alias("pages"))
    )
    return spread.withColumn("weak", F.col("pages") / F.greatest(pages_scanned, F.lit(1)) < WEAK_SHARE)


def tag_skeleton(component: Column) -> Column:
    return F.array_join(F.transform(F.split(component, " > "), lambda d: F.regexp_replace(d, r"[.#\[].*$", "")), ">")


def decorations(component: Column) -> Column:
    return F.transform(F.split(component, " > "), lambda d: F.nullif(F.regexp_extract(d, f"({IDENTIFIER})", 1), F.lit("")))


def duplicate_groups(findings: DataFrame, spread: DataFrame) -> DataFrame:
    """Groups of findings that differ only by weak identifiers: ``(title, skeleton, a, b)``.

    Two findings of one title and tag skeleton are duplicates when wherever
    their identifiers differ one side is weak, so a weak position matches
    anything. No pairs are formed: each finding is masked once per *distinct
    weak mask* of its group, and findings meeting under the same masked form are
    duplicates. ``a`` and ``b`` are one example per group.
    """
    weak = spread.filter("weak").select("token", F.lit(True).alias("_w"))
    shaped = findings.select(
        "finding_id", "title", "component", tag_skeleton(F.col("component")).alias("skeleton"), decorations(F.col("component")).alias("marks")
    )
    slots = (
        shaped.select("finding_id", F.posexplode("marks").alias("pos", "token"))
        .join(weak, "token", "left")
        .groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_w", F.lit(False)).alias("weak")))).getField("weak").alias("weak"))
    )
    rows = shaped.join(slots, "finding_id").select(
        "title", "skeleton", "component", "marks", "weak", F.array_join(F.transform("weak", lambda w: F.when(w, "1").otherwise("0")), "").alias("mask")
    )
    masks = rows.select("title", "skeleton", F.col("weak").alias("other_weak"), F.col("mask").alias("other")).dropDuplicates()
    masked = rows.join(masks, ["title", "skeleton"])
    form = F.transform(
        "marks", lambda m, i: F.when(F.get("weak", i) | F.get("other_weak", i), F.lit("*")).otherwise(F.coalesce(m, F.lit("")))
    )
    met = masked.groupBy(
        "title", "skeleton", F.least("mask", "other").alias("lo"), F.greatest("mask", "other").alias("hi"), form.alias("form")
    ).agg(
        F.min("component").alias("a"),
        F.max("component").alias("b"),
        F.min(F.struct("mask", "component")).alias("x"),
        F.max(F.struct("mask", "component")).alias("y"),
        F.min(F.array_join("marks", " ", "-")).alias("v1"),
        F.max(F.array_join("marks", " ", "-")).alias("v2"),
    )
    same_mask = F.col("lo") == F.col("hi")
    flagged = met.filter(F.when(same_mask, F.col("v1") != F.col("v2")).otherwise(F.col("x.mask") != F.col("y.mask")))
    pair = F.when(same_mask, F.struct("a", "b")).otherwise(
        F.struct(F.least("x.component", "y.component").alias("a"), F.greatest("x.component", "y.component").alias("b"))
    )
    return flagged.groupBy("title", "skeleton").agg(F.min(pair).alias("pair")).select("title", "skeleton", "pair.a", "pair.b")


def duplicate_issue(findings: DataFrame, spread: DataFrame) -> DataFrame:
    bad = duplicate_groups(findings, spread)
    message = F.concat(F.col("n").cast("string"), F.lit(" gruppi di finding differiscono solo per identificatori deboli."))
    return (
        bad.agg(F.count("*").alias("n"))
        .filter(F.col("n") > 0)
        .select(*_issue("duplicate-findings", F.lit("bloccante"), message, F.array()))
    )


def unstable_signatures(findings: DataFrame) -> DataFrame:
    """Distinct hash-looking classes still present in components."""
    words = F.regexp_extract_all("component", F.lit(r"\.([A-Za-z0-9_-]+)"), F.lit(1))
    return (
        findings.select(F.explode(words).alias("cls"))
        .dropDuplicates()
        .filter(is_bare_word(F.col("cls")) & looks_hashed(F.col("cls")))
    )


def unstable_issue(findings: DataFrame) -> DataFrame:
    bad = unstable_signatures(findings)
    severity = F.when(F.col("n") > UNSTABLE_BLOCKING, "bloccante").otherwise("attenzione")
    message = F.concat(F.col("n").cast("string"), F.lit(" classi dall'aspetto generato compaiono ancora nelle firme."))
    return (
        bad.agg(F.count("*").alias("n"))
        .filter(F.col("n") > 0)
        .select(*_issue("unstable-signature", severity, message, F.array()))
    )


def mixed_clusters(template_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts about clusters of uneven structure (J4): one row."""
    sections = (
        pages.filter(F.col("fingerprint").startswith(MIXED))
        .select("fingerprint", U.section(F.col("url")).alias("section"))
        .filter(F.col("section").isNotNull())
        .dropDuplicates()
        .groupBy("fingerprint")
        .agg(F.count("*").alias("sections"))
    )
    mixed = template_rows.filter(F.col("fingerprint").startswith(MIXED)).join(sections, "fingerprint", "left")
    largest = F.struct("page_count", "fingerprint", F.coalesce("sections", F.lit(0)).alias("sections"))
    return mixed.agg(
        F.count("*").alias("clusters"),
        F.sum("page_count").alias("pages"),
        F.max(largest).alias("largest"),
        F.bool_and(F.coalesce("sections", F.lit(0)) <= 1).alias("coherent"),
    ).select("*", template_rows.agg(F.sum("page_count")).scalar().alias("total"))


def mixed_issue(template_rows: DataFrame, pages: DataFrame, min_pages: int = 0) -> DataFrame:
    """Gate on uneven clusters (J4); a caller may let runs under ``min_pages`` pages pass (40 is usual)."""
    facts = mixed_clusters(template_rows, pages).filter((F.col("clusters") > 0) & (F.col("total") > 0))
    share, top = F.col("pages") / F.col("total"), F.col("largest.page_count") / F.col("total")
    collapsed = (F.col("total") >= min_pages) & (top > MIXED_SHARE) & (F.col("largest.sections") >= MIXED_SECTIONS)
    severity = F.when(collapsed, "bloccante").when(share >= MIXED_SHARE, F.when(F.col("coherent"), "nota").otherwise("attenzione"))

    def percent(x: Column) -> Column:
        return half_up(x * 100, 0).cast("int").cast("string")

    message = F.when(
        collapsed,
        F.concat(F.lit("Un solo cluster tiene il "), percent(top), F.lit("% delle pagine e mescola "), F.col("largest.sections").cast("string"), F.lit(" sezioni.")),
    ).otherwise(
        F.concat(F.lit("Il "), percent(share), F.lit("% delle pagine sta in "), F.col("clusters").cast("string"), F.lit(" cluster di struttura non uniforme."))
    )
    sample = F.array(F.concat("largest.fingerprint", F.lit(": "), F.col("largest.page_count").cast("string"), F.lit(" pagine")))
    return facts.filter(severity.isNotNull()).select(*_issue("mixed-clusters", severity, message, sample))


def coverage_issue(expected: Column, scanned: Column, spark) -> DataFrame:
    """Planned samples that were not measured."""
    lost = F.col("expected") - F.col("scanned")
    share = lost / F.col("expected")
    return (
        spark.range(1)
        .select(expected.alias("expected"), scanned.alias("scanned"))
        .filter((F.col("expected") > 0) & (lost > 0) & (share >= LOSS_NOTE))
        .select(
            *_issue(
                "polluted-pages",
                F.when(share > LOSS_BLOCKING, "bloccante").otherwise("attenzione"),
                F.concat(lost.cast("string"), F.lit(" pagine previste su "), F.col("expected").cast("string"), F.lit(" non sono state misurate.")),
                F.array(),
            )
        )
    )


def fragmented_checks(findings: DataFrame) -> DataFrame:
    """Checks split over many findings: ``(check_id, findings)``."""
    return (
        findings.groupBy("check_id")
        .agg(F.count("*").alias("findings"))
        .filter((F.col("findings") > FRAGMENT_LIMIT) & ~F.col("check_id").contains("color-contrast"))
    )


def fragmented_issue(findings: DataFrame) -> DataFrame:
    bad = fragmented_checks(findings)
    # one row per check id: a small, closed set
    samples = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("findings")).alias("k"), "check_id"))),
        lambda x: F.concat(x["check_id"], F.lit(": "), (-x["k"]).cast("string"), F.lit(" finding")),
    )
    return (
        bad.agg(F.count("*").alias("n"), samples.alias("s"))
        .filter(F.col("n") > 0)
        .select(
            *_issue(
                "fragmented-check", F.lit("attenzione"), F.concat(F.col("n").cast("string"), F.lit(" controlli danno più di 6 finding distinti.")), F.col("s")
            )
        )
    )


def broken_texts(findings: DataFrame) -> DataFrame:
    """Findings with unresolved placeholders or an untranslated title."""
    return findings.filter(F.concat("description", "title").rlike(BROKEN_TEXT) | F.col("title").rlike(ENGLISH_TITLE))


def text_issue(findings: DataFrame) -> DataFrame:
    bad = broken_texts(findings)
    message = F.concat(F.col("n").cast("string"), F.lit(" finding hanno testi non pronti."))
    return (
        bad.agg(F.count("*").alias("n"))
        .filter(F.col("n") > 0)
        .select(*_issue("untranslated-text", F.lit("attenzione"), message, F.array()))
    )


def self_check(
    findings: DataFrame, evidence: DataFrame, template_rows: DataFrame, pages: DataFrame, expected: Column, scanned: Column
) -> DataFrame:
    """All gates as one issue table; empty when the analysis is sound."""
    spread = identifier_spread(evidence, scanned)
    parts = [
        duplicate_issue(findings, spread),
        unstable_issue(findings),
        mixed_issue(template_rows, pages),
        coverage_issue(expected, scanned, findings.sparkSession),
        fragmented_issue(findings),
        text_issue(findings),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def examples(findings: DataFrame, evidence: DataFrame, scanned: Column) -> DataFrame:
    """What the gates on duplicates, unstable classes and texts stop at: ``(kind, severity, example)``."""
    spread = identifier_spread(evidence, scanned)
    pair = F.concat(F.lit('"'), F.col("title"), F.lit('": '), "a", F.lit(" / "), "b").alias("example")
    return (
        _examples(duplicate_issue(findings, spread), duplicate_groups(findings, spread).select(pair), "example")
        .unionByName(_examples(unstable_issue(findings), unstable_signatures(findings), "cls"))
        .unionByName(_examples(text_issue(findings), broken_texts(findings), "title"))
    )


def trustworthy(issues: DataFrame) -> DataFrame:
    """One row: no blocking issue."""
    return issues.agg(
        F.count("*").alias("issues"), (~F.coalesce(F.bool_or(F.col("severity") == "bloccante"), F.lit(False))).alias("trustworthy")
    )
