"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import half_up
from .findings import BANDS, with_priority

# Report vocabulary.
OUTCOME_FAIL, OUTCOME_REVIEW = "Non conforme", "Da verificare"
OUTCOME_CLEAN, OUTCOME_UNCHECKED = "Nessun problema rilevato", "Non verificato in automatico"
AUTOMATION_LABEL = {"deterministic": "Sì, in automatico", "partial": "Parziale", "judgment": "No, solo verifica umana"}
JUDGEMENTS = ["Confermato", "Falso positivo", "Irrilevante nel contesto", "Severità diversa", "Da approfondire"]


def _capital(c: str) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def synopsis(findings: DataFrame, evidence: DataFrame, templates: DataFrame, sites: DataFrame, pages_discovered: Column, pages_scanned: Column) -> DataFrame:
    """Run metrics, bands and verdicts as ``(section, metric, value)`` (R1); findings are read once."""
    counted = findings.agg(
        F.count("*").cast("double").alias("findings"),
        *[F.count_if(F.col("band") == b).cast("double").alias(b) for b in BANDS],
        F.count_if(F.col("verdict") == "fail").cast("double").alias("fail"),
        F.count_if(F.col("verdict") == "needs-review").cast("double").alias("needs-review"),
    )
    wide = counted.select(
        "*",
        sites.agg(F.count("*")).scalar().cast("double").alias("sites"),
        pages_discovered.cast("double").alias("pages_discovered"),
        templates.agg(F.count("*")).scalar().cast("double").alias("templates"),
        pages_scanned.cast("double").alias("pages_scanned"),
        evidence.agg(F.count("*")).scalar().cast("double").alias("evidence"),
    ).withColumn("dedupe_ratio", F.when(F.col("findings") > 0, half_up(F.col("evidence") / F.col("findings"), 1)).otherwise(F.lit(1.0)))
    tall = wide.unpivot([], wide.columns, "metric", "value")
    section = F.when(F.col("metric").isin(BANDS), "band").when(F.col("metric").isin("fail", "needs-review"), "verdict").otherwise("run")
    return tall.select(section.alias("section"), "metric", "value")


def site_labels(finding_sites: DataFrame, sites: DataFrame) -> DataFrame:
    """Labels of the sites of each finding, as long as the configured site list at most."""
    named = finding_sites.join(sites.select("site_id", "label"), "site_id", "left").select(
        "finding_id", "site_id", F.coalesce("label", "site_id").alias("label")
    )
    ordered = F.array_sort(F.collect_list(F.struct("site_id", "label"))).getField("label")
    return named.groupBy("finding_id").agg(F.array_join(ordered, ", ").alias("sites"))


def backlog(findings: DataFrame, citations: DataFrame, finding_sites: DataFrame, sites: DataFrame, criteria: DataFrame | None = None) -> DataFrame:
    """The 21-column backlog, in priority order (R2)."""
    table = dims.or_own(criteria, dims.criteria(findings.sparkSession))
    by_level = (
        findings.select("finding_id", F.posexplode("criteria").alias("pos", "criterion"))
        .join(table.select("criterion", "level"), "criterion")
        .groupBy("finding_id", "level")
        .agg(F.min("pos").alias("pos"))
    )
    levels = by_level.groupBy("finding_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "level"))).getField("level"), "/").alias("levels")
    )
    first = citations.filter(F.col("rank") == 1).select("finding_id", F.col("page_url").alias("sample_url"))
    rows = (
        with_priority(findings)
        .join(levels, "finding_id", "left")
        .join(first, "finding_id", "left")
        .join(site_labels(finding_sites, sites), "finding_id", "left")
    )
    return rows.select(
        "priority",
        F.col("finding_id").alias("id"),
        F.col("title").alias("problem"),
        F.when(F.col("verdict") == "fail", OUTCOME_FAIL).otherwise(OUTCOME_REVIEW).alias("outcome"),
        _capital("band").alias("severity"),
        "score",
        F.array_join("criteria", ", ").alias("criteria"),
        F.coalesce(F.nullif("levels", F.lit("")), F.lit("—")).alias("level"),
        "component",
        F.coalesce("sites", F.lit("")).alias("sites"),
        F.col("occurrence_count").alias("estimated_occurrences"),
        F.col("page_count").alias("observed_pages"),
        "owner",
        "effort",
        "description",
        "remediation",
        F.coalesce("code_example", F.lit("")).alias("code"),
        half_up(F.col("confidence"), 2).alias("confidence"),
        F.coalesce("sample_url", F.lit("")).alias("sample_url"),
        F.lit("Da fare").alias("status"),
        F.lit("").alias("notes"),
    )


def evidence_listing(evidence: DataFrame, sites: DataFrame) -> DataFrame:
    """Evidence with site labels."""
    return evidence.join(sites.select("site_id", "label"), "site_id", "left").select(
        "id",
        F.coalesce("label", "site_id").alias("site"),
        F.col("page_url").alias("url"),
        F.col("check_id").alias("check"),
        F.array_join("criteria", ", ").alias("criteria"),
        F.col("component_signature").alias("component"),
        "selector",
        "observation",
        F.coalesce("engine_impact", F.lit("")).alias("impact"),
    )


def template_listing(templates: DataFrame, template_sites: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """Templates with their sites and sampled URLs (R4); samples are few by construction."""
    named = template_sites.select("fingerprint", "site_id").dropDuplicates().join(sites.select("site_id", "label"), "site_id", "left")
    labels = named.groupBy("fingerprint").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("site_id", F.coalesce("label", "site_id").alias("l")))).getField("l"), ", ").alias("sites")
    )
    urls = samples.groupBy("fingerprint").agg(F.count("*").alias("samples"), F.array_join(F.array_sort(F.collect_list("url")), "\n").alias("urls"))
    return (
        templates.join(labels, "fingerprint", "left")
        .join(urls, "fingerprint", "left")
        .select("fingerprint", "label", "sites", "page_count", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("urls", F.lit("")).alias("urls"))
    )


def criteria_coverage(findings: DataFrame, criteria: DataFrame | None = None) -> DataFrame:
    """Every baseline criterion with its hits and a preliminary outcome."""
    table = (criteria if criteria is not None else dims.criteria(findings.sparkSession)).filter("baseline")
    hits = (
        findings.select("verdict", F.explode(F.array_distinct("criteria")).alias("criterion"))
        .groupBy("criterion")
        .agg(F.count("*").alias("hits"), F.count_if(F.col("verdict") == "fail").alias("fails"), F.count_if(F.col("verdict") == "needs-review").alias("reviews"))
    )
    zero = F.lit(0).cast("bigint")
    joined = table.join(hits, "criterion", "left").select(
        "*", *[F.coalesce(c, zero).alias(f"n_{c}") for c in ("hits", "fails", "reviews")]
    )
    outcome = (
        F.when(F.col("n_fails") > 0, OUTCOME_FAIL)
        .when(F.col("n_reviews") > 0, OUTCOME_REVIEW)
        .when(F.col("automation") == "deterministic", OUTCOME_CLEAN)
        .otherwise(OUTCOME_UNCHECKED)
    )
    label = F.coalesce(*[F.when(F.col("automation") == k, v) for k, v in AUTOMATION_LABEL.items()])
    return joined.select(
        "criterion", "title", "level", "principle", label.alias("automation"),
        F.col("n_hits").alias("hits"), F.col("n_fails").alias("fails"), F.col("n_reviews").alias("reviews"), outcome.alias("outcome"), "plain_language",
    )


def dashboard_tiles(findings: DataFrame, evidence: DataFrame, templates: DataFrame, sites: DataFrame, pages_scanned: Column) -> DataFrame:
    """One row of headline numbers."""
    out = findings.agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("verdict") == "fail").alias("fails"),
        F.count_if(F.col("verdict") == "needs-review").alias("reviews"),
    )
    pages = F.coalesce(templates.agg(F.sum("page_count")).scalar(), F.lit(0))
    return out.select(
        "*",
        evidence.agg(F.count("*")).scalar().alias("evidence"),
        templates.agg(F.count("*")).scalar().alias("templates"),
        pages.alias("ecosystem_pages"),
        F.when(pages_scanned > 0, half_up(pages / pages_scanned, 1)).otherwise(F.lit(1.0)).alias("compression"),
        sites.agg(F.count("*")).scalar().alias("sites"),
        sites.filter("tier = 'primary'").agg(F.count("*")).scalar().alias("primary_sites"),
    )


def band_bars(findings: DataFrame) -> DataFrame:
    """Findings per band with bar lengths relative to the fullest band."""
    wide = findings.agg(*[F.count_if(F.col("band") == b).alias(b) for b in BANDS])
    most = F.greatest(*[F.col(b) for b in BANDS], F.lit(1))
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("findings"), most.alias("most")) for b in BANDS])).alias("x"))
    return rows.select("x.band", "x.findings", half_up(F.col("x.findings") / F.col("x.most") * 100, 0).cast("int").alias("percent"))


def criteria_frequency(findings: DataFrame) -> DataFrame:
    """Findings per criterion."""
    return findings.select(F.explode("criteria").alias("criterion")).groupBy("criterion").agg(F.count("*").alias("findings"))


def search(
    findings: DataFrame,
    finding_sites: DataFrame,
    text: str = "",
    verdict: str = "",
    band: str = "",
    site: str = "",
    owner: str = "",
) -> DataFrame:
    """Faceted finding search; an empty facet does not filter (R8). ``search_all`` answers many at once."""
    out = findings
    for column, value in (("verdict", verdict), ("band", band), ("owner", owner)):
        if value:
            out = out.filter(F.col(column) == value)
    if site:
        out = out.join(finding_sites.filter(F.col("site_id") == site).select("finding_id"), "finding_id", "left_semi")
    needle = text.strip().lower()
    if needle:
        index = F.lower(F.concat_ws(" ", "title", "component", F.array_join("criteria", " "), "description", "owner"))
        out = out.filter(index.contains(needle))
    return out


def search_all(findings: DataFrame, finding_sites: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to any number of searches (R8): ``request_id, finding_id``.

    ``requests(request_id, text, verdict, band, site, owner)``; an empty or null
    facet does not filter. A finding stands under each of its facet values and
    under none, for every combination of the four, so requests meet their
    findings by an equal join on all facets; only then is the text looked for.
    Facets have few values and a finding few sites, so that is some tens of
    narrow rows each.
    """
    wanted = requests.select("request_id", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("needle"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("verdict", "band", "site", "owner")])
    words = F.lower(F.concat_ws(" ", "title", "component", F.array_join("criteria", " "), "description", "owner"))
    rows = findings.select("finding_id", words.alias("words"), "verdict", "band", "owner")
    for facet in ("verdict", "band", "owner"):
        under = F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(facet, F.lit("")))))
        rows = rows.select(*[c for c in rows.columns if c != facet], under.alias(facet))
    everywhere = findings.select("finding_id", F.lit("").alias("site"))
    at = everywhere.unionByName(finding_sites.filter(F.col("site_id") != "").select("finding_id", F.col("site_id").alias("site"))).dropDuplicates()
    met = rows.join(at, "finding_id").join(wanted, ["verdict", "band", "site", "owner"])
    return met.filter((F.col("needle") == "") | F.contains("words", F.col("needle"))).select("request_id", "finding_id")


def results_by_facet(findings: DataFrame) -> DataFrame:
    """Counts by band, by owner and by both, in one cube."""
    return (
        findings.cube("band", "owner")
        .agg(F.count("*").alias("findings"))
        .select(F.coalesce("band", F.lit("*")).alias("band"), F.coalesce("owner", F.lit("*")).alias("owner"), "findings")
    )


def comparison_rows(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """Rows a person judges next to their own audit, gravest first."""
    first = citations.filter(F.col("rank") == 1).select("finding_id", F.col("page_url").alias("example"))
    return (
        findings.withColumn("pages", F.col("page_count")).join(first, "finding_id", "left")
        .select(
            "finding_id", "title", "description", "component", F.array_join("criteria", ", ").alias("criteria"), "band", "score", "verdict",
            "occurrence_count", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("example", F.lit("")).alias("example"), "owner",
            half_up(F.col("confidence") * 100, 0).cast("int").alias("confidence"),
        )
        .orderBy(F.col("score").desc(), "finding_id")
    )


def comparison_outcome(judged: DataFrame) -> DataFrame:
    """Precision of the engine from human judgements ``(judgement, already_found, band)``."""

    def n(value: str) -> Column:
        return F.count_if(F.col("judgement") == value)

    done = F.count_if(F.col("judgement").isNotNull())
    return judged.agg(
        F.count("*").alias("rows"),
        done.alias("judged"),
        n("Confermato").alias("confirmed"),
        n("Falso positivo").alias("false_positives"),
        n("Irrilevante nel contesto").alias("irrelevant"),
        n("Severità diversa").alias("wrong_severity"),
        n("Da approfondire").alias("undecided"),
        (n("Confermato") / F.nullif(done, F.lit(0))).alias("confirm_rate"),
        (n("Falso positivo") / F.nullif(done, F.lit(0))).alias("false_positive_rate"),
        F.count_if(F.col("already_found") == "Sì").alias("overlap_yes"),
        F.count_if(F.col("already_found") == "No").alias("overlap_no"),
        *[F.count_if(F.col("band") == b).alias(b) for b in BANDS],
    )
