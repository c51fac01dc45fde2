"""Evidence to findings: grouping, extrapolation, verdict, severity, ranking.

A finding can gather most of the evidence of a run (one check, one cause), so
nothing here collects a group: counts and extremes combine map-side, citations
go through a ranked cut, and the open-ended lists (components, templates, sites)
are bridge tables, not arrays.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import running
from ..functions.text import half_up
from ..lineage import cut
from .identity import VENDOR_PREFIX

# Grouping exceptions, thresholds, weights.
SINGLE_CAUSE = [
    "focus-not-visible",
    "keyboard-positive-tabindex",
    "link-new-window-unannounced",
    "img-alt-is-filename",
    "img-alt-placeholder",
    "link-generic-text",
    "axe:meta-viewport",
    "axe:html-has-lang",
    "axe:duplicate-id",
]
COLOUR_CHECKS = ["axe:color-contrast", "contrast-hover-insufficient"]
NOISY_RULES = ["color-contrast", "color-contrast-enhanced", "region", "scrollable-region-focusable"]
REVIEW_THRESHOLD = 0.75
VERDICT_RANK = {"fail": 0, "needs-review": 1, "pass": 2, "inapplicable": 3}
BANDS = ["critica", "alta", "media", "bassa"]

#: deterministic order of evidence: "the first" always means this
FIRST = ["page_url", "check_id", "ordinal", "id"]


class Analysis(NamedTuple):
    """Findings and their bridge tables, all keyed by ``finding_id``."""

    findings: DataFrame
    evidence: DataFrame
    components: DataFrame  # finding_id, component
    templates: DataFrame  # finding_id, fingerprint
    sites: DataFrame  # finding_id, site_id

    @property
    def citations(self) -> DataFrame:
        """All citations (see ``cite``), made anew at each use."""
        return cite(self.evidence)

    def cited(self, limit: int) -> DataFrame:
        """The first ``limit`` citations of each finding, stored: few, they meet the evidence without a shuffle of it."""
        return cut(cite(self.evidence, limit))


def dedupe_key() -> Column:
    """What makes two pieces of evidence the same problem."""
    fg = F.coalesce(F.get_json_object("data", "$.checks[0].data.fgColor"), F.get_json_object("data", "$.restColor"), F.lit(""))
    bg = F.coalesce(F.get_json_object("data", "$.checks[0].data.bgColor"), F.lit(""))
    component = F.when(F.coalesce("component_signature", F.lit("")) != "", F.col("component_signature")).otherwise(F.lit("unknown"))
    general = F.concat_ws("::", "check_id", component)
    coloured = F.concat(F.col("check_id"), F.lit("::"), fg, F.lit("|"), bg)
    return (
        F.when(F.col("check_id").isin(SINGLE_CAUSE), F.col("check_id"))
        .when(F.col("check_id").isin(COLOUR_CHECKS) & ((fg != "") | (bg != "")), coloured)
        .otherwise(general)
    )


def finding_id(key: Column) -> Column:
    """Stable across runs: only the key counts."""
    return F.left(F.sha1(key), F.lit(12))


def impact_score(impact: Column) -> Column:
    return (
        F.when(impact == "critical", F.lit(5.0))
        .when(impact == "serious", F.lit(3.5))
        .when(impact == "minor", F.lit(1.0))
        .otherwise(F.lit(2.0))
    )


# what a finding touches: kind of value and the evidence column it comes from
TOUCHED = {"page": "page_url", "component": "component_signature", "template": "fingerprint", "site": "site_id"}


def touches(evidence: DataFrame) -> DataFrame:
    """Distinct ``(key, kind, value)``: pages, components, templates, sites and criteria per problem.

    One narrow pass over the evidence serves every distinct count and bridge
    table; the wide columns stay out of it. Rows are taken apart first: what a
    task holds is the distinct values it has met, not their combinations.
    """

    def one(kind: str, value: Column) -> Column:
        return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), value)

    single = F.array(*[one(k, F.coalesce(c, F.lit(""))) for k, c in TOUCHED.items()])
    listed = F.transform(F.coalesce("criteria", F.array().cast("array<string>")), lambda c: one("criterion", c))
    # the key is made before rows are taken apart, beside the explode it would be made for each part
    keyed = evidence.select(dedupe_key().alias("key"), F.concat(single, listed).alias("_parts"))
    rows = keyed.select("key", F.explode("_parts").alias("t")).select("key", "t.kind", "t.value")
    return rows.filter((F.col("value") != "") | (F.col("kind") == "page")).dropDuplicates()


def touched_values(touched: DataFrame, kind: str) -> DataFrame:
    """Bridge table ``(finding_id, <column>)`` of one kind."""
    rows = touched.filter((F.col("kind") == kind) & (F.col("value") != ""))
    return rows.select(finding_id(F.col("key")).alias("finding_id"), F.col("value").alias(TOUCHED[kind]))


def group_evidence(evidence: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """One row per dedupe key with counts and extremes.

    Counts, and the place (page, check, ordinal) of the first row and of the
    first that names a component, are numbers per key, page and check, which
    tasks hash. Only rows at these places are compared whole, as text in a
    minimum has a task sort all its rows. Distinct counts come from ``touches``.
    """
    named = F.coalesce("component_signature", F.lit("")) != ""
    keyed = evidence.select(dedupe_key().alias("key"), *FIRST, "component_signature", "data", "observation", "engine_impact")

    def least(rows: Column) -> list[Column]:
        """Whether there are ``rows``, whether any has a null ordinal, which comes first, and the least other one."""
        return [F.max(rows), F.max(rows & F.col("ordinal").isNull()), F.min(F.when(rows, F.col("ordinal")))]

    marks = [c.alias(f"_{k}{i}") for k, rows in (("all", F.lit(True)), ("named", named)) for i, c in enumerate(least(rows))]
    places = keyed.groupBy("key", "page_url", "check_id").agg(
        *marks, F.max(impact_score(F.coalesce("engine_impact", F.lit("moderate")))).alias("user_impact"), F.count("*").alias("evidence_count")
    )

    def head(kind: str) -> Column:
        ordinal = F.when(~F.col(f"_{kind}1"), F.col(f"_{kind}2")).alias("ordinal")
        return F.min(F.when(F.col(f"_{kind}0"), F.struct("page_url", "check_id", ordinal)))

    heads = cut(
        places.groupBy("key").agg(
            F.array(head("all"), head("named")).alias("_heads"), F.max("user_impact").alias("user_impact"), F.sum("evidence_count").alias("evidence_count")
        )
    )
    at = heads.select("key", F.explode("_heads").alias("_h")).filter("_h IS NOT NULL").select(F.struct("key", "_h.page_url", "_h.check_id", "_h.ordinal").alias("_at"))
    # nulls within equal structs are equal
    leading = keyed.withColumn("_at", F.struct("key", "page_url", "check_id", "ordinal")).join(at, "_at", "left_semi")
    firsts = leading.groupBy("key").agg(
        F.min(F.struct(*FIRST, "component_signature", "data", "observation")).alias("_first"),
        F.min(F.when(named, F.struct(*FIRST, "component_signature"))).alias("_named"),
    )
    grouped = firsts.join(heads.drop("_heads"), "key")
    touched = touched if touched is not None else touches(evidence)
    # criteria are a closed list of a few dozen values, so the set per key is small
    counts = touched.groupBy("key").agg(
        F.count_if(F.col("kind") == "page").alias("page_count"),
        F.count_if(F.col("kind") == "component").alias("component_count"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "criterion", F.col("value")))).alias("criteria"),
    )

    def field(name: str) -> Column:
        return F.get_json_object("_first.data", f"$.{name}")

    first = F.struct(
        "_first.check_id", "_first.component_signature", "_first.observation",
        field("axeRule").alias("rule"), field("axeDescription").alias("rule_text"), field("helpUrl").alias("help_url"),
    )
    return grouped.join(counts, "key").select(
        "key",
        finding_id(F.col("key")).alias("finding_id"),
        first.alias("first"),
        "criteria",
        "page_count",
        "component_count",
        F.col("_named.component_signature").alias("first_component"),
        "user_impact",
        "evidence_count",
    )


def component_label() -> Column:
    """The one component, the first and how many more, or the document (I16)."""
    n = F.col("component_count")
    many = F.concat(F.col("first_component"), F.lit(" e altri "), (n - 1).cast("string"), F.lit(" componenti"))
    return F.when(n > 1, many).when(n == 1, F.col("first_component")).otherwise(F.lit("documento"))


def bridge(evidence: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column per finding."""
    pairs = evidence.filter(F.coalesce(column, F.lit("")) != "").select(dedupe_key().alias("key"), column).dropDuplicates()
    return pairs.select(finding_id(F.col("key")).alias("finding_id"), column)


def extrapolated_occurrences(finding_templates: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages of the templates a finding touches; an unknown template counts one."""
    return (
        finding_templates.join(templates.select("fingerprint", F.col("page_count").alias("_n")), "fingerprint", "left")
        .groupBy("finding_id")
        .agg(F.sum(F.coalesce("_n", F.lit(1))).alias("occurrences"))
    )


def total_pages(evidence: DataFrame, templates: DataFrame) -> DataFrame:
    """One row ``total``: pages over all templates, else the number of evidence rows (I4)."""
    rows = evidence.agg(F.count("*")).scalar()
    return templates.agg(F.coalesce(F.nullif(F.sum("page_count"), F.lit(0)), rows).alias("total"))


def text_key(check_id: Column) -> Column:
    """Catalogue key: own checks by id, engine rules by rule."""
    return F.when(check_id.startswith("axe"), F.regexp_replace(check_id, r"^axe(-incomplete)?:", "axe:")).otherwise(check_id)


def cite(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Evidence ids of every finding in order, with what orders them.

    All of them by default, ranked in two levels (``running.ranked``), so no
    task sorts a whole finding. A caller may take the first ``limit`` (25 is
    usual); that cut happens before the shuffle.
    """
    keyed = evidence.select(dedupe_key().alias("key"), *FIRST)
    if limit is not None:
        order = Window.partitionBy("key").orderBy(*FIRST)
        numbered = keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    else:
        numbered = running.ranked(keyed, "key", FIRST, "rank").withColumn("rank", F.col("rank").cast("int"))
    return numbered.select(finding_id(F.col("key")).alias("finding_id"), "rank", F.col("id").alias("evidence_id"), "page_url", "check_id", "ordinal")


def cited_evidence(citations: DataFrame, evidence: DataFrame, *columns: str) -> DataFrame:
    """Citations with columns of their evidence, one row per citation.

    The whole order key joins; where rows agree even in that, the least record
    stands for them, so the answer is the same in every run.
    """
    place = ["page_url", "check_id", "ordinal"]
    at = F.struct("evidence_id", *place)
    # what the order key holds is not carried twice
    rest = [c for c in columns if c not in place]
    record = F.struct(*rest) if rest else F.lit(True)
    seen = evidence.withColumnRenamed("id", "evidence_id").select(at.alias("_at"), record.alias("_record"))
    # nulls within equal structs are equal; the grouping stays where the join has dealt its rows
    joined = citations.select("finding_id", "rank", at.alias("_at")).join(seen, "_at")
    grouped = joined.groupBy("_at", "finding_id", "rank").agg(F.min("_record").alias("_record"))
    return grouped.select("finding_id", "rank", *[f"_at.{c}" if c in place else f"_record.{c}" for c in columns])


def criteria_facts(groups: DataFrame, criteria: DataFrame) -> DataFrame:
    """Add ``can_fail`` (I6) and ``legal_exposure`` (I8).

    The criteria are a closed list of a few dozen rows, so they travel as two
    small maps in a scalar subquery and no join is needed.
    """
    weight = F.when(~F.col("baseline"), 1).when(F.col("level") == "A", 5).otherwise(4)
    provable = criteria.filter("automation = 'deterministic'").agg(F.collect_set("criterion")).scalar()
    weights = criteria.agg(F.map_from_entries(F.collect_list(F.struct("criterion", weight)))).scalar()
    known = groups.select("*", provable.alias("_provable"), weights.alias("_weights"))
    heaviest = F.array_max(F.transform("criteria", lambda c: F.element_at("_weights", c)))
    return (
        known.withColumn("can_fail", F.arrays_overlap("criteria", "_provable"))
        .withColumn("legal_exposure", F.coalesce(heaviest, F.lit(2)))
        .drop("_provable", "_weights")
    )


def confidence(check_id: Column, rule: Column, catalogue: Column, page_count: Column) -> Column:
    """Trust in a finding before a person looks."""
    engine = (
        F.when(check_id.startswith("axe-incomplete:"), F.lit(0.35))
        .when(F.coalesce(rule, F.lit("")).isin(NOISY_RULES), F.lit(0.8))
        .otherwise(F.lit(0.95))
    )
    base = F.when(check_id.startswith("axe"), engine).otherwise(F.coalesce(catalogue, F.lit(0.5)))
    return F.when((page_count >= 3) & (base < 0.95), F.least(F.lit(0.95), base + F.lit(0.05))).otherwise(base)


def verdict(check_id: Column, can_fail: Column, trust: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    """Fail only when decided, provable and trusted enough."""
    doubt = check_id.startswith("axe-incomplete:") | ~can_fail | (trust < threshold)
    return F.when(doubt, F.lit("needs-review")).otherwise(F.lit("fail"))


def severity_score(impact: Column, reach: Column, legal: Column) -> Column:
    weighted = (impact / F.lit(5.0)) * F.lit(55.0) + (reach / F.lit(5.0)) * F.lit(25.0) + (legal / F.lit(5.0)) * F.lit(20.0)
    return half_up(weighted, 1)


def reach_score(occurrences: Column, total: Column, primary: Column) -> Column:
    coverage = F.when(total > 0, occurrences / total).otherwise(F.lit(0.0))
    base = (
        F.when(coverage >= 0.8, F.lit(5.0))
        .when(coverage >= 0.4, F.lit(4.0))
        .when(coverage >= 0.15, F.lit(3.0))
        .when(coverage >= 0.05, F.lit(2.0))
        .otherwise(F.lit(1.0))
    )
    return F.when(primary, F.least(F.lit(5.0), base + F.lit(0.5))).otherwise(base)


def band(score: Column) -> Column:
    return F.when(score >= 85, "critica").when(score >= 68, "alta").when(score >= 45, "media").otherwise("bassa")


def default_owner(check_id: Column, criteria: Column) -> Column:
    """Owner when the catalogue is silent."""
    textual = check_id.rlike("alt|text|label|link|title") & F.exists(criteria, lambda c: c.startswith("1.1") | (c == "2.4.4"))
    return F.when(textual, "contenuti").when(check_id.rlike("contrast|color"), "design").otherwise("frontend")


def analyse(
    evidence: DataFrame,
    templates: DataFrame,
    sites: DataFrame,
    criteria: DataFrame | None = None,
    texts: DataFrame | None = None,
    review_threshold: float = REVIEW_THRESHOLD,
) -> Analysis:
    """Findings of a run. ``templates(fingerprint, page_count)``, ``sites(site_id, tier)``.

    ``evidence`` should be a stored table: it is scanned twice for the extremes,
    for what each problem touches, and for the citations.
    """
    spark = evidence.sparkSession
    criteria = criteria if criteria is not None else dims.criteria(spark)
    texts = dims.or_own(texts, dims.texts(spark))

    touched = cut(touches(evidence))
    groups = group_evidence(evidence, touched)
    finding_templates = touched_values(touched, "template")
    finding_sites = touched_values(touched, "site")
    primary = (
        finding_sites.join(sites.filter(F.col("tier") == "primary").select("site_id"), "site_id", "left_semi")
        .select("finding_id", F.lit(True).alias("primary"))
        .dropDuplicates()
    )
    check = F.col("first.check_id")
    joined = (
        criteria_facts(groups, criteria).join(extrapolated_occurrences(finding_templates, templates), "finding_id", "left")
        .join(primary, "finding_id", "left")
        .withColumn("text_key", text_key(check))
        .join(texts, "text_key", "left")
    )
    occurrences = F.coalesce(F.nullif("occurrences", F.lit(0)), F.col("page_count"))
    trust = confidence(check, F.col("first.rule"), F.col("cat_confidence"), F.col("page_count"))
    scored = (
        joined.withColumn("_total", total_pages(evidence, templates).scalar())
        .withColumn("occurrence_count", occurrences)
        .withColumn("trust", trust)
        .withColumn("reach", reach_score(F.col("occurrence_count"), F.col("_total"), F.coalesce("primary", F.lit(False))))
        .withColumn("score", severity_score(F.col("user_impact"), F.col("reach"), F.col("legal_exposure")))
    )
    undecided = check.startswith("axe-incomplete:")
    described = F.trim(F.coalesce("first.rule_text", F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(check, r"^axe(-incomplete)?:", ""), "-", " ")
    title = (
        F.when(F.col("cat_title").isNotNull(), F.concat("cat_title", F.when(undecided, F.lit(" (da verificare)")).otherwise(F.lit(""))))
        .when(described != "", F.regexp_replace(described, r"\.$", ""))
        .otherwise(plain)
    )
    vendor = F.col("first.component_signature").startswith(VENDOR_PREFIX)
    vendor_name = F.substr("first.component_signature", F.lit(len(VENDOR_PREFIX) + 1))
    advice = F.concat(
        F.col("first.observation"),
        F.when(F.coalesce("first.help_url", F.lit("")) != "", F.concat(F.lit("\n\nRiferimento tecnico: "), "first.help_url")).otherwise(F.lit("")),
    )
    findings = scored.select(
        "finding_id",
        "key",
        check.alias("check_id"),
        F.when(vendor, F.concat(title, F.lit(" — "), vendor_name)).otherwise(title).alias("title"),
        "criteria",
        verdict(check, F.col("can_fail"), F.col("trust"), review_threshold).alias("verdict"),
        half_up(F.col("trust"), 2).alias("confidence"),
        half_up(F.col("user_impact"), 1).alias("user_impact"),
        half_up(F.col("reach"), 1).alias("reach"),
        F.col("legal_exposure").cast("int").alias("legal_exposure"),
        "score",
        band(F.col("score")).alias("band"),
        component_label().alias("component"),
        "component_count",
        "occurrence_count",
        "page_count",
        "evidence_count",
        F.coalesce("cat_description", F.when(described != "", described), "first.observation").alias("description"),
        F.coalesce("cat_remediation", advice).alias("remediation"),
        F.col("cat_code").alias("code_example"),
        F.when(vendor, F.lit("fornitore-terzo")).otherwise(F.coalesce("cat_owner", default_owner(check, F.col("criteria")))).alias("owner"),
        F.coalesce("cat_effort", F.lit("medio")).alias("effort"),
        F.lit(False).alias("ai_generated"),
        "can_fail",
    )
    return Analysis(findings, evidence, touched_values(touched, "component"), finding_templates, finding_sites)


def verdict_rank(value: Column) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(r)) for k, r in VERDICT_RANK.items()], F.lit(9))


def rank_order() -> list[Column]:
    """Certain failures first, then by score, then by id."""
    return [verdict_rank(F.col("verdict")).asc(), F.col("score").desc(), F.col("finding_id").asc()]


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*rank_order())


def with_priority(findings: DataFrame) -> DataFrame:
    """Global rank 1..n without a global sort in one task.

    Verdict and score have a small closed domain; two id digits split a crowded
    score. Buckets are counted, their offsets summed, and rows ranked inside
    their bucket.
    """
    bucket = ["_v", "_s", "_d"]
    score = ["_v", "_s"]
    keyed = findings.select(
        "*",
        verdict_rank(F.col("verdict")).alias("_v"),
        (-F.col("score")).alias("_s"),
        F.left("finding_id", F.lit(2)).alias("_d"),
    )
    counts = keyed.groupBy(*bucket).agg(F.count("*").alias("_n"))
    # the digits of a score first, then the scores, of which there are a few thousand at most
    inside = F.sum("_n").over(Window.partitionBy(*score).orderBy("_d")) - F.col("_n")
    scores = counts.groupBy(*score).agg(F.sum("_n").alias("_all"))
    ahead = F.sum("_all").over(Window.orderBy(*score)) - F.col("_all")
    offsets = counts.withColumn("_inside", inside).join(scores.select(*score, ahead.alias("_ahead")), score)
    offsets = offsets.select(*bucket, (F.col("_ahead") + F.col("_inside")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*bucket).orderBy("finding_id"))
    return (
        keyed.withColumn("_local", local)
        .join(offsets, bucket)
        .withColumn("priority", F.col("_before") + F.col("_local"))
        .drop(*bucket, "_local", "_before")
    )


def summary(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts by band, by verdict and overall in one pass, with the dedupe ratio."""
    counts = findings.groupingSets([["band"], ["verdict"], []], "band", "verdict").agg(
        F.count("*").alias("findings"), F.grouping_id().alias("_g")
    )
    total = evidence.agg(F.count("*")).scalar()
    overall = F.col("_g") == 3
    facet = F.when(overall, "all").when(F.col("_g") == 1, "band").otherwise("verdict")
    ratio = F.when(F.col("findings") > 0, half_up(total / F.col("findings"), 1)).otherwise(F.lit(1.0))
    return counts.select(
        facet.alias("facet"),
        F.coalesce("band", "verdict", F.lit("")).alias("value"),
        "findings",
        F.when(overall, total).alias("evidence"),
        F.when(overall, ratio).alias("dedupe_ratio"),
    )
