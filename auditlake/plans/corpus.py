"""End-to-end plans over a crawl corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import checks_static as S
from ..operators import clusters as E
from ..operators import discovery as D
from ..operators import evidence as H
from ..operators import findings as I
from ..operators import identity as ID
from ..operators import structure as ST
from ..operators.observations import union
from ..sources import corpus, html_tree


def audit_inputs(
    raw_pages: DataFrame,
    pattern_urls: DataFrame | None = None,
    rule_results: DataFrame | None = None,
    measurements: DataFrame | None = None,
    markup_chars: int | None = None,
    per_template: int = E.SAMPLES_PER_TEMPLATE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``raw_pages(page_id, url, html)`` to evidence, templates and sites.

    The markup is read once, by the tree job, and reduced to stored element
    rows. From these come the registry of stable classes and ids, fingerprints
    of probe pages, templates, samples, and all static checks on the sampled
    pages; ``rule_results`` (rule-engine rows) and ``measurements`` (observation
    rows) join them there. ``pattern_urls`` widens the URL set that patterns are
    inferred from; ``markup_chars`` is how much of an element's markup evidence
    shows, all by default (300 is usual).
    """
    pages = cut(corpus.canonical_pages(raw_pages))
    parsed = html_tree.element_tree(
        raw_pages.select(F.col("page_id").cast("string").alias("url"), "html"), detail=S.CHECK_TAGS, markup_chars=markup_chars
    ).withColumnRenamed("url", "page_id")
    elements = cut(parsed.join(pages.select(F.col("page_id").cast("string").alias("page_id"), "url"), "page_id").drop("page_id"))

    total = pages.agg(F.count("*")).scalar()
    classes = cut(ID.stable_classes(ID.token_registry(ST.class_inventory(elements)), total))
    ids = cut(ID.stable_ids(ID.token_registry(ST.id_inventory(elements)), total))

    grouped = cut(D.pattern_groups(pages, D.url_patterns(pages if pattern_urls is None else pattern_urls)))
    probes = cut(E.probes(grouped).select("url", "group_key"))
    probed = elements.join(probes.select("url"), "url", "left_semi")
    prints = ID.page_fingerprints(ST.page_material(probed), classes).select("url", "fingerprint")
    keyed = cut(E.assign_fingerprints(grouped, probes.join(prints, "url")))
    templates = cut(E.sample_size(E.templates(keyed), per_template))
    sampled = cut(E.to_measure(keyed, E.samples(keyed, templates)))

    parts = [S.static_checks(sampled, cut(elements.join(sampled.select("url"), "url", "left_semi")))]
    if rule_results is not None:
        parts.append(H.rule_observations(rule_results))
    if measurements is not None:
        parts.append(measurements)
    # signatures read their rows several times, so the checks are run and stored first
    observations = cut(union(*parts))
    evidence = cut(H.to_evidence(observations, sampled, classes, ids))
    tier = F.when(F.col("site_id").startswith("blog."), "primary").otherwise("secondary")
    sites = pages.select("site_id", tier.alias("tier")).dropDuplicates()
    return evidence, templates.select("fingerprint", "page_count"), sites


def audit(raw_pages: DataFrame, **options) -> I.Analysis:
    """Deduplicated, severity-ranked findings of a corpus."""
    return I.analyse(*audit_inputs(raw_pages, **options))
