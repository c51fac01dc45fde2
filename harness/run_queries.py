"""Quality gates, triage, review, reports, replay and diff over the derived evidence log."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.lineage import cut
from auditlake.operators import findings as I
from auditlake.operators import quality as J
from auditlake.operators import replay as M
from auditlake.operators import reports as R
from auditlake.operators import triage as T
from auditlake.sources import logs
from auditlake.streaming import intake

from .audit_queries import flat_findings, log_audit, log_findings
from .core import ORACLES, block, derived, query, scratch, shared, stream

# ---------------------------------------------------------------- quality gates
block("l_scanned", "SELECT count(DISTINCT page_url) AS n FROM ev1")
block(
    "l_spread",
    """SELECT token, count(DISTINCT page_url) AS pages, count(DISTINCT page_url)::DOUBLE / greatest((SELECT n FROM l_scanned), 1)::DOUBLE < 0.15 AS weak
    FROM (SELECT page_url, unnest(regexp_extract_all(component_signature, '[.#][A-Za-z0-9_:-]+')) AS token FROM ev1) GROUP BY token""",
)


def scanned(ev):
    """Pages scanned, as a scalar subquery."""
    return ev.select("page_url").distinct().agg(F.count("*")).scalar()


@query("j1_identifier_spread", "SELECT token, pages, weak FROM l_spread")
def _(spark, sf):
    ev = log_audit(spark, sf)[0]
    return J.identifier_spread(ev, scanned(ev))


block(
    "l_shape",
    """SELECT finding_id, title, component, list_transform(string_split(component, ' > '), lambda d: regexp_replace(d, '[.#\\[].*$', '')) AS tags,
      list_transform(string_split(component, ' > '), lambda d: regexp_extract(d, '[.#][A-Za-z0-9_:-]+')) AS marks FROM l_finding""",
)


@query(
    "j2_duplicate_findings",
    """SELECT title, array_to_string(tags, '>') AS skeleton FROM (
      SELECT a.title, a.tags FROM l_shape a JOIN l_shape b ON a.title = b.title AND a.tags = b.tags AND a.finding_id < b.finding_id
      CROSS JOIN (SELECT list(token) AS weaks FROM l_spread WHERE weak)
      WHERE a.marks <> b.marks AND len(list_filter(range(1, len(a.marks) + 1), lambda i: a.marks[i] <> b.marks[i]
        AND NOT list_contains(weaks, a.marks[i]) AND NOT list_contains(weaks, b.marks[i]))) = 0)
    GROUP BY title, tags""",
)
def _(spark, sf):
    inputs = log_audit(spark, sf)
    ev = inputs[0]
    findings = log_findings(spark, sf, stored=True, inputs=inputs).findings
    return J.duplicate_groups(findings, J.identifier_spread(ev, scanned(ev))).select("title", "skeleton")


@query(
    "j3_unstable_signatures",
    r"""SELECT DISTINCT cls FROM (SELECT unnest(regexp_extract_all(component, '\.([A-Za-z0-9_-]+)', 1)) AS cls FROM l_finding)
    WHERE NOT regexp_matches(cls, '[-_]') AND (lower(cls) IN ('false', 'true', 'undefined', 'null', 'nan', 'none', 'object')
      OR regexp_matches(substr(cls, 2), '[A-Z]') OR NOT regexp_matches(cls, '(?i)[aeiouy]'))""",
)
def _(spark, sf):
    return J.unstable_signatures(log_findings(spark, sf).findings)


@query(
    "j4_mixed_clusters",
    """SELECT count(*) AS clusters, sum(page_count)::BIGINT AS pages, arg_max(fingerprint, (page_count, fingerprint)) AS largest,
      arg_max(sections, (page_count, fingerprint)) AS largest_sections, bool_and(sections <= 1) AS coherent, (SELECT sum(page_count)::BIGINT FROM tpl1) AS total
    FROM tpl1 JOIN (SELECT fingerprint, count(DISTINCT split_part(url, '/', 4)) AS sections FROM template_raw GROUP BY fingerprint) USING (fingerprint)
    WHERE fingerprint LIKE 'mixed-%'""",
)
def _(spark, sf):
    pages = derived(spark, sf, "template_raw")
    return J.mixed_clusters(log_audit(spark, sf)[1], pages).select(
        "clusters", "pages", F.col("largest.fingerprint").alias("largest"), F.col("largest.sections").alias("largest_sections"), "coherent", "total"
    )


@query(
    "j5_coverage_loss",
    """SELECT 'polluted-pages' AS kind, CASE WHEN (expected - scanned)::DOUBLE / expected > 0.4 THEN 'bloccante' ELSE 'attenzione' END AS severity
    FROM (SELECT (SELECT count(*) FROM template_raw) AS expected, (SELECT n FROM l_scanned) AS scanned)
    WHERE expected > scanned AND (expected - scanned)::DOUBLE / expected >= 0.1""",
)
def _(spark, sf):
    pages = derived(spark, sf, "template_raw")
    return J.coverage_issue(pages.agg(F.count("*")).scalar(), scanned(log_audit(spark, sf)[0]), spark).select("kind", "severity")


@query(
    "j6_fragmented_checks",
    "SELECT check_id, count(*) AS findings FROM l_finding WHERE check_id NOT LIKE '%color-contrast%' GROUP BY check_id HAVING count(*) > 6",
)
def _(spark, sf):
    return J.fragmented_checks(log_findings(spark, sf).findings)


@query(
    "j7_text_hygiene",
    r"""SELECT finding_id, title FROM l_finding WHERE regexp_matches(description || title, 'undefined|NaN|\[object Object\]')
      OR regexp_matches(title, '^(Ensure|Elements|Documents|Users|Links|Form|Frames|Images)\b')""",
)
def _(spark, sf):
    return J.broken_texts(log_findings(spark, sf).findings).select("finding_id", "title")


@query(
    "j8_quality_gates",
    """SELECT 'duplicate-findings' AS kind, 'bloccante' AS severity FROM (SELECT count(*) AS n FROM (""" + ORACLES["j2_duplicate_findings"] + """)) WHERE n > 0
    UNION ALL SELECT 'unstable-signature', CASE WHEN n > 5 THEN 'bloccante' ELSE 'attenzione' END FROM (SELECT count(*) AS n FROM (""" + ORACLES["j3_unstable_signatures"] + """)) WHERE n > 0
    UNION ALL SELECT 'fragmented-check', 'attenzione' FROM (SELECT count(*) AS n FROM (""" + ORACLES["j6_fragmented_checks"] + """)) WHERE n > 0
    UNION ALL SELECT 'untranslated-text', 'attenzione' FROM (SELECT count(*) AS n FROM (""" + ORACLES["j7_text_hygiene"] + """)) WHERE n > 0
    UNION ALL SELECT 'mixed-clusters', CASE WHEN top > 0.5 * total AND sections >= 3 THEN 'bloccante' WHEN coherent THEN 'nota' ELSE 'attenzione' END
      FROM (SELECT clusters, pages, coherent, largest_sections AS sections, total, (SELECT max(page_count) FROM tpl1 WHERE fingerprint LIKE 'mixed-%') AS top FROM (""" + ORACLES["j4_mixed_clusters"] + """))
      WHERE (top > 0.5 * total AND sections >= 3) OR pages >= 0.5 * total
    UNION ALL SELECT kind, severity FROM (""" + ORACLES["j5_coverage_loss"] + """)""",
)
def _(spark, sf):
    ev, templates, sites = log_audit(spark, sf)
    pages = derived(spark, sf, "template_raw")
    issues = J.self_check(log_findings(spark, sf, stored=True, inputs=(ev, templates, sites)).findings, ev, templates, pages, pages.agg(F.count("*")).scalar(), scanned(ev))
    return issues.select("kind", "severity")


# ---------------------------------------------------------------- triage and review
@query("t1_candidates", "SELECT finding_id FROM l_finding WHERE NOT (verdict = 'fail' AND confidence >= 0.95 AND band = 'bassa')")
def _(spark, sf):
    return T.candidates(log_findings(spark, sf).findings).select("finding_id")


block("l_cand", "SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'fail' THEN 0 ELSE 1 END, score DESC, finding_id) AS rn, count(*) OVER () AS total FROM l_finding WHERE NOT (verdict = 'fail' AND confidence >= 0.95 AND band = 'bassa')")
block("ev1_one", "SELECT id, min(page_url) AS page_url, min(selector) AS selector, min(observation) AS observation, min(data) AS data, min(check_id) AS check_id, min(screenshot) AS screenshot FROM ev1 GROUP BY id")


@query("t2_pack_samples", "SELECT finding_id, c.rank, e.page_url, e.selector, e.observation, e.data FROM l_cite c JOIN ev1_one e ON e.id = c.evidence_id")
def _(spark, sf):
    inputs = log_audit(spark, sf)
    return T.pack_samples(log_findings(spark, sf, inputs=inputs).citations, inputs[0].withColumn("html", F.lit(""))).drop("html")


@query(
    "t2_pack_rows",
    """SELECT finding_id, 'pack-' || lpad((floor((rn - 1) / 12) + 1)::INTEGER::VARCHAR, 3, '0') AS pack_id, CASE WHEN can_fail THEN 'fail' ELSE 'needs-review' END AS max_verdict,
      (SELECT string_agg(coalesce(d.title, 'criterio non in catalogo') || '/' || coalesce(d.level, '?') || '/' || coalesce(d.automation, 'judgment'), ';' ORDER BY x.c)
        FROM (SELECT unnest(l_cand.criteria) AS c) x LEFT JOIN dim_criteria d ON d.criterion = x.c) AS details,
      (SELECT count(*) FROM l_cite c WHERE c.finding_id = l_cand.finding_id AND c.rank <= 3)::INTEGER AS samples
    FROM l_cand""",
)
def _(spark, sf):
    inputs = log_audit(spark, sf)
    audit = log_findings(spark, sf, stored=True, inputs=inputs)
    ev = inputs[0].withColumn("html", F.lit(""))
    rows = T.pack_rows(audit.findings, audit.cited(T.PACK_SAMPLES), ev)
    details = F.array_join(F.transform("criteria_details", lambda c: F.concat_ws("/", c["title"], c["level"], c["automation"])), ";")
    return rows.select("finding_id", "pack_id", "max_verdict", details.alias("details"), F.size("samples").alias("samples"))


@query(
    "t3_packs",
    """SELECT finding_id, 'pack-' || lpad((floor((rn - 1) / 12) + 1)::INTEGER::VARCHAR, 3, '0') AS pack_id, (floor((rn - 1) / 12) + 1)::INTEGER AS pack_index,
      ceil(total / 12.0)::INTEGER AS pack_total, ((rn - 1) % 12 + 1)::INTEGER AS position FROM l_cand""",
)
def _(spark, sf):
    return T.packs(T.candidates(log_findings(spark, sf, stored=True).findings))


# answers and decisions: each label speaks of one finding, by its place in the ranking
block("l_numbered", "SELECT *, priority - 1 AS k FROM l_ranked")
block(
    "answer_log",
    """SELECT n.finding_id, 'f' || doc_id % 5 AS file, doc_id AS position, CASE quality * 2 + toxic WHEN 0 THEN 'needs-review' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' ELSE 'inapplicable' END AS verdict,
      0.5::DOUBLE + (doc_id % 5) * 0.125::DOUBLE AS confidence, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Titolo ' || doc_id END AS title, 'cms' AS owner
    FROM labels JOIN l_numbered n ON n.k = doc_id % 150""",
)


def answers(spark, sf, findings):
    from .core import table

    numbered = I.with_priority(findings).select("finding_id", (F.col("priority") - 1).alias("k"))
    marks = table(spark, sf, "labels")
    code = F.col("quality") * 2 + F.col("toxic")
    return marks.join(numbered, F.col("k") == F.col("doc_id") % 150).select(
        "finding_id",
        F.concat(F.lit("f"), F.col("doc_id") % 5).alias("file"),
        F.col("doc_id").alias("position"),
        F.when(code == 0, "needs-review").when(code == 1, "pass").when(code == 2, "fail").otherwise("inapplicable").alias("verdict"),
        (F.lit(0.5) + (F.col("doc_id") % 5) * F.lit(0.125)).alias("confidence"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Titolo "), "doc_id")).alias("title"),
        F.lit("").alias("description"),
        F.lit("Rimedio").alias("remediation"),
        F.lit(None).cast("string").alias("code_example"),
        F.lit("cms").alias("owner"),
        F.lit("alto").alias("effort"),
    )


block("answer_last", "SELECT finding_id, arg_max(verdict, (file, position)) AS tv, arg_max(confidence, (file, position)) AS tc, arg_max(title, (file, position)) AS tt FROM answer_log GROUP BY finding_id")


@query(
    "t4_triaged_findings",
    """SELECT finding_id, CASE WHEN tv IS NULL THEN verdict WHEN tv = 'fail' AND NOT can_fail THEN 'needs-review' ELSE tv END AS verdict, coalesce(tc, confidence) AS confidence,
      coalesce(nullif(tt, ''), title) AS title, description, CASE WHEN tv IS NULL THEN remediation ELSE 'Rimedio' END AS remediation, CASE WHEN tv IS NULL THEN owner ELSE 'cms' END AS owner,
      CASE WHEN tv IS NULL THEN effort ELSE 'alto' END AS effort, tv IS NOT NULL AS ai_generated, coalesce(verdict = 'needs-review' AND tv = 'fail' AND can_fail, false) AS promoted
    FROM l_finding LEFT JOIN answer_last USING (finding_id)""",
)
def _(spark, sf):
    findings = log_findings(spark, sf, stored=True).findings
    merged, _refused = T.apply_triage(findings, answers(spark, sf, findings))
    return merged.select("finding_id", "verdict", "confidence", "title", "description", "remediation", "owner", "effort", "ai_generated", "promoted")


@query("t4_refused_verdicts", "SELECT finding_id, tv AS asked, 'needs-review' AS cap FROM l_finding JOIN answer_last USING (finding_id) WHERE tv = 'fail' AND NOT can_fail")
def _(spark, sf):
    findings = log_findings(spark, sf, stored=True).findings
    return T.apply_triage(findings, answers(spark, sf, findings))[1]


@query(
    "t5_review_queue",
    """SELECT f.finding_id, f.score, page_count AS n_pages,
      (SELECT string_agg(observation, '|' ORDER BY rank) FROM l_cite c JOIN ev1_one e ON e.id = c.evidence_id WHERE c.finding_id = f.finding_id AND rank <= 4) AS notes,
      (SELECT arg_min(screenshot, rank) FROM l_cite c JOIN ev1_one e ON e.id = c.evidence_id WHERE c.finding_id = f.finding_id AND screenshot <> '' AND rank <= 4) AS screenshot,
      evidence_count AS n_rows
    FROM l_finding f WHERE verdict = 'needs-review'""",
)
def _(spark, sf):
    inputs = log_audit(spark, sf)
    audit = log_findings(spark, sf, stored=True, inputs=inputs)
    queue = T.review_queue(audit.findings, audit.cited(T.REVIEW_NOTES), inputs[0])
    return queue.select("finding_id", "score", "n_pages", F.array_join("notes.observation", "|").alias("notes"), "screenshot", "n_rows")


@query(
    "t5_review_notes",
    """SELECT finding_id, c.rank, e.page_url, e.observation, e.selector, e.screenshot FROM l_cite c JOIN ev1_one e ON e.id = c.evidence_id
    JOIN l_finding USING (finding_id) WHERE verdict = 'needs-review'""",
)
def _(spark, sf):
    inputs = log_audit(spark, sf)
    audit = log_findings(spark, sf, inputs=inputs)
    return T.review_notes(audit.findings, audit.citations, inputs[0])


block(
    "review_log",
    """SELECT n.finding_id, CASE doc_id % 5 WHEN 0 THEN 'non-conforme' WHEN 1 THEN 'conforme' WHEN 2 THEN 'irrilevante' WHEN 3 THEN 'da-approfondire' ELSE 'boh' END AS outcome, doc_id AS ts
    FROM labels JOIN l_numbered n ON n.k = doc_id % 170 + 20""",
)
block("review_last", "SELECT finding_id, arg_max(outcome, ts) AS outcome FROM review_log WHERE outcome <> 'boh' GROUP BY finding_id")
block(
    "l_reviewed",
    """SELECT f.* EXCLUDE (verdict), CASE outcome WHEN 'non-conforme' THEN 'fail' WHEN 'conforme' THEN 'pass' ELSE verdict END AS verdict, outcome
    FROM l_finding f LEFT JOIN review_last USING (finding_id)""",
)


def reviewed(spark, sf):
    from .core import table

    findings = log_findings(spark, sf, stored=True).findings
    numbered = I.with_priority(findings).select("finding_id", (F.col("priority") - 1).alias("k"))
    kinds = F.array(*[F.lit(o) for o in [*T.OUTCOMES, "boh"]])
    log = table(spark, sf, "labels").join(numbered, F.col("k") == F.col("doc_id") % 170 + 20).select(
        "finding_id",
        F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("outcome"),
        F.lit("").alias("note"),
        F.lit("rev").alias("reviewer"),
        F.timestamp_seconds("doc_id").alias("ts"),
    )
    return T.apply_reviews(findings, log)


@query("t6_reviewed_findings", "SELECT finding_id, verdict, outcome AS review_outcome FROM l_reviewed")
def _(spark, sf):
    return reviewed(spark, sf).select("finding_id", "verdict", "review_outcome")


@query(
    "t7_review_progress",
    "SELECT count(*) FILTER (verdict = 'needs-review' AND outcome IS NULL) AS remaining, count(outcome) AS reviewed FROM l_reviewed",
)
def _(spark, sf):
    return T.review_progress(reviewed(spark, sf))


# ---------------------------------------------------------------- reports
@query(
    "r1_synopsis",
    """SELECT 'run' AS section, metric, value::DOUBLE AS value FROM (
      SELECT 'sites' AS metric, (SELECT count(*) FROM site1) AS value UNION ALL SELECT 'pages_discovered', (SELECT count(*) FROM template_raw)
      UNION ALL SELECT 'templates', (SELECT count(*) FROM tpl1) UNION ALL SELECT 'pages_scanned', (SELECT n FROM l_scanned)
      UNION ALL SELECT 'evidence', (SELECT count(*) FROM ev1) UNION ALL SELECT 'findings', (SELECT count(*) FROM l_finding))
    UNION ALL SELECT 'run', 'dedupe_ratio', floor((SELECT count(*) FROM ev1)::DOUBLE / (SELECT count(*) FROM l_finding) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE
    UNION ALL SELECT 'band', b, (SELECT count(*) FROM l_finding WHERE band = b) FROM (VALUES ('critica'), ('alta'), ('media'), ('bassa')) t(b)
    UNION ALL SELECT 'verdict', v, (SELECT count(*) FROM l_finding WHERE verdict = v) FROM (VALUES ('fail'), ('needs-review')) t(v)""",
)
def _(spark, sf):
    ev, templates, sites = log_audit(spark, sf)
    pages = derived(spark, sf, "template_raw")
    return R.synopsis(log_findings(spark, sf, stored=True, inputs=(ev, templates, sites)).findings, ev, templates, sites, pages.agg(F.count("*")).scalar(), scanned(ev))


@query(
    "r2_backlog",
    """SELECT priority, f.finding_id AS id, title AS problem, CASE verdict WHEN 'fail' THEN 'Non conforme' ELSE 'Da verificare' END AS outcome,
      upper(band[1]) || band[2:] AS severity, score, array_to_string(criteria, ', ') AS criteria,
      coalesce((SELECT string_agg(level, '/' ORDER BY p) FROM (SELECT level, min(x.p) AS p FROM (SELECT unnest(f.criteria) AS c, generate_subscripts(f.criteria, 1) AS p) x
        JOIN dim_criteria d ON d.criterion = x.c GROUP BY level)), '—') AS level,
      component, (SELECT string_agg(label, ', ' ORDER BY site_id) FROM (SELECT DISTINCT site_id FROM l_keyed k WHERE k.key = f.key) JOIN site1 USING (site_id)) AS sites,
      occurrence_count AS estimated_occurrences, page_count AS observed_pages, owner, effort, description, remediation, coalesce(code_example, '') AS code, confidence,
      (SELECT arg_min(page_url, seq) FROM l_keyed k WHERE k.key = f.key) AS sample_url, 'Da fare' AS status, '' AS notes
    FROM l_ranked f""",
)
def _(spark, sf):
    inputs = log_audit(spark, sf)
    a = log_findings(spark, sf, stored=True, inputs=inputs)
    return R.backlog(a.findings, a.cited(1), a.sites, inputs[2])


@query(
    "r3_evidence_listing",
    """SELECT id, label AS site, page_url AS url, check_id AS "check", array_to_string(criteria, ', ') AS criteria, component_signature AS component,
      selector, observation, coalesce(engine_impact, '') AS impact FROM ev1 JOIN site1 USING (site_id)""",
)
def _(spark, sf):
    ev, _templates, sites = log_audit(spark, sf)
    return R.evidence_listing(ev, sites)


@query(
    "r5_criteria_coverage",
    """SELECT d.criterion, d.title, level, principle, CASE automation WHEN 'deterministic' THEN 'Sì, in automatico' WHEN 'partial' THEN 'Parziale' ELSE 'No, solo verifica umana' END AS automation,
      coalesce(hits, 0) AS hits, coalesce(fails, 0) AS fails, coalesce(reviews, 0) AS reviews,
      CASE WHEN fails > 0 THEN 'Non conforme' WHEN reviews > 0 THEN 'Da verificare' WHEN automation = 'deterministic' THEN 'Nessun problema rilevato' ELSE 'Non verificato in automatico' END AS outcome,
      plain_language
    FROM dim_criteria d LEFT JOIN (SELECT criterion, count(*) AS hits, count(*) FILTER (verdict = 'fail') AS fails, count(*) FILTER (verdict = 'needs-review') AS reviews
      FROM l_crit JOIN l_finding USING (finding_id) GROUP BY criterion) h USING (criterion) WHERE baseline""",
)
def _(spark, sf):
    return R.criteria_coverage(log_findings(spark, sf).findings)


@query(
    "r6_dashboard_tiles",
    """SELECT count(*) AS findings, count(*) FILTER (verdict = 'fail') AS fails, count(*) FILTER (verdict = 'needs-review') AS reviews, (SELECT count(*) FROM ev1) AS evidence,
      (SELECT count(*) FROM tpl1) AS templates, (SELECT sum(page_count)::BIGINT FROM tpl1) AS ecosystem_pages,
      floor((SELECT sum(page_count) FROM tpl1)::DOUBLE / (SELECT n FROM l_scanned) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS compression, (SELECT count(*) FROM site1) AS sites,
      (SELECT count(*) FROM site1 WHERE tier = 'primary') AS primary_sites FROM l_finding""",
)
def _(spark, sf):
    ev, templates, sites = log_audit(spark, sf)
    return R.dashboard_tiles(log_findings(spark, sf, inputs=(ev, templates, sites)).findings, ev, templates, sites, scanned(ev))


@query(
    "r6_band_bars",
    """SELECT b AS band, n AS findings, floor(n::DOUBLE / greatest(max(n) OVER (), 1) * 100 + 0.5::DOUBLE)::INTEGER AS percent
    FROM (SELECT b, (SELECT count(*) FROM l_finding WHERE band = b) AS n FROM (VALUES ('critica'), ('alta'), ('media'), ('bassa')) t(b))""",
)
def _(spark, sf):
    return R.band_bars(log_findings(spark, sf).findings)


@query("r7_criteria_frequency", "SELECT criterion, count(*) AS findings FROM l_crit GROUP BY criterion")
def _(spark, sf):
    return R.criteria_frequency(log_findings(spark, sf).findings)


# every combination of facets, absent and unknown values among them, with and without text
SEARCHED = {
    "text": ["", " BLK-1", "Contrast", "qwertz"], "verdict": ["", "fail", "needs-review", "pass"], "band": ["", "critica", "alta", "media", "bassa"],
    "site": ["", "s0", "s3", "nowhere"], "owner": ["", *T.OWNERS],
}
block("searched", "SELECT concat_ws('/', text, verdict, band, site, owner) AS request_id, * FROM " + ", ".join(f"(VALUES {', '.join(f"('{v}')" for v in vs)}) {c}_({c})" for c, vs in SEARCHED.items()))


@query(
    "r8_finding_search",
    """SELECT request_id, finding_id FROM l_finding f JOIN searched s ON (s.verdict IN ('', f.verdict)) AND (s.band IN ('', f.band)) AND (s.owner IN ('', f.owner))
      AND contains(lower(concat_ws(' ', title, component, array_to_string(criteria, ' '), description, f.owner)), lower(trim(s.text)))
    WHERE s.site = '' OR EXISTS (SELECT 1 FROM l_keyed k WHERE k.key = f.key AND site_id = s.site)""",
)
def _(spark, sf):
    a = log_findings(spark, sf, stored=True)
    requests = spark.range(1)
    for column, kinds in SEARCHED.items():
        requests = requests.withColumn(column, F.explode(F.array(*map(F.lit, kinds))))
    requests = requests.withColumn("request_id", F.concat_ws("/", *SEARCHED))
    return R.search_all(a.findings, a.sites, requests)


@query(
    "r8_one_search",
    """SELECT finding_id FROM l_finding f WHERE verdict = 'needs-review' AND band = 'bassa' AND owner = 'frontend' AND contains(lower(title || ' ' || component), 'blk-1')
      AND EXISTS (SELECT 1 FROM l_keyed k WHERE k.key = f.key AND site_id = 's3')""",
)
def _(spark, sf):
    a = log_findings(spark, sf)
    return R.search(a.findings, a.sites, " BLK-1", "needs-review", "bassa", "s3", "frontend").select("finding_id")


@query(
    "r10_results_by_facet",
    "SELECT coalesce(band, '*') AS band, coalesce(owner, '*') AS owner, count(*) AS findings FROM l_finding GROUP BY CUBE (band, owner)",
)
def _(spark, sf):
    return R.results_by_facet(log_findings(spark, sf).findings)


@query(
    "r11_comparison_rows",
    """SELECT finding_id, title, component, band, score, verdict, occurrence_count,
      page_count AS pages, owner,
      floor(confidence * 100 + 0.5::DOUBLE)::INTEGER AS confidence FROM l_finding f""",
)
def _(spark, sf):
    a = log_findings(spark, sf, stored=True)
    rows = R.comparison_rows(a.findings, a.cited(1))
    return rows.select("finding_id", "title", "component", "band", "score", "verdict", "occurrence_count", "pages", "owner", "confidence")


shared(
    "judged_rows",
    """SELECT CASE doc_id % 7 WHEN 0 THEN 'Confermato' WHEN 1 THEN 'Confermato' WHEN 2 THEN 'Falso positivo' WHEN 3 THEN 'Irrilevante nel contesto' WHEN 4 THEN 'Severità diversa'
      WHEN 5 THEN 'Da approfondire' END AS judgement, CASE WHEN toxic = 1 THEN 'Sì' WHEN quality = 1 THEN 'No' END AS already_found,
      CASE doc_id % 4 WHEN 0 THEN 'critica' WHEN 1 THEN 'alta' WHEN 2 THEN 'media' ELSE 'bassa' END AS band FROM {labels}""",
)


@query(
    "r12_comparison_outcome",
    """SELECT count(*) AS "rows", count(judgement) AS judged, count(*) FILTER (judgement = 'Confermato') AS confirmed, count(*) FILTER (judgement = 'Falso positivo') AS false_positives,
      count(*) FILTER (judgement = 'Irrilevante nel contesto') AS irrelevant, count(*) FILTER (judgement = 'Severità diversa') AS wrong_severity,
      count(*) FILTER (judgement = 'Da approfondire') AS undecided, count(*) FILTER (judgement = 'Confermato')::DOUBLE / count(judgement) AS confirm_rate,
      count(*) FILTER (judgement = 'Falso positivo')::DOUBLE / count(judgement) AS false_positive_rate, count(*) FILTER (already_found = 'Sì') AS overlap_yes,
      count(*) FILTER (already_found = 'No') AS overlap_no, count(*) FILTER (band = 'critica') AS critica, count(*) FILTER (band = 'alta') AS alta,
      count(*) FILTER (band = 'media') AS media, count(*) FILTER (band = 'bassa') AS bassa FROM judged_rows""",
)
def _(spark, sf):
    return R.comparison_outcome(derived(spark, sf, "judged_rows"))


# ---------------------------------------------------------------- replay, diff, resume
block(
    "ev2",
    r"""SELECT * EXCLUDE (component_signature), CASE WHEN component_signature = '' OR component_signature LIKE 'terze-parti:%' THEN component_signature
      ELSE array_to_string(list_filter(list_transform(string_split(component_signature, ' > '), lambda d: CASE WHEN regexp_matches(d, '^[^.#]+\.(aBcDe[0-9]|crhcdd)$') THEN regexp_extract(d, '^[^.]+') ELSE d END),
        lambda d, i: i = 1 OR i = len(string_split(component_signature, ' > ')) OR (i = 2 AND component_signature LIKE 'banner-consenso%') OR d NOT IN ('div', 'span', 'section')), ' > ') END AS component_signature
    FROM ev1""",
)
from .audit_queries import finding_blocks  # noqa: E402

finding_blocks("r", "ev2", "tpl1", "site1")


def stored_evidence(spark, sf):
    return log_audit(spark, sf)[0].withColumn("signature_input", F.lit(None).cast("string"))


def no_tokens(spark):
    return spark.createDataFrame([], "token string")


@query("m1_replayed_signatures", "SELECT a.sig AS component_signature, count(*) AS n FROM (SELECT component_signature AS sig FROM ev2) a GROUP BY 1")
def _(spark, sf):
    out = M.replay_signatures(stored_evidence(spark, sf), no_tokens(spark))
    return out.groupBy("component_signature").agg(F.count("*").alias("n"))


@query("m2_replayed_findings", "SELECT finding_id, title, verdict, score, occurrence_count, page_count, component FROM r_finding")
def _(spark, sf):
    _ev, templates, sites = log_audit(spark, sf)
    replayed = cut(M.replay_signatures(stored_evidence(spark, sf), no_tokens(spark)).drop("changed"))
    found = I.analyse(replayed, templates, sites).findings
    return found.select("finding_id", "title", "verdict", "score", "occurrence_count", "page_count", "component")


@query(
    "m3_run_diff",
    """SELECT coalesce(b.title, a.title) AS title, coalesce(b.occurrence_count, a.occurrence_count) AS occurrence_count, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after,
      CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'shrunk' ELSE 'grown' END AS change
    FROM (SELECT title, occurrence_count, count(*) AS n FROM l_finding GROUP BY 1, 2) b
    FULL JOIN (SELECT title, occurrence_count, count(*) AS n FROM r_finding GROUP BY 1, 2) a ON a.title = b.title AND a.occurrence_count = b.occurrence_count
    WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def _(spark, sf):
    _ev, templates, sites = log_audit(spark, sf)
    after = M.replay(stored_evidence(spark, sf), templates, sites, no_tokens(spark)).findings
    return M.run_diff(log_findings(spark, sf, stored=True).findings, after)


# a scan log as JSON lines, one per order; every 17th line was cut mid-write
shared(
    "scan_line",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN substr(line, 1, length(line) - 9) WHEN o_orderkey % 19 = 0 THEN '  ' ELSE line END AS value FROM (
      SELECT o_orderkey, '{"url":"https://s' || CAST(o_custkey % 7 AS STRING) || '.example/' || CAST(o_orderkey AS STRING) || '","siteId":"s' || CAST(o_custkey % 7 AS STRING) || '","fingerprint":"tpl-' || CAST(o_orderkey % 37 AS STRING)
        || '","title":"T","evidence":[' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '{"id":"e' || CAST(o_orderkey AS STRING) || '","checkId":"title-too-short","pageUrl":"p","criteria":["2.4.2"],"selector":"head > title","componentSignature":"document","observation":"x","data":{"n":' || CAST(o_orderkey % 3 AS STRING) || '}}' END
        || '],"tabOrder":[],"passedRules":["region"],' || CASE WHEN o_orderkey % 5 = 0 THEN '"error":"pagina persa",' ELSE '' END || '"httpStatus":200,"durationMs":' || CAST(o_orderkey % 900 AS STRING) || '}' AS line
      FROM {orders})""",
)
block("scan_ok", "SELECT * FROM scan_line JOIN orders ON o_orderkey = k WHERE k % 17 <> 0 AND k % 19 <> 0")


def scan_results(spark, sf):
    return logs.parse_results(derived(spark, sf, "scan_line").select("value"))


@query("a5_scan_log", "SELECT 'https://s' || o_custkey % 7 || '.example/' || k AS url, 's' || o_custkey % 7 AS site_id, (k % 900)::BIGINT AS duration_ms, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END::INTEGER AS evidence FROM scan_ok")
def _(spark, sf):
    return scan_results(spark, sf)[0].select("url", "site_id", "duration_ms", F.size("evidence").alias("evidence"))


@query("a5_rejected_lines", "SELECT value FROM scan_line WHERE k % 17 = 0")
def _(spark, sf):
    return scan_results(spark, sf)[1]


@query(
    "m4_resume",
    "SELECT k, url FROM (SELECT k, 'https://s' || o_custkey % 7 || '.example/' || k AS url FROM scan_ok) WHERE k % 3 <> 1",
)
def _(spark, sf):
    url_key = F.regexp_extract("url", r"/(\d+)$", 1).cast("bigint")
    done = scan_results(spark, sf)[0].select(url_key.alias("k"), "url", "site_id")
    return M.resume(done.filter("k % 3 = 0"), done.filter("k % 3 <> 1")).select("k", "url")


@query("m4_pending_pages", "SELECT k, 'https://s' || o_custkey % 7 || '.example/' || o_orderkey AS url FROM scan_line JOIN orders ON o_orderkey = k WHERE k % 17 = 0 OR k % 19 = 0")
def _(spark, sf):
    from .core import table

    url = F.concat(F.lit("https://s"), F.col("o_custkey") % 7, F.lit(".example/"), F.col("o_orderkey"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), url.alias("url"))
    return M.pending_pages(pages, scan_results(spark, sf)[0])


@query(
    "m8_scan_rollup",
    "SELECT count(*) FILTER (k % 5 <> 0) AS pages_scanned, count(*) FILTER (k % 5 = 0) AS pages_failed, count(*) FILTER (k % 4 <> 0)::BIGINT AS evidence_collected FROM scan_ok",
)
def _(spark, sf):
    return M.scan_rollup(scan_results(spark, sf)[0])


@query("m8_flattened_evidence", "SELECT 'e' || k AS id, 'title-too-short' AS check_id, '2.4.2' AS criteria, '{\"n\":' || k % 3 || '}' AS data FROM scan_ok WHERE k % 4 <> 0")
def _(spark, sf):
    return logs.evidence_of(scan_results(spark, sf)[0]).select("id", "check_id", F.array_join("criteria", " ").alias("criteria"), "data")


@query("m9_evidence_digest", "SELECT concat_ws('|', page_url, check_id, selector, component_signature) AS digest, count(*) AS n FROM ev1 GROUP BY 1")
def _(spark, sf):
    return M.digest(log_audit(spark, sf)[0])


@query(
    "m9_digest_difference",
    """SELECT concat_ws('|', page_url, check_id, selector, component_signature) AS digest, count(*) AS n, 'left' AS side FROM ev1 WHERE site_id = 's6' GROUP BY 1""",
)
def _(spark, sf):
    ev = log_audit(spark, sf)[0]
    return M.same_evidence(ev, ev.filter("site_id <> 's6'"))


@query(
    "h11_screenshot_requests",
    """SELECT page_url, component_signature FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY ordinal, check_id, id) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY page_url, component_signature ORDER BY ordinal, check_id, id) AS rn FROM ev1
      WHERE engine_impact IN ('critical', 'serious') AND selector NOT IN ('', 'body')) WHERE rn = 1)""",
)
def _(spark, sf):
    from auditlake.operators import evidence as H

    return H.screenshot_requests(log_audit(spark, sf)[0]).select("page_url", "component_signature")


# ---------------------------------------------------------------- triage answer files, one per ten labels
def answer_files(spark, sf):
    from .core import table

    k = F.col("doc_id")
    verdict = F.when(k % 23 == 0, "maybe").when(F.col("quality") == 1, "fail").otherwise("pass")
    one = F.format_string(
        '{"id":"f%d","verdict":"%s","confidence":0.5,"title":"T","description":"D","remediation":"R","owner":"cms","effort":"basso","rationale":"x"}',
        k.cast("bigint"), verdict,
    )
    n = F.floor(k / 10)
    # a file holds at most ten answers by construction
    files = table(spark, sf, "labels").groupBy(n.alias("n")).agg(F.array_sort(F.collect_list(F.struct(k, one.alias("o")))).getField("o").alias("os"))
    body = F.concat(F.lit('{"schemaVersion":"1.0","packId":"pack-'), "n", F.lit('","findings":['), F.array_join("os", ","), F.lit("]}"))
    fenced = F.when(F.col("n") % 3 == 0, F.concat(F.lit("  ```json\n"), body, F.lit("\n``` \n"))).when(
        F.col("n") % 7 == 1, F.left(body, F.length(body) - 4)
    )
    return files.select(F.concat("n", F.lit(".json")).alias("file"), F.coalesce(fenced, body).alias("content"))


block("answer_file", "SELECT floor(doc_id / 10)::BIGINT AS n, bool_or(doc_id % 23 = 0) AS odd FROM labels GROUP BY 1")
block("answer_good", "SELECT n FROM answer_file WHERE NOT odd AND NOT (n % 7 = 1 AND n % 3 <> 0)")


@query("a9_triage_answers", "SELECT n || '.json' AS file, 'f' || doc_id AS finding_id, CASE WHEN quality = 1 THEN 'fail' ELSE 'pass' END AS verdict FROM labels JOIN answer_good ON n = floor(doc_id / 10)")
def _(spark, sf):
    return T.parse_answers(answer_files(spark, sf))[0].select("file", "finding_id", "verdict")


@query("a9_rejected_files", "SELECT n || '.json' AS file FROM answer_file WHERE n NOT IN (SELECT n FROM answer_good)")
def _(spark, sf):
    return T.parse_answers(answer_files(spark, sf))[1]


# ---------------------------------------------------------------- stored runs, reports, streams
def run_document(spark, sf):
    """Sites and templates of the derived run as one JSON document in a file."""
    path = scratch(spark)
    templates = derived(spark, sf, "template_raw").groupBy("fingerprint").agg(F.count("*").alias("pages"))
    listed = templates.agg(F.collect_list(F.struct("*"))).scalar().alias("templates")
    sites = derived(spark, sf, "site_raw").agg(F.collect_list(F.struct("*")).alias("sites"))
    sites.select(F.to_json(F.struct("sites", listed))).write.text(path)
    return path


@query("a6_run_document", "SELECT fingerprint, page_count AS pages FROM tpl1")
def _(spark, sf):
    return logs.load_run(spark, run_document(spark, sf))["templates"].select("fingerprint", "pages")


@query("a7_stored_run", "SELECT fingerprint, page_count FROM tpl1 WHERE fingerprint LIKE 'tpl-%'")
def _(spark, sf):
    root, templates = scratch(spark), log_audit(spark, sf)[1]
    logs.store_run({"templates": templates}, root, "r1")
    logs.store_run({"templates": templates}, root, "r2")
    logs.store_run({"templates": templates.filter("fingerprint LIKE 'tpl-%'")}, root, "r1")
    return logs.read_run(spark, root, "templates", "r1")


@query("a10_written_reports", "SELECT band, owner, findings::VARCHAR AS findings FROM (" + ORACLES["r10_results_by_facet"] + ")")
def _(spark, sf):
    root = scratch(spark)
    logs.write_reports({"facets": R.results_by_facet(log_findings(spark, sf).findings)}, root, "csv")
    return spark.read.option("header", True).option("escape", '"').csv(f"{root}/facets")


@query("m7_reused_discovery", "SELECT 'templates' AS relation, (SELECT count(*) FROM tpl1) AS n UNION ALL SELECT 'sites', (SELECT count(*) FROM site1) UNION ALL SELECT 'evidence', 0")
def _(spark, sf):
    evidence, templates, sites = log_audit(spark, sf)
    kept = M.reuse_discovery({"templates": templates, "sites": sites, "evidence": evidence})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("j8_trustworthy", "SELECT count(*) AS issues, NOT coalesce(bool_or(severity = 'bloccante'), false) AS trustworthy FROM (" + ORACLES["j8_quality_gates"] + ")")
def _(spark, sf):
    ev, templates, sites = log_audit(spark, sf)
    pages = derived(spark, sf, "template_raw")
    findings = log_findings(spark, sf, stored=True, inputs=(ev, templates, sites)).findings
    return J.trustworthy(J.self_check(findings, ev, templates, pages, pages.agg(F.count("*")).scalar(), scanned(ev)))


def taken(spark, sf):
    root = scratch(spark)
    lines = derived(spark, sf, "scan_line", stream).select("value")
    for running in intake.scan_intake(lines, f"{root}/results", f"{root}/rejected", f"{root}/state"):
        running.awaitTermination()
    return root


@query("n1_scan_stream", ORACLES["a5_scan_log"].replace(", CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END::INTEGER AS evidence", ""))
def _(spark, sf):
    return spark.read.parquet(f"{taken(spark, sf)}/results").select("url", "site_id", "duration_ms")


@query("n1_rejected_lines", ORACLES["a5_rejected_lines"])
def _(spark, sf):
    return spark.read.parquet(f"{taken(spark, sf)}/rejected").select("value")


# decisions on fifty findings; every seventh says nothing known
shared(
    "decision",
    """SELECT 'f' || CAST(doc_id % 50 AS STRING) AS finding_id, CASE WHEN doc_id % 7 = 0 THEN 'boh' WHEN quality = 1 THEN 'conforme' ELSE 'non-conforme' END AS outcome, '' AS note, 'r' AS reviewer, doc_id
    FROM {labels}""",
)


@query("n2_review_stream", "SELECT finding_id, arg_max(outcome, doc_id) AS outcome FROM decision WHERE outcome <> 'boh' GROUP BY finding_id")
def _(spark, sf):
    root = scratch(spark)
    decisions = derived(spark, sf, "decision", stream).withColumn("ts", F.timestamp_seconds("doc_id")).drop("doc_id")
    intake.review_intake(decisions, f"{root}/reviews", f"{root}/state").awaitTermination()
    return intake.read_reviews(spark, f"{root}/reviews").select("finding_id", "outcome")
