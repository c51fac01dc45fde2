"""Elements, static checks, evidence and findings over the corpus and over a derived evidence log."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.dims.catalogue import CHECKS, RULES
from auditlake.dims.criteria import CRITERIA
from auditlake.operators import checks_static as S
from auditlake.operators import evidence as H
from auditlake.operators import findings as I
from auditlake.lineage import cut
from auditlake.operators import structure as ST
from auditlake.operators.observations import CHECK_META
from auditlake.sources import html_flat, html_tree

from .core import block, derived, query, shared, table, values
from .urls_queries import pages

# ---------------------------------------------------------------- dimensions
block("dim_criteria", values([(c[0], c[1], c[2], c[3], c[4], c[5], c[6]) for c in CRITERIA], "criterion, title, level, principle, automation, baseline, plain_language"))
block(
    "dim_text",
    values(
        [(k, *v) for k, v in CHECKS.items()] + [(f"axe:{k}", *v) for k, v in RULES.items()],
        "text_key, cat_title, cat_description, cat_remediation, cat_code, cat_owner, cat_effort, cat_confidence",
    ),
)
block("dim_meta", values([(k, " ".join(c), i) for k, (c, i) in CHECK_META.items()], "check_id, criteria, impact"))

# ---------------------------------------------------------------- flat elements
DECODE = "text"
for name, char in [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
    DECODE = f"replace({DECODE}, '{name}', '{char}')"
block(
    "tag_raw",
    r"""SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS ordinal FROM (
      SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
        '<[a-zA-Z][a-zA-Z0-9-]*[^>]*>[^<]*') AS ms FROM pages)""",
)
block(
    "el",
    rf"""SELECT p.url, p.site_id, e.page_id, ordinal, tag, attrs, trim(regexp_replace({DECODE}, '\s+', ' ', 'g')) AS text
    FROM (SELECT page_id, ordinal, lower(regexp_extract(m, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag,
        regexp_extract(m, '^<[a-zA-Z][a-zA-Z0-9-]*([^>]*)>', 1) AS attrs, regexp_extract(m, '>([^<]*)$', 1) AS text FROM tag_raw) e
    JOIN page p USING (page_id)""",
)


def elements(spark, sf, tags=None):
    """Flat element rows of the canonical corpus pages."""
    rows = html_flat.element_stream(table(spark, sf, "pages"), tags)
    return rows.join(pages(spark, sf), "page_id")


@query("c1_flat_elements", "SELECT url, tag, count(*) AS n, sum(length(text))::BIGINT AS chars FROM el GROUP BY url, tag")
def _(spark, sf):
    return elements(spark, sf).groupBy("url", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "c2_landmarks",
    "SELECT url, string_agg(tag, '>' ORDER BY ordinal) AS landmarks FROM el WHERE tag IN ('header', 'nav', 'main', 'aside', 'footer', 'form') GROUP BY url",
)
def _(spark, sf):
    return ST.landmarks(elements(spark, sf)).select("url", F.array_join("landmarks", ">").alias("landmarks"))


@query(
    "c4_shape_counts",
    """SELECT url, count(*) FILTER (tag = 'form') AS forms, count(*) FILTER (tag = 'table') AS tables,
      count(*) FILTER (tag IN ('h1', 'h2', 'h3')) AS headings, count(*) FILTER (tag = 'img') AS images,
      count(*) FILTER (tag IN ('ul', 'ol')) AS lists, count(*) FILTER (tag = 'article') AS articles, bool_or(tag = 'aside') AS has_sidebar
    FROM el GROUP BY url""",
)
def _(spark, sf):
    return ST.shape_counts(elements(spark, sf))


@query(
    "c5_class_inventory",
    """SELECT DISTINCT url, token FROM (SELECT url, unnest(string_split(regexp_extract(attrs, 'class="([^"]*)"', 1), ' ')) AS token FROM el) WHERE token <> ''""",
)
def _(spark, sf):
    return ST.class_inventory(elements(spark, sf))


# ---------------------------------------------------------------- static checks on the corpus
block("link0", """SELECT url, ordinal, text, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(attrs, 'href="([^"]*)"', 1) AS href FROM el WHERE tag = 'a' AND attrs LIKE '%href=%'""")
block(
    "head0",
    """SELECT url, ordinal, tag, text, substr(tag, 2)::INTEGER AS level,
      lag(substr(tag, 2)::INTEGER) OVER w AS from_level, lag(text) OVER w AS from_text
    FROM el WHERE regexp_matches(tag, '^h[1-6]$') WINDOW w AS (PARTITION BY url ORDER BY ordinal)""",
)
block("title0", "SELECT url, coalesce(arg_min(text, ordinal) FILTER (tag = 'title'), '') AS title FROM el GROUP BY url")
block(
    "obs0",
    r"""SELECT p.url, 'heading-no-h1' AS check_id, 'body' AS selector, 0 AS ordinal, 'document' AS sig, 'Nella pagina manca un titolo h1.' AS observation
      FROM page p WHERE NOT EXISTS (SELECT 1 FROM head0 h WHERE h.url = p.url AND level = 1)
    UNION ALL SELECT url, 'heading-multiple-h1', 'h1', list_sort(list(ordinal))[2], 'unknown',
      'Titoli h1 nella pagina: ' || count(*) || ' ("' || string_agg(text, '", "' ORDER BY ordinal) || '").'
      FROM head0 WHERE level = 1 GROUP BY url HAVING count(*) > 1
    UNION ALL SELECT url, 'heading-skipped-level', tag, ordinal, 'unknown',
      'Da h' || from_level || ' ("' || from_text || '") si passa a h' || level || ' ("' || text || '").'
      FROM head0 WHERE level - from_level > 1
    UNION ALL SELECT url, 'heading-empty', tag, ordinal, 'unknown', 'Titolo ' || tag || ' vuoto.'
      FROM head0 WHERE text = ''
    UNION ALL SELECT url, 'landmark-no-main', 'body', 0, 'document', 'La pagina non delimita il contenuto principale.'
      FROM page p WHERE NOT EXISTS (SELECT 1 FROM el e WHERE e.url = p.url AND e.tag = 'main')
    UNION ALL SELECT url, 'title-missing', 'head > title', 0, 'document', 'Manca il titolo della pagina.' FROM title0 WHERE title = ''
    UNION ALL SELECT url, 'title-too-short', 'head > title', 0, 'document', 'Titolo troppo breve: "' || title || '".'
      FROM title0 WHERE title <> '' AND length(title) < 6
    UNION ALL SELECT url, 'skiplink-missing', 'body', 0, 'document', 'Nessun collegamento interno salta al contenuto.' FROM page
    UNION ALL SELECT url, 'link-generic-text', 'a', ordinal, 'unknown', 'Testo vago: "' || text || '".' FROM link0
      WHERE regexp_matches(text, '(?i)^(leggi (tutto|di piu.?|l.articolo)|continua|clicca (qui|qua)|qui|qua|questo link|link|scopri( di piu.?)?|vai|dettagli|approfondisci|read more|more|click here|here|download|scarica)[\s.!:]*$')
    UNION ALL SELECT url, 'link-same-text-different-targets', 'a', 0, 'document',
      'Il testo "' || lower(text) || '" porta a ' || count(DISTINCT href) || ' mete diverse.'
      FROM link0 WHERE text <> '' AND length(text) < 60 GROUP BY url, lower(text) HAVING count(DISTINCT href) > 1""",
)


def corpus_tree(spark, sf):
    """Tree element rows of the canonical corpus pages, parsed once and stored."""
    rows = html_tree.element_tree(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("url"), "html"), detail=S.CHECK_TAGS)
    own = pages(spark, sf).select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("page_url"))
    return cut(rows.join(own, rows["url"] == own["page_id"]).drop("url", "page_id").withColumnRenamed("page_url", "url"))


FAMILIES = {
    "headings": (lambda p, e: S.heading_checks(p, e)),
    "landmarks": (lambda p, e: S.landmark_checks(p, e)),
    "titles": (lambda p, e: S.title_checks(p, e)),
    "skip": (lambda p, e: S.skip_link_check(p, e)),
    "links": (lambda p, e: S.link_checks(e)),
}


def _static(family, check):
    fn = FAMILIES[family]

    def run(spark, sf):
        obs = fn(pages(spark, sf), corpus_tree(spark, sf)).filter(F.col("check_id") == check)
        return obs.select("url", "check_id", F.array_join("criteria", " ").alias("criteria"), "engine_impact", "observation")

    return run


for qid, family, check in [
    ("f1", "headings", "heading-no-h1"),
    ("f2", "headings", "heading-multiple-h1"),
    ("f3", "headings", "heading-skipped-level"),
    ("f4", "headings", "heading-empty"),
    ("f5", "landmarks", "landmark-no-main"),
    ("f8", "titles", "title-missing"),
    ("f9", "titles", "title-too-short"),
    ("f10", "skip", "skiplink-missing"),
    ("f17", "links", "link-generic-text"),
    ("f20", "links", "link-same-text-different-targets"),
]:
    query(
        f"{qid}_{check.replace('-', '_')}",
        f"""SELECT url, check_id, m.criteria, m.impact AS engine_impact, observation
        FROM obs0 JOIN dim_meta m USING (check_id) WHERE check_id = '{check}'""",
    )(_static(family, check))

# ---------------------------------------------------------------- findings
def finding_blocks(p: str, ev: str, tpl: str, sites: str) -> None:
    """SQL counterpart of the analysis over one evidence block."""
    single = ", ".join(f"'{c}'" for c in I.SINGLE_CAUSE)
    block(
        f"{p}_keyed",
        f"""SELECT *, CASE WHEN check_id IN ({single}) THEN check_id
          WHEN check_id IN ('axe:color-contrast', 'contrast-hover-insufficient') AND fg || bg <> '' THEN check_id || '::' || fg || '|' || bg
          ELSE check_id || '::' || CASE WHEN component_signature = '' THEN 'unknown' ELSE component_signature END END AS key
        FROM (SELECT *, coalesce(json_extract_string(data, '$.checks[0].data.fgColor'), json_extract_string(data, '$.restColor'), '') AS fg,
          coalesce(json_extract_string(data, '$.checks[0].data.bgColor'), '') AS bg,
          row_number() OVER (ORDER BY page_url, check_id, ordinal, id) AS seq FROM {ev})""",
    )
    block(
        f"{p}_group",
        f"""SELECT key, left(sha1(key), 12) AS finding_id, arg_min(check_id, seq) AS check_id, arg_min(component_signature, seq) AS first_sig,
          arg_min(coalesce(json_extract_string(data, '$.axeRule'), ''), seq) AS rule, arg_min(coalesce(json_extract_string(data, '$.axeDescription'), ''), seq) AS rule_text,
          arg_min(coalesce(json_extract_string(data, '$.helpUrl'), ''), seq) AS help_url, arg_min(observation, seq) AS observation,
          count(DISTINCT page_url) AS page_count, count(DISTINCT nullif(component_signature, '')) AS component_count,
          arg_min(component_signature, seq) FILTER (component_signature <> '') AS first_component, count(*) AS evidence_count,
          max(CASE engine_impact WHEN 'critical' THEN 5.0::DOUBLE WHEN 'serious' THEN 3.5 WHEN 'minor' THEN 1 ELSE 2 END) AS user_impact
        FROM {p}_keyed GROUP BY key""",
    )
    block(f"{p}_crit", f"SELECT DISTINCT left(sha1(key), 12) AS finding_id, unnest(criteria) AS criterion FROM {p}_keyed")
    block(
        f"{p}_critagg",
        f"""SELECT finding_id, list(criterion ORDER BY criterion) AS criteria, bool_or(coalesce(automation = 'deterministic', false)) AS can_fail,
          coalesce(max(CASE WHEN NOT baseline THEN 1 WHEN level = 'A' THEN 5 ELSE 4 END) FILTER (level IS NOT NULL), 2) AS legal
        FROM {p}_crit LEFT JOIN dim_criteria USING (criterion) GROUP BY finding_id""",
    )
    block(
        f"{p}_occ",
        f"""SELECT finding_id, sum(coalesce(page_count, 1)) AS occ FROM (SELECT DISTINCT left(sha1(key), 12) AS finding_id, fingerprint FROM {p}_keyed WHERE fingerprint <> '')
        LEFT JOIN {tpl} USING (fingerprint) GROUP BY finding_id""",
    )
    block(f"{p}_prim", f"SELECT DISTINCT left(sha1(key), 12) AS finding_id FROM {p}_keyed JOIN {sites} USING (site_id) WHERE tier = 'primary'")
    block(
        f"{p}_scored",
        f"""SELECT g.*, coalesce(c.criteria, []) AS criteria, coalesce(c.can_fail, false) AS can_fail, coalesce(c.legal, 2) AS legal, coalesce(nullif(o.occ, 0), g.page_count)::BIGINT AS occurrence_count, t.*,
          CASE WHEN base < 0.95 AND g.page_count >= 3 THEN least(0.95::DOUBLE, base + 0.05::DOUBLE) ELSE base END AS trust,
          x.finding_id IS NOT NULL AS prim
        FROM (SELECT gg.*, CASE WHEN check_id LIKE 'axe-incomplete:%' THEN 0.35::DOUBLE WHEN check_id LIKE 'axe%' THEN
            CASE WHEN rule IN ('color-contrast', 'color-contrast-enhanced', 'region', 'scrollable-region-focusable') THEN 0.8::DOUBLE ELSE 0.95 END
            ELSE coalesce(tt.cat_confidence, 0.5)::DOUBLE END AS base
          FROM {p}_group gg LEFT JOIN dim_text tt ON tt.text_key = gg.check_id) g
        LEFT JOIN {p}_critagg c USING (finding_id) LEFT JOIN {p}_occ o USING (finding_id) LEFT JOIN {p}_prim x USING (finding_id)
        LEFT JOIN dim_text t ON t.text_key = regexp_replace(g.check_id, '^axe(-incomplete)?:', 'axe:')""",
    )
    block(
        f"{p}_reach",
        f"""SELECT *, CASE WHEN prim THEN least(5::DOUBLE, r + 0.5::DOUBLE) ELSE r END AS reach FROM (
          SELECT s.*, CASE WHEN cov >= 0.8 THEN 5::DOUBLE WHEN cov >= 0.4 THEN 4 WHEN cov >= 0.15 THEN 3 WHEN cov >= 0.05 THEN 2 ELSE 1 END AS r
          FROM (SELECT *, occurrence_count::DOUBLE / (SELECT coalesce(nullif((SELECT sum(page_count) FROM {tpl}), 0), (SELECT count(*) FROM {ev})))::DOUBLE AS cov FROM {p}_scored) s)""",
    )
    block(
        f"{p}_finding",
        f"""SELECT *, CASE WHEN score >= 85 THEN 'critica' WHEN score >= 68 THEN 'alta' WHEN score >= 45 THEN 'media' ELSE 'bassa' END AS band,
          CASE WHEN check_id LIKE 'axe-incomplete:%' OR NOT can_fail OR trust < 0.75 THEN 'needs-review' ELSE 'fail' END AS verdict,
          floor(trust * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence,
          (CASE WHEN cat_title IS NOT NULL THEN cat_title || CASE WHEN check_id LIKE 'axe-incomplete:%' THEN ' (da verificare)' ELSE '' END
            WHEN trim(rule_text) <> '' THEN regexp_replace(trim(rule_text), '[.]$', '')
            ELSE replace(regexp_replace(check_id, '^axe(-incomplete)?:', ''), '-', ' ') END)
            || CASE WHEN first_sig LIKE 'terze-parti:%' THEN ' — ' || substr(first_sig, 13) ELSE '' END AS title,
          CASE WHEN component_count > 1 THEN first_component || ' e altri ' || (component_count - 1) || ' componenti'
            WHEN component_count = 1 THEN first_component ELSE 'documento' END AS component,
          CASE WHEN first_sig LIKE 'terze-parti:%' THEN 'fornitore-terzo' WHEN cat_owner IS NOT NULL THEN cat_owner
            WHEN regexp_matches(check_id, 'alt|text|label|link|title') AND len(list_filter(criteria, lambda c: c LIKE '1.1%' OR c = '2.4.4')) > 0 THEN 'contenuti'
            WHEN regexp_matches(check_id, 'contrast|color') THEN 'design' ELSE 'frontend' END AS owner,
          coalesce(cat_effort, 'medio') AS effort,
          coalesce(cat_description, nullif(trim(rule_text), ''), observation) AS description,
          coalesce(cat_remediation, observation || CASE WHEN help_url <> '' THEN chr(10) || chr(10) || 'Riferimento tecnico: ' || help_url ELSE '' END) AS remediation,
          cat_code AS code_example
        FROM (SELECT *, floor(((user_impact / 5.0::DOUBLE) * 55.0::DOUBLE + (reach / 5.0::DOUBLE) * 25.0::DOUBLE + (legal / 5.0::DOUBLE) * 20.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS score
          FROM {p}_reach)""",
    )


FINDING_SQL = """SELECT finding_id, title, array_to_string(criteria, ' ') AS criteria, verdict, confidence, user_impact, reach, legal::INTEGER AS legal_exposure,
  score, band, component, occurrence_count, page_count, evidence_count, description, remediation, code_example, owner, effort FROM {p}_finding"""
FINDING_COLUMNS = [
    "finding_id", "title", F.array_join, "verdict", "confidence", "user_impact", "reach", "legal_exposure", "score", "band", "component",
    "occurrence_count", "page_count", "evidence_count", "description", "remediation", "code_example", "owner", "effort",
]


def flat_findings(findings):
    return findings.select(*[F.array_join("criteria", " ").alias("criteria") if c is F.array_join else c for c in FINDING_COLUMNS])


# ---------------------------------------------------------------- a large evidence log derived from line items
shared(
    "evidence_raw",
    """SELECT left(md5(CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '/' || CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) || l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INT) AS STRING)), 16) AS id,
      CASE h WHEN 0 THEN 'axe:color-contrast' WHEN 1 THEN 'axe-incomplete:color-contrast' WHEN 2 THEN 'focus-not-visible' WHEN 3 THEN 'heading-skipped-level'
        WHEN 4 THEN 'link-generic-text' WHEN 5 THEN 'img-alt-is-filename' WHEN 6 THEN 'axe:html-has-lang' WHEN 7 THEN 'axe:region' WHEN 8 THEN 'contrast-hover-insufficient'
        WHEN 9 THEN 'form-missing-autocomplete' WHEN 10 THEN 'axe:strange-rule' WHEN 11 THEN 'reflow-overflowing-element' WHEN 12 THEN 'keyboard-trap-suspected'
        WHEN 13 THEN 'axe:button-name' WHEN 14 THEN 'custom-label-check' ELSE 'axe:plain-rule' END AS check_id,
      CASE h WHEN 0 THEN '1.4.3' WHEN 1 THEN '1.4.3' WHEN 2 THEN '2.4.7' WHEN 3 THEN '1.3.1' WHEN 4 THEN '2.4.4' WHEN 5 THEN '1.1.1' WHEN 6 THEN '3.1.1'
        WHEN 7 THEN '1.3.1' WHEN 8 THEN '1.4.3' WHEN 9 THEN CASE WHEN l_suppkey % 2 = 0 THEN '1.3.5' ELSE '1.3.5 4.1.2' END WHEN 10 THEN '2.5.8 9.9.9' WHEN 11 THEN '1.4.10' WHEN 12 THEN '2.1.2'
        WHEN 13 THEN '4.1.2' WHEN 14 THEN '1.1.1' ELSE '' END AS criteria_text,
      'https://s' || CAST(l_suppkey % 7 AS STRING) || '.example/' || CASE l_orderkey % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'corsi' WHEN 2 THEN 'servizi' ELSE 'blog' END
        || '/' || CAST(l_orderkey % 500 AS STRING) AS page_url,
      's' || CAST(l_suppkey % 7 AS STRING) AS site_id,
      CASE WHEN l_orderkey % 41 = 40 THEN '' WHEN l_orderkey % 41 > 30 THEN 'mixed-' ELSE 'tpl-' END || CASE WHEN l_orderkey % 41 = 40 THEN '' ELSE CAST(l_orderkey % 41 AS STRING) END AS fingerprint,
      CASE WHEN l_linenumber = 2 THEN 'body' ELSE 'a:nth-of-type(' || CAST(l_linenumber AS STRING) || ')' END AS selector,
      CASE WHEN h = 13 AND l_suppkey % 3 = 0 THEN 'terze-parti:Google Maps' WHEN l_partkey % 29 = 0 THEN ''
        WHEN l_partkey % 5 = 0 THEN 'banner-consenso > header.site-head > div > a.link-' || CAST(l_partkey % 3 AS STRING)
        WHEN l_partkey % 7 = 0 THEN 'main.page-main > div.aBcDe' || CAST(l_suppkey % 4 AS STRING) || ' > a'
        WHEN l_partkey % 11 = 0 THEN 'main.page-main > section > div#blk-' || CAST(l_orderkey % 200 AS STRING) || ' > span'
        ELSE 'main.page-main > div.card-box > a.crhcdd' END AS component_signature,
      'Osservazione ' || CAST(l_linenumber AS STRING) || ' su ' || CAST(l_partkey % 9 AS STRING) AS observation,
      CASE WHEN h IN (0, 1) THEN '{"axeRule":"color-contrast","checks":[{"data":{' || CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE '"fgColor":"#0000' || CAST(l_suppkey % 5 AS STRING) || '0","bgColor":"#ffffff"' END || '}}]}'
        WHEN h = 6 THEN '{"axeRule":"html-has-lang"}' WHEN h = 7 THEN '{"axeRule":"region"}' WHEN h = 13 THEN '{"axeRule":"button-name"}'
        WHEN h = 8 THEN '{"restColor":"rgb(0, 0, ' || CAST(l_suppkey % 3 AS STRING) || ')"}'
        WHEN h = 10 THEN '{"axeRule":"strange-rule","axeDescription":"Ensure it is fine.","helpUrl":"https://rules.example/strange"}'
        WHEN h = 15 THEN '{"axeRule":"plain-rule","axeDescription":" "}' ELSE '{}' END AS data,
      CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' AND h % 2 = 0 THEN 'serious' WHEN h % 5 = 0 THEN CAST(NULL AS STRING) WHEN h % 3 = 0 THEN 'minor' ELSE 'moderate' END AS engine_impact,
      CAST(l_linenumber AS INT) AS ordinal, CASE WHEN l_linenumber = 3 THEN 'shots/' || CAST(l_partkey AS STRING) || '.png' END AS screenshot
    FROM (SELECT *, (l_partkey * 7 + l_linenumber) % 16 AS h FROM {lineitem})""",
)
shared(
    "template_raw",
    """SELECT CASE WHEN o_orderkey % 37 > 30 THEN 'mixed-' ELSE 'tpl-' END || CAST(o_orderkey % 37 AS STRING) AS fingerprint, 's' || CAST(o_custkey % 7 AS STRING) AS site_id,
      'https://s' || CAST(o_custkey % 7 AS STRING) || '.example/' || CASE WHEN o_orderkey % 37 = 33 THEN 'corsi' WHEN o_orderkey % 4 = 0 THEN 'news' WHEN o_orderkey % 4 = 1 THEN 'corsi' ELSE 'blog' END || '/' || CAST(o_orderkey AS STRING) AS url
    FROM {orders}""",
)
shared(
    "site_raw",
    """SELECT DISTINCT 's' || CAST(s_suppkey % 7 AS STRING) AS site_id, 'Sito ' || CAST(s_suppkey % 7 AS STRING) AS label,
      CASE WHEN s_suppkey % 7 IN (1, 4) THEN 'primary' ELSE 'secondary' END AS tier FROM {supplier}""",
)
block("ev1", "SELECT * EXCLUDE (criteria_text), list_filter(string_split(criteria_text, ' '), lambda c: c <> '') AS criteria FROM evidence_raw")
block("tpl1", "SELECT fingerprint, count(*) AS page_count FROM template_raw GROUP BY fingerprint")
block("site1", "SELECT * FROM site_raw")
finding_blocks("l", "ev1", "tpl1", "site1")


def log_audit(spark, sf):
    """Evidence, templates and sites of the derived log."""
    raw = cut(derived(spark, sf, "evidence_raw"))
    ev = raw.withColumn("criteria", F.filter(F.split("criteria_text", " "), lambda c: c != "")).drop("criteria_text")
    templates = derived(spark, sf, "template_raw").groupBy("fingerprint").agg(F.count("*").alias("page_count"))
    return ev, templates, derived(spark, sf, "site_raw")


def log_findings(spark, sf, stored=False, inputs=None):
    """Analysis of the derived log, or of ``inputs`` made from it before; ``stored`` materialises the findings for plans that read them more than once."""
    found = I.analyse(*(inputs or log_audit(spark, sf)))
    return found._replace(findings=cut(found.findings)) if stored else found


@query("h1_evidence_ids", "SELECT left(sha1(concat_ws('|', site_id, page_url, check_id, selector, observation)), 16) AS id, check_id, page_url, site_id, fingerprint FROM ev1")
def _(spark, sf):
    made = H.evidence_id(F.col("site_id"), F.col("page_url"), F.col("check_id"), F.col("selector"), F.col("observation"))
    return log_audit(spark, sf)[0].select(made.alias("id"), "check_id", "page_url", "site_id", "fingerprint")


@query("i1_dedupe_keys", "SELECT key, count(*) AS n FROM l_keyed GROUP BY key")
def _(spark, sf):
    ev = log_audit(spark, sf)[0]
    return ev.select(I.dedupe_key().alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(
    "i2_evidence_groups",
    """SELECT finding_id, array_to_string(coalesce(criteria, []), ' ') AS criteria, page_count, component_count, evidence_count, user_impact
    FROM l_group LEFT JOIN l_critagg USING (finding_id)""",
)
def _(spark, sf):
    g = I.group_evidence(log_audit(spark, sf)[0])
    return g.select("finding_id", F.array_join("criteria", " ").alias("criteria"), "page_count", "component_count", "evidence_count", "user_impact")


@query("i3_extrapolated_occurrences", "SELECT finding_id, occ::BIGINT AS occurrences FROM l_occ")
def _(spark, sf):
    ev, templates, _sites = log_audit(spark, sf)
    return I.extrapolated_occurrences(I.bridge(ev, "fingerprint"), templates)


@query("i4_total_pages", "SELECT sum(page_count)::BIGINT AS total FROM tpl1")
def _(spark, sf):
    ev, templates, _sites = log_audit(spark, sf)
    return I.total_pages(ev, templates)


@query("i5_confidence", "SELECT finding_id, confidence FROM l_finding")
def _(spark, sf):
    return log_findings(spark, sf).findings.select("finding_id", "confidence")


@query("i6_i8_criteria_facts", "SELECT finding_id, can_fail, legal::INTEGER AS legal_exposure FROM l_scored")
def _(spark, sf):
    g = I.group_evidence(log_audit(spark, sf)[0])
    return I.criteria_facts(g, dims.criteria(spark)).select("finding_id", "can_fail", "legal_exposure")


@query("i7_verdicts", "SELECT verdict, count(*) AS n FROM l_finding GROUP BY verdict")
def _(spark, sf):
    return log_findings(spark, sf).findings.groupBy("verdict").agg(F.count("*").alias("n"))


@query("i9_severity", "SELECT finding_id, user_impact, reach, legal::INTEGER AS legal_exposure, score, band FROM l_finding")
def _(spark, sf):
    return log_findings(spark, sf).findings.select("finding_id", "user_impact", "reach", "legal_exposure", "score", "band")


@query("i10_titles", "SELECT finding_id, title, description, remediation FROM l_finding")
def _(spark, sf):
    return log_findings(spark, sf).findings.select("finding_id", "title", "description", "remediation")


@query("i11_owner_effort", "SELECT finding_id, owner, effort FROM l_finding")
def _(spark, sf):
    return log_findings(spark, sf).findings.select("finding_id", "owner", "effort")


block("l_cite", "SELECT left(sha1(key), 12) AS finding_id, rank::INTEGER AS rank, id AS evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rank FROM l_keyed)")


@query("i12_citations", "SELECT finding_id, rank, evidence_id FROM l_cite")
def _(spark, sf):
    return I.cite(log_audit(spark, sf)[0]).select("finding_id", "rank", "evidence_id")


@query("i13_finding_ids", "SELECT DISTINCT key, left(sha1(key), 12) AS finding_id FROM l_keyed")
def _(spark, sf):
    key = I.dedupe_key()
    return log_audit(spark, sf)[0].select(key.alias("key")).dropDuplicates().select("key", I.finding_id(F.col("key")).alias("finding_id"))


block("l_ranked", "SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'fail' THEN 0 ELSE 1 END, score DESC, finding_id) AS priority FROM l_finding")


@query("i14_ranking", "SELECT priority, finding_id, verdict, score FROM l_ranked")
def _(spark, sf):
    return I.with_priority(log_findings(spark, sf, stored=True).findings).select("priority", "finding_id", "verdict", "score")


@query(
    "i15_summary",
    """SELECT 'band' AS facet, band AS value, count(*) AS findings, NULL::BIGINT AS evidence, NULL::DOUBLE AS dedupe_ratio FROM l_finding GROUP BY band
    UNION ALL SELECT 'verdict', verdict, count(*), NULL, NULL FROM l_finding GROUP BY verdict
    UNION ALL SELECT 'all', '', count(*), (SELECT count(*) FROM ev1), floor((SELECT count(*) FROM ev1)::DOUBLE / count(*) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE FROM l_finding""",
)
def _(spark, sf):
    ev, templates, sites = log_audit(spark, sf)
    return I.summary(ev, I.analyse(ev, templates, sites).findings)


@query("i16_component_display", "SELECT finding_id, component, component_count FROM l_finding")
def _(spark, sf):
    return log_findings(spark, sf).findings.select("finding_id", "component", "component_count")


@query("log_ranked_findings", FINDING_SQL.format(p="l"))
def _(spark, sf):
    return flat_findings(I.ranked(log_findings(spark, sf).findings))


@query(
    "h2_evidence_sources",
    """SELECT source, count(*) AS n FROM (SELECT CASE WHEN check_id LIKE 'axe%' THEN 'axe-core' WHEN check_id LIKE 'keyboard%' OR check_id LIKE 'focus%' THEN 'keyboard-walk'
      WHEN check_id LIKE 'img%' THEN 'media' WHEN check_id LIKE 'link-%' THEN 'links' WHEN check_id LIKE 'form-%' THEN 'forms'
      WHEN check_id LIKE 'contrast-%' THEN 'contrast-states' WHEN check_id LIKE 'reflow%' THEN 'reflow' ELSE 'structure' END AS source FROM ev1) GROUP BY source""",
)
def _(spark, sf):
    ev = log_audit(spark, sf)[0]
    return ev.groupBy(H.evidence_source(F.col("check_id")).alias("source")).agg(F.count("*").alias("n"))
