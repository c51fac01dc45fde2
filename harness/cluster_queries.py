"""Tokens, fingerprints, templates, samples and language families (inventory D1-D8, E1-E17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import identity as FI
from auditlake.functions import urls as U
from auditlake.operators import clusters as E
from auditlake.operators import discovery as D
from auditlake.operators import identity as ID
from auditlake.operators import reports as R
from auditlake.operators import structure as ST

from .audit_queries import elements
from .core import block, derived, query, shared, table
from .urls_queries import pages

# ---------------------------------------------------------------- tokens
shared(
    "token_log",
    """SELECT DISTINCT url, token FROM (
      SELECT 'p' || CAST(p_size AS STRING) AS url, lower(p_type) AS token FROM {part}
      UNION ALL SELECT 'p' || CAST(p_size AS STRING), replace(p_name, ' ', '-') FROM {part}
      UNION ALL SELECT 'p' || CAST(p_size AS STRING), 'sc-' || left(md5(p_name), 6) FROM {part}
      UNION ALL SELECT 'p' || CAST(p_size AS STRING), 'x' || left(md5(CAST(p_partkey AS STRING)), 5) FROM {part}
      UNION ALL SELECT 'p' || CAST(p_size AS STRING), 'blk-' || CAST(p_partkey % 400 AS STRING) FROM {part}
      UNION ALL SELECT 'p' || CAST(p_size AS STRING), CASE p_partkey % 9 WHEN 0 THEN 'isOpen' WHEN 1 THEN 'crhcdd' WHEN 2 THEN 'false' WHEN 3 THEN 'nav_item' WHEN 4 THEN 'is-active'
        WHEN 5 THEN 'opensans' WHEN 6 THEN 'wrapper' WHEN 7 THEN ':r' || CAST(p_partkey % 5 AS STRING) || ':' ELSE 'rare-' || CAST(p_partkey AS STRING) END FROM {part}
      UNION ALL SELECT 'p' || CAST(p_size AS STRING), CASE WHEN p_size < 12 THEN 'Sezione' ELSE 'sezione' END FROM {part})""",
)
JUNK = "lower(token) IN ('false', 'true', 'undefined', 'null', 'nan', 'none', 'object')"
SYNTACTIC = rf"""(length(token) BETWEEN 1 AND 40 AND NOT {JUNK}
  AND NOT regexp_matches(token, '(?i)(^|-)(\d{{2,}}|[0-9a-f]{{8,}}|active|open|current|selected|hover|focus|visible|hidden|loaded|js-)')
  AND NOT regexp_matches(token, '(?i)^(sc-[a-z0-9]{{4,}}|css-[a-z0-9]{{4,}}|emotion-|jsx-\d+|svelte-[a-z0-9]{{5,}}|v-[0-9a-f]{{6,}})'))"""
HASHED = rf"({JUNK} OR regexp_matches(substr(token, 2), '[A-Z]') OR NOT regexp_matches(token, '(?i)[aeiouy]'))"
block("registry", "SELECT token, count(DISTINCT url) AS pages FROM token_log GROUP BY token")
block("token_pages", "SELECT count(DISTINCT url) AS n FROM token_log")
block(
    "stable_token",
    rf"""SELECT token, pages FROM registry, token_pages WHERE {SYNTACTIC} AND CASE WHEN n < 3 THEN true
      WHEN NOT regexp_matches(token, '[-_]') THEN NOT {HASHED} AND pages::DOUBLE / n >= 0.4 ELSE pages >= 2 END""",
)


def registry(spark, sf):
    return ID.token_registry(derived(spark, sf, "token_log"))


def token_pages(spark, sf):
    return derived(spark, sf, "token_log").agg(F.countDistinct("url")).scalar()


@query("d1_token_registry", "SELECT token, pages FROM registry")
def _(spark, sf):
    return registry(spark, sf)


@query("d2_syntactic_stability", f"SELECT token, {SYNTACTIC} AS stable FROM registry")
def _(spark, sf):
    return registry(spark, sf).select("token", FI.syntactically_stable(F.col("token")).alias("stable"))


@query("d3_hashed_words", f"SELECT token, {HASHED} AS hashed FROM registry")
def _(spark, sf):
    return registry(spark, sf).select("token", FI.looks_hashed(F.col("token")).alias("hashed"))


@query("d4_stable_classes", "SELECT token, pages FROM stable_token")
def _(spark, sf):
    return ID.stable_classes(registry(spark, sf), token_pages(spark, sf))


@query("d5_stable_ids", f"SELECT token, pages FROM registry, token_pages WHERE length(token) <= 60 AND NOT {JUNK} AND pages::DOUBLE / n >= 0.3")
def _(spark, sf):
    return ID.stable_ids(registry(spark, sf), token_pages(spark, sf))


@query(
    "d6_j9_generated_ratio",
    """SELECT tokens, unstable, floor(unstable::DOUBLE / tokens * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS ratio, floor(unstable::DOUBLE / tokens * 100 + 0.5::DOUBLE) / 100.0::DOUBLE > 0.5 AS hostile
    FROM (SELECT count(*) AS tokens, count(*) - (SELECT count(*) FROM stable_token) AS unstable FROM registry)""",
)
def _(spark, sf):
    return ID.generated_ratio(registry(spark, sf), ID.stable_classes(registry(spark, sf), token_pages(spark, sf)))


# ---------------------------------------------------------------- fingerprints of the crawl corpus (flat skeleton)
block(
    "el_cls",
    """SELECT url, ordinal, tag, list_filter(string_split(regexp_extract(attrs, 'class="([^"]*)"', 1), ' '), lambda c: c <> '') AS classes FROM el""",
)
block("cls_registry", "SELECT token, count(DISTINCT url) AS pages FROM (SELECT url, unnest(classes) AS token FROM el_cls) GROUP BY token")
block(
    "cls_stable",
    rf"""SELECT token FROM cls_registry WHERE {SYNTACTIC} AND CASE WHEN NOT regexp_matches(token, '[-_]') THEN NOT {HASHED} AND pages::DOUBLE / (SELECT count(*) FROM page) >= 0.4 ELSE pages >= 2 END""",
)
block(
    "skel0",
    """SELECT url, string_agg(tag || CASE WHEN cls <> '' THEN '#' || cls ELSE '' END, '|' ORDER BY ordinal) AS skeleton FROM (
      SELECT e.url, ordinal, tag, coalesce((SELECT min(c) FROM (SELECT unnest(e.classes) AS c) JOIN cls_stable s ON s.token = c), '') AS cls
      FROM el_cls e JOIN (SELECT url, min(ordinal) AS b FROM el_cls WHERE tag = 'body' GROUP BY url) x ON x.url = e.url AND e.ordinal > x.b
      WHERE tag NOT IN ('script', 'style', 'noscript', 'svg', 'path', 'br', 'template')) GROUP BY url""",
)
block(
    "print0",
    """SELECT url, left(sha1(concat_ws('||', '', coalesce(lm, ''), 'f0,t0,l' || CASE WHEN lists = 0 THEN '0' WHEN lists <= 3 THEN 'pochi' ELSE 'molti' END || ',nosb', coalesce(skeleton, ''))), 12) AS fingerprint,
      CASE WHEN articles >= 3 OR lists >= 4 THEN 'Elenco' ELSE 'Pagina di contenuto' END AS inferred_label
    FROM (SELECT url, string_agg(tag, '>' ORDER BY ordinal) FILTER (tag IN ('header', 'nav', 'main', 'aside', 'footer', 'form')) AS lm,
        count(*) FILTER (tag IN ('ul', 'ol')) AS lists, count(*) FILTER (tag = 'article') AS articles FROM el GROUP BY url) LEFT JOIN skel0 USING (url)""",
)


def fingerprints(spark, sf):
    el = elements(spark, sf)
    total = pages(spark, sf).agg(F.count("*")).scalar()
    stable = ID.stable_classes(ID.token_registry(ST.class_inventory(el)), total)
    return ID.page_fingerprints(ST.page_material(el, flat=True), stable)


@query("d7_d8_page_fingerprints", "SELECT url, fingerprint, inferred_label FROM print0")
def _(spark, sf):
    return fingerprints(spark, sf).select("url", "fingerprint", "inferred_label")


block("grouped0", "SELECT p.url, p.site_id, pp.pattern, p.site_id || '::' || pp.pattern AS group_key, len(string_split(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) AS d FROM page p JOIN page_pattern pp USING (url)")
block("probe0", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY d, length(url), url) AS rn FROM grouped0) WHERE rn <= 2")


def grouped(spark, sf):
    from .urls_queries import url_pool

    return D.pattern_groups(pages(spark, sf), D.url_patterns(url_pool(spark, sf)))


@query("e1_e2_probes", "SELECT group_key, url FROM probe0")
def _(spark, sf):
    return E.probes(grouped(spark, sf)).select("group_key", "url")


@query("e2_usable_probes", "SELECT k, url FROM probe_log WHERE k % 11 <> 3 AND k % 13 NOT IN (2, 5)")
def _(spark, sf):
    return E.usable_probes(derived(spark, sf, "probe_log")).select("k", "url")


block(
    "assigned0",
    """SELECT g.url, g.site_id, CASE WHEN kinds = 1 THEN only_print WHEN kinds > 1 THEN coalesce(own, 'mixed-' || sha1(g.pattern)) ELSE 'unknown' END AS fingerprint
    FROM grouped0 g LEFT JOIN (SELECT group_key, count(DISTINCT fingerprint) AS kinds, min(fingerprint) AS only_print FROM probe0 JOIN print0 USING (url) WHERE url LIKE 'https:%' GROUP BY group_key) USING (group_key)
    LEFT JOIN (SELECT url, fingerprint AS own FROM probe0 JOIN print0 USING (url) WHERE url LIKE 'https:%') USING (url)""",
)


@query("e3_e4_assigned_fingerprints", "SELECT url, fingerprint FROM assigned0")
def _(spark, sf):
    from auditlake.lineage import cut

    g = cut(grouped(spark, sf))
    # plain-http probes count as failed, so some groups stay unknown
    prints = E.probes(g).filter(F.col("url").startswith("https:")).join(fingerprints(spark, sf), "url").select("url", "group_key", "fingerprint")
    return E.assign_fingerprints(g, prints).select("url", "fingerprint")


# ---------------------------------------------------------------- templates and samples over a derived multilingual site
shared(
    "lang_page",
    """SELECT 'w' || CAST(o_custkey % 2 AS STRING) AS site_id, 'https://w' || CAST(o_custkey % 2 AS STRING) || '.example/' || CASE WHEN o_orderkey % 12 > 8 THEN '' WHEN o_orderkey % 13 = 0 THEN 'ES/' ELSE lang END
        || 'sec-' || CAST(o_orderkey % 12 AS STRING) || '/' || CASE WHEN o_orderkey % 12 = 5 AND o_orderkey % 3 = 0 THEN 'deep/' ELSE '' END || 'x' || CAST(o_orderkey AS STRING) AS url,
      CASE WHEN o_orderkey % 12 = 11 THEN 'unknown' WHEN o_orderkey % 12 = 7 THEN 'mixed-' || lang ELSE 'f' || CAST(o_orderkey % 12 AS STRING) || '-' || lang || CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE '' END END AS fingerprint
    FROM (SELECT *, CASE (CAST(floor(o_orderkey / 12) AS BIGINT) + o_custkey) % 7 WHEN 0 THEN 'en/' WHEN 1 THEN 'en/' WHEN 2 THEN 'fr-FR/' ELSE 'it/' END AS lang FROM {orders})""",
)
block("lang_tpl", "SELECT fingerprint, count(*) AS page_count, count(DISTINCT site_id) AS site_count, min(url) AS first_url FROM lang_page GROUP BY fingerprint")


def lang_templates(spark, sf):
    return E.templates(derived(spark, sf, "lang_page"))


@query("e5_templates", "SELECT fingerprint, page_count, site_count, first_url FROM lang_tpl")
def _(spark, sf):
    return lang_templates(spark, sf)


block(
    "lang_label",
    r"""SELECT fingerprint, page_count, CASE WHEN fingerprint = 'unknown' THEN 'Pagine senza tipo' WHEN fingerprint LIKE 'mixed-%' THEN from_url || ' (strutture diverse)'
        WHEN fingerprint LIKE 'f1%' THEN 'Scheda prodotto' ELSE from_url END AS label
    FROM (SELECT *, 'Scheda sec ' || regexp_extract(first_url, 'sec-(\d+)', 1) AS from_url FROM lang_tpl)""",
)


def structural(spark, sf):
    label = F.when(F.col("fingerprint").startswith("f1"), "Scheda prodotto").otherwise("Elenco")
    return lang_templates(spark, sf).filter(~F.col("fingerprint").startswith("f2")).select("fingerprint", label.alias("structural_label"))


@query("e6_template_labels", "SELECT fingerprint, label FROM lang_label")
def _(spark, sf):
    return E.labelled(lang_templates(spark, sf), structural(spark, sf)).select("fingerprint", "label")


block(
    "lang_size",
    """SELECT fingerprint, page_count, least(page_count, greatest(3, ceil(sqrt(page_count::DOUBLE))) + CASE WHEN fingerprint = 'unknown' OR fingerprint LIKE 'mixed-%' THEN 1 ELSE 0 END)::BIGINT AS sample_size FROM lang_tpl""",
)


@query("e7_sample_sizes", "SELECT fingerprint, sample_size FROM lang_size")
def _(spark, sf):
    return E.sample_size(lang_templates(spark, sf)).select("fingerprint", "sample_size")


block(
    "lang_sample",
    """SELECT fingerprint, url FROM (SELECT fingerprint, url, row_number() OVER (PARTITION BY fingerprint ORDER BY len(string_split(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '/')), length(url), url) AS rn
      FROM lang_page) JOIN lang_size USING (fingerprint) WHERE rn <= sample_size""",
)


def lang_samples(spark, sf):
    return E.samples(derived(spark, sf, "lang_page"), E.sample_size(lang_templates(spark, sf)))


@query("e8_samples", "SELECT fingerprint, url FROM lang_sample")
def _(spark, sf):
    return lang_samples(spark, sf)


@query(
    "e8_samples_hundred",
    """SELECT fingerprint, url FROM (SELECT fingerprint, url, row_number() OVER (PARTITION BY fingerprint ORDER BY len(string_split(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '/')), length(url), url) AS rn
      FROM lang_page) JOIN lang_tpl USING (fingerprint)
    WHERE rn <= greatest(100, ceil(sqrt(page_count::DOUBLE))) + CASE WHEN fingerprint = 'unknown' OR fingerprint LIKE 'mixed-%' THEN 1 ELSE 0 END""",
)
def _(spark, sf):
    return E.samples(derived(spark, sf, "lang_page"), E.sample_size(lang_templates(spark, sf), per_template=100))


@query("e9_pages_to_measure", "SELECT site_id, url FROM lang_page WHERE url IN (SELECT url FROM lang_sample)")
def _(spark, sf):
    return E.to_measure(derived(spark, sf, "lang_page"), lang_samples(spark, sf)).select("site_id", "url")


block(
    "lang_of",
    """SELECT *, CASE WHEN regexp_matches(seg[1], '(?i)^[a-z]{2}([-_][a-z]{2,4})?$') AND list_contains(string_split('it en fr de es pt nl da sv no fi pl cs sk sl hu ro bg el ru uk tr ar he zh ja ko ca eu gl ga cy et lv lt sr hr mt is', ' '), lower(seg[1][1:2])) THEN lower(seg[1][1:2]) END AS code
    FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '/'), lambda s: s <> '') AS seg FROM lang_page)""",
)


@query("e10_url_language", "SELECT url, code, CASE WHEN code IS NOT NULL THEN '/{lang}/' || array_to_string(seg[2:], '/') END AS neutral FROM lang_of")
def _(spark, sf):
    url = F.col("url")
    return derived(spark, sf, "lang_page").select("url", U.language(url).alias("code"), U.neutral_path(url).alias("neutral"))


block(
    "lang_dom",
    """SELECT fingerprint, code FROM (SELECT fingerprint, code, count(*) AS n, sum(count(*)) OVER (PARTITION BY fingerprint) AS all_n FROM lang_of GROUP BY fingerprint, code) WHERE code IS NOT NULL AND n / all_n > 0.6""",
)


@query("e11_dominant_language", "SELECT fingerprint, code FROM lang_dom")
def _(spark, sf):
    return E.dominant_language(derived(spark, sf, "lang_page"))


block(
    "lang_shape",
    """SELECT fingerprint, min(shape) AS shape FROM (SELECT fingerprint, CASE WHEN code IS NOT NULL THEN len(seg) || ':' || coalesce(seg[2], '') END AS shape FROM lang_of) GROUP BY fingerprint HAVING count(DISTINCT shape) = 1 AND count(shape) = count(*)""",
)


@query("e12_neutral_shapes", "SELECT fingerprint, shape FROM lang_shape")
def _(spark, sf):
    return E.neutral_shapes(derived(spark, sf, "lang_page"))


# declared translations: a French page names the Italian page of another section, so slugs differ
shared(
    "lang_alt",
    """SELECT a.url AS url, b.url AS alt_url FROM {lang_page} a JOIN {lang_page} b ON b.url = replace(replace(a.url, '/fr-FR/', '/it/'), 'sec-3', 'sec-3') WHERE a.url LIKE '%/fr-FR/sec-3/%'
    UNION ALL SELECT min(url), max(url) FROM {lang_page} WHERE url LIKE '%/it/sec-4/%' OR url LIKE '%/en/sec-6/%'
    UNION ALL SELECT min(url), min(alt) FROM (SELECT url, CAST(NULL AS STRING) AS alt FROM {lang_page} WHERE url LIKE '%/it/sec-5/deep%' UNION ALL SELECT CAST(NULL AS STRING), url FROM {lang_page} WHERE url LIKE '%/en/sec-8/%')""",
)
block(
    "lang_edge",
    """SELECT DISTINCT a, b FROM (
      SELECT s.fingerprint AS a, c.b FROM lang_shape s JOIN lang_dom USING (fingerprint) JOIN (SELECT shape, min(fingerprint) AS b FROM lang_shape JOIN lang_dom USING (fingerprint) GROUP BY shape HAVING count(DISTINCT code) >= 2) c USING (shape) WHERE s.fingerprint <> c.b
      UNION ALL SELECT x.fingerprint, y.fingerprint FROM lang_alt l JOIN lang_page x ON x.url = l.url JOIN lang_page y ON y.url = l.alt_url
        JOIN lang_dom dx ON dx.fingerprint = x.fingerprint JOIN lang_dom dy ON dy.fingerprint = y.fingerprint WHERE x.fingerprint <> y.fingerprint AND dx.code <> dy.code)""",
)


def lang_edges(spark, sf):
    p = derived(spark, sf, "lang_page")
    return E.variant_edges(E.dominant_language(p), E.neutral_shapes(p), p, derived(spark, sf, "lang_alt"))


@query("e13_variant_edges", "SELECT a, b FROM lang_edge")
def _(spark, sf):
    return lang_edges(spark, sf)


block(
    "lang_walk",
    """SELECT fingerprint AS node, fingerprint AS seen FROM lang_dom
    UNION SELECT w.node, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM lang_walk w JOIN lang_edge e ON e.a = w.seen OR e.b = w.seen""",
)
block("lang_family", "SELECT node, min(seen) AS component FROM lang_walk GROUP BY node")


def lang_families(spark, sf):
    languages = E.dominant_language(derived(spark, sf, "lang_page"))
    return E.connected_components(languages.select(F.col("fingerprint").alias("node")), lang_edges(spark, sf))


@query("e14_variant_families", "SELECT node, component FROM lang_family")
def _(spark, sf):
    return lang_families(spark, sf)


block(
    "lang_role",
    """SELECT d.fingerprint, d.code, b.code AS primary_code, d.code = b.code AS is_primary FROM lang_dom d JOIN lang_family f ON f.node = d.fingerprint
    JOIN (SELECT component, arg_min(code, (-n, code)) AS code FROM (SELECT component, code, sum(page_count) AS n FROM lang_family JOIN lang_dom ON node = fingerprint JOIN lang_tpl USING (fingerprint) GROUP BY component, code) GROUP BY component) b USING (component)""",
)


def lang_roles(spark, sf):
    languages = E.dominant_language(derived(spark, sf, "lang_page"))
    return E.language_roles(lang_templates(spark, sf), languages, lang_families(spark, sf))


@query("e15_language_roles", "SELECT fingerprint, code, primary_code, is_primary FROM lang_role")
def _(spark, sf):
    return lang_roles(spark, sf)


block(
    "lang_final",
    """SELECT fingerprint, l.page_count, CASE WHEN r.is_primary = false THEN 1 ELSE sample_size END AS sample_size, l.label || CASE WHEN r.is_primary = false THEN ' [' || upper(code) || ': controllo a campione]' ELSE '' END AS label
    FROM lang_label l JOIN lang_size USING (fingerprint) LEFT JOIN lang_role r USING (fingerprint)""",
)


def lang_final(spark, sf):
    sized = E.sample_size(E.labelled(lang_templates(spark, sf), structural(spark, sf)))
    return E.spot_check(sized, lang_roles(spark, sf))


@query("e16_spot_check", "SELECT fingerprint, sample_size::BIGINT AS sample_size, label FROM lang_final")
def _(spark, sf):
    return lang_final(spark, sf).select("fingerprint", "sample_size", "label")


@query(
    "e17_compression",
    """SELECT (SELECT count(DISTINCT site_id || fingerprint) FROM lang_page) AS groups, count(*) AS templates, sum(page_count)::BIGINT AS pages, sum(sample_size)::BIGINT AS samples,
      coalesce(sum(page_count) FILTER (fingerprint LIKE 'mixed-%'), 0)::BIGINT AS mixed_pages, floor(sum(page_count)::DOUBLE / sum(sample_size) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS compression FROM lang_final""",
)
def _(spark, sf):
    groups = derived(spark, sf, "lang_page").select(F.concat("site_id", "fingerprint").alias("group_key"))
    return E.compression(lang_final(spark, sf), groups)


@query(
    "r4_template_listing",
    """SELECT fingerprint, label, (SELECT string_agg(DISTINCT site_id, ', ' ORDER BY site_id) FROM lang_page p WHERE p.fingerprint = l.fingerprint) AS sites, page_count,
      (SELECT count(*) FROM lang_sample s WHERE s.fingerprint = l.fingerprint) AS samples, (SELECT string_agg(url, chr(10) ORDER BY url) FROM lang_sample s WHERE s.fingerprint = l.fingerprint) AS urls
    FROM lang_label l""",
)
def _(spark, sf):
    p = derived(spark, sf, "lang_page")
    labelled = E.labelled(lang_templates(spark, sf), structural(spark, sf))
    sites = p.select("site_id", F.col("site_id").alias("label")).dropDuplicates()
    return R.template_listing(labelled, p, lang_samples(spark, sf), sites)


# ---------------------------------------------------------------- labels from body classes, recorded chains
shared(
    "body_class",
    """SELECT p_partkey AS k, CASE p_partkey % 10 WHEN 0 THEN 'path-frontpage' WHEN 1 THEN 'x node--type-article' WHEN 2 THEN 'page-node-type-event' WHEN 3 THEN 'page-contatti'
        WHEN 4 THEN 'single-post' WHEN 5 THEN 'has-search page-x' WHEN 6 THEN 'views-row' WHEN 7 THEN 'category-a' ELSE 'plain' END AS body_text,
      CAST(CASE WHEN p_partkey % 20 = 8 THEN 1 ELSE 0 END AS BIGINT) AS tables, CAST(CASE WHEN p_partkey % 20 = 18 THEN 3 ELSE 0 END AS BIGINT) AS articles, CAST(CASE WHEN p_partkey % 20 = 9 THEN 2 ELSE 0 END AS BIGINT) AS forms,
      CAST(p_partkey % 3 AS BIGINT) AS lists, p_partkey % 40 = 19 AS has_sidebar FROM {part}""",
)


@query(
    "d8_template_labels",
    """SELECT k, CASE k % 10 WHEN 0 THEN 'Homepage' WHEN 1 THEN 'Scheda article' WHEN 2 THEN 'Scheda event' WHEN 3 THEN 'Pagina contatti' WHEN 4 THEN 'Scheda post' WHEN 5 THEN 'Risultati di ricerca'
      WHEN 6 THEN 'Elenco' WHEN 7 THEN 'Categoria' ELSE CASE WHEN k % 20 = 8 THEN 'Pagina con tabelle' WHEN k % 20 = 18 THEN 'Elenco' WHEN k % 20 = 9 THEN 'Pagina con form'
      WHEN k % 40 = 19 THEN 'Contenuto con sidebar' ELSE 'Pagina di contenuto' END END AS label FROM body_class""",
)
def _(spark, sf):
    rows = derived(spark, sf, "body_class").withColumn("landmarks", F.array(F.lit("nav"), F.lit("main")))
    return rows.select("k", ID.inferred_label(F.split("body_text", " ")).alias("label"))


def chains(spark, sf):
    """Recorded chains as JSON text, one per part."""
    k = F.col("p_partkey")
    inner = F.when(k % 6 == 0, '{"tag":"A","classes":["aBcDeF","card-link"]}').when(k % 6 == 1, '{"tag":"a","classes":[],"role":"button"}').when(
        k % 6 == 2, F.concat(F.lit('{"tag":"a","classes":["gm-x"],"id":"n'), k, F.lit('"}'))
    ).when(k % 6 == 3, '{"tag":"input","classes":[],"testAttr":"data-cy=q"}').when(k % 6 == 4, '{"tag":"div","classes":["rare"]}')
    inner = inner.otherwise('{"tag":"span","classes":[],"id":":r1:"}')
    top = F.when(k % 2 == 0, ',{"tag":"header","classes":["site-head"],"landmark":true}').otherwise(',{"tag":"section","classes":["rare"]}')
    chain = F.concat(F.lit('{"chain":['), inner, F.lit(',{"tag":"div","classes":["rare"]},{"tag":"div","classes":[],"id":"list"}'), top, F.lit("]}"))
    text = F.when(k % 25 == 0, "document").when(k % 26 == 1, '{"chain":[]}').otherwise(chain)
    return table(spark, sf, "part").select(k.alias("k"), text.alias("signature_input"), F.when(k % 9 == 0, '{"__consentBanner":true}').otherwise("{}").alias("data"))


@query(
    "d9_d12_recorded_chains",
    """SELECT p_partkey AS k, CASE WHEN k % 9 = 0 THEN 'banner-consenso > ' ELSE '' END || CASE WHEN k % 25 = 0 THEN 'document' WHEN k % 26 = 1 THEN 'unknown' WHEN k % 6 = 2 THEN 'terze-parti:Google Maps'
      ELSE CASE WHEN k % 2 = 0 THEN 'header.site-head > ' ELSE 'body > ' END || 'div#list > ' || CASE k % 6 WHEN 0 THEN 'a.card-link' WHEN 1 THEN 'a[button]' WHEN 3 THEN 'input[data-cy=q]' WHEN 4 THEN 'div' ELSE 'span' END END AS signature
    FROM (SELECT *, p_partkey AS k FROM part)""",
)
def _(spark, sf):
    from auditlake.operators import evidence as H

    words = lambda *w: spark.createDataFrame([(x,) for x in w], "token string")
    out = H.resolve_signatures(chains(spark, sf), words("card-link", "site-head"), words("list"))
    return out.select("k", F.col("component_signature").alias("signature"))
