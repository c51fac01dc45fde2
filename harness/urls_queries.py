"""Discovery and URL queries (inventory A1-A4, B1-B16, M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.lineage import cut
from auditlake.operators import discovery as D
from auditlake.sources import corpus as C

from .core import block, derived, query, shared, table, values

TRACK = "(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|_ga)"
block(
    "raw_url",
    r"""SELECT page_id, url AS raw,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sch,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS auth,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS pth,
    string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS pairs
  FROM pages""",
)
block(
    "canon",
    rf"""SELECT page_id, raw, sch || '://' || auth || CASE WHEN length(pth) <= 1 THEN '/' ELSE regexp_replace(pth, '/$', '') END
     || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url
  FROM (SELECT *, list_filter(pairs, lambda x: x <> '' AND NOT regexp_matches(x, '{TRACK}')) AS kept FROM raw_url)
  WHERE sch IN ('http', 'https')""",
)
block(
    "page",
    """SELECT min(page_id) AS page_id, url,
    regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www[.]', '') AS site_id
  FROM canon GROUP BY url""",
)
# catalogue URLs: deep sections, collections, a flat site
shared(
    "shop_url",
    """SELECT min(p_partkey) AS page_id, url, site_id FROM (
      SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN 'flat.example' ELSE 'shop' || CAST(p_size % 3 AS STRING) || '.example' END AS site_id,
        CASE WHEN p_partkey % 10 = 9 THEN 'https://flat.example/' || replace(p_name, ' ', '-')
        ELSE 'https://www.shop' || CAST(p_size % 3 AS STRING) || '.example/' || CASE p_partkey % 4 WHEN 0 THEN 'it/' WHEN 1 THEN 'en/' ELSE '' END
          || lower(p_type) || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '/' || replace(p_name, ' ', '-') END
          || CASE WHEN p_partkey % 5 = 0 THEN '/' || CAST(p_partkey AS STRING) ELSE '' END
          || CASE WHEN p_partkey % 11 = 0 THEN '?page=1&b=2' ELSE '' END END AS url
      FROM {part}) GROUP BY url, site_id""",
)
block(
    "page_seg",
    r"""SELECT page_id, url, site_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS raw_segs,
    list_sort(list_transform(list_filter(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda p: p <> ''),
              lambda p: regexp_extract(p, '^([^=]*)', 1))) AS keys
  FROM (SELECT page_id, url, site_id FROM page UNION ALL SELECT page_id, url, site_id FROM shop_url)""",
)
block(
    "page_class",
    r"""SELECT *, list_transform(raw_segs, lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN ':num'
      WHEN regexp_matches(s, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-') THEN ':uuid'
      WHEN regexp_matches(s, '[0-9]{3,}') THEN ':id' ELSE lower(s) END) AS segs,
    CASE WHEN len(keys) > 0 THEN '?' || array_to_string(keys, ',') ELSE '' END AS suffix
  FROM page_seg""",
)
block(
    "path_child",
    """SELECT DISTINCT host || '/' || array_to_string(segs[1:i], '/') AS prefix, i AS depth, segs[i + 1] AS child
  FROM (SELECT host, segs, unnest(range(0, len(segs))) AS i FROM page_class)""",
)
block(
    "collection",
    """SELECT prefix, depth, count(*) AS children,
    avg(CASE WHEN depth > 0 AND EXISTS (SELECT 1 FROM path_child k WHERE k.prefix = c.prefix || '/' || c.child) THEN 0.0 ELSE 1.0 END) AS leaf_share
  FROM path_child c GROUP BY prefix, depth
  HAVING children >= 4 AND leaf_share >= 0.85 AND (depth > 0 OR (children >= 15 AND leaf_share >= 0.9))""",
)
block(
    "page_pattern",
    """SELECT url, any_value(site_id) AS site_id, any_value(host) || '/' || coalesce(string_agg(seg, '/' ORDER BY i), '') || any_value(suffix) AS pattern
  FROM (SELECT p.url, p.site_id, p.host, p.suffix, i,
          CASE WHEN segs[i] LIKE ':%' OR i IS NULL OR NOT EXISTS
            (SELECT 1 FROM collection c WHERE c.prefix = p.host || '/' || array_to_string(segs[1:i - 1], '/'))
          THEN segs[i] ELSE ':item' END AS seg
        FROM page_class p LEFT JOIN LATERAL (SELECT unnest(range(1, len(p.segs) + 1)) AS i) ON true)
  GROUP BY url""",
)


def pages(spark, sf):
    """Canonical page table of the corpus."""
    return C.canonical_pages(table(spark, sf, "pages"))


def url_pool(spark, sf):
    """Corpus pages and catalogue URLs."""
    return cut(pages(spark, sf).unionByName(derived(spark, sf, "shop_url")))


@query("a1_page_scan", "SELECT page_id, url, length(html)::INTEGER AS html_chars FROM pages")
def _(spark, sf):
    return C.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("html_chars"))


@query(
    "a2_excluded_pages",
    r"""SELECT url, site_id FROM page WHERE NOT CASE length(site_id) % 3 WHEN 0 THEN regexp_matches(url, '\?page=')
      WHEN 1 THEN regexp_matches(url, '/es/|\.html$') ELSE regexp_matches(url, '^http:') END""",
)
def _(spark, sf):
    p = pages(spark, sf)
    kind = F.length("site_id") % 3
    sites = p.select("site_id").dropDuplicates().withColumn(
        "exclude",
        F.when(kind == 0, F.array(F.lit(r"\?page=")))
        .when(kind == 1, F.array(F.lit("/es/"), F.lit(r"\.html$")))
        .otherwise(F.array(F.lit("^http:"))),
    )
    return D.exclude_pages(p, sites).select("url", "site_id")


# 10 small sites per 2,000 parts: one index document naming four url sets each
shared(
    "sitemap_doc",
    """SELECT 'https://s' || CAST(site AS STRING) || '.example' || name AS doc_url, body FROM (
    SELECT site, '/sitemap.xml' AS name, '<sitemapindex><sitemap><loc> https://s' || CAST(site AS STRING) || '.example/sm0.xml</loc></sitemap><loc>https://s'
      || CAST(site AS STRING) || '.example/sm1.xml </loc><LOC>https://s' || CAST(site AS STRING) || '.example/sm2.xml</LOC></sitemapindex>' AS body
    FROM (SELECT DISTINCT CAST(floor(p_partkey / 200) AS BIGINT) AS site FROM {part})
    UNION ALL
    SELECT site, '/sm' || CAST(chunk AS STRING) || '.xml',
      '<urlset>' || array_to_string(array_agg('<url><loc>' || loc || '</loc></url>' ORDER BY loc), '') || '</urlset>'
    FROM (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS site, p_partkey % 4 AS chunk,
        'https://s' || CAST(CAST(floor(p_partkey / 200) AS BIGINT) AS STRING) || CASE WHEN p_size = 7 THEN '.other' ELSE '' END || '.example/' || lower(p_type) || '/'
          || CAST(p_partkey AS STRING) || CASE WHEN p_size % 9 = 0 THEN '.pdf' WHEN p_size % 9 = 1 THEN '/?utm_source=x' ELSE '' END AS loc
      FROM {part})
    GROUP BY site, chunk)""".replace("array_to_string(array_agg('<url><loc>' || loc || '</loc></url>' ORDER BY loc), '')", "string_agg('<url><loc>' || loc || '</loc></url>')"),
)


@query(
    "a3_sitemap_urls",
    """SELECT DISTINCT 's' || site AS site_id, 'https://s' || site || '.example/' || lower(p_type) || '/' || p_partkey AS url
    FROM (SELECT floor(p_partkey / 200)::BIGINT AS site, * FROM part)
    WHERE p_partkey % 4 < 3 AND p_size <> 7 AND p_size % 9 <> 0""",
)
def _(spark, sf):
    docs = derived(spark, sf, "sitemap_doc")
    host = F.regexp_extract("doc_url", "^https://([^/]+)", 1)
    sites = docs.select(
        F.regexp_extract("doc_url", "^https://(s[0-9]+)", 1).alias("site_id"), F.concat(F.lit("https://"), host).alias("base_url")
    ).dropDuplicates()
    return D.sitemap_urls(docs, sites)


block(
    "link_edge",
    r"""SELECT DISTINCT src, dst FROM (
    SELECT p.url AS src, regexp_extract(p.url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN length(h) > 1 THEN regexp_replace(h, '/$', '') ELSE h END AS dst
    FROM page p JOIN (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\shref\s*=\s*["'']([^"'']+)["'']', 1)) AS h FROM pages) USING (page_id)
    WHERE h LIKE '/%')
  WHERE NOT regexp_matches(dst, '(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz|jpe?g|png|gif|webp|avif|svg|ico|mp4|mp3|wav|avi|mov|css|js|json|xml|rss|woff2?|ttf|eot)$')
    AND NOT regexp_matches(dst, '(?i)/(cdn-cgi|wp-json|xmlrpc\.php|wp-admin|wp-login\.php|\.well-known)(/|$)')""",
)


def edges(spark, sf):
    own = U.canonical(F.col("url"))
    raw = table(spark, sf, "pages").select("page_id", own.alias("url"), U.origin(own).alias("base_url"), "html")
    return D.link_edges(raw, pages(spark, sf))


@query("a4_link_edges", "SELECT src, dst FROM link_edge")
def _(spark, sf):
    return edges(spark, sf)


@query("b1_canonical_url", "SELECT page_id, raw, url FROM canon")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("raw"), U.canonical(F.col("url")).alias("url"))


@query(
    "b1_relative_url",
    """SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN 'https://www.shop.example/a/x' WHEN 1 THEN 'https://www.shop.example/a/b/y?b=1'
      WHEN 2 THEN 'https://other.example/z' WHEN 3 THEN 'https://www.shop.example/a/b/c' || c_custkey || '?q=' || c_nationkey
      WHEN 4 THEN 'https://www.shop.example/a/b/c' || c_custkey || '?s=1' WHEN 5 THEN NULL WHEN 6 THEN 'https://www.shop.example/top'
      WHEN 7 THEN 'http://plain.example:8080/' WHEN 8 THEN 'https://www.shop.example/up' ELSE 'https://www.shop.example/a/b/rel/' || c_nationkey END AS url
    FROM customer""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    base = F.concat(F.lit("HTTPS://www.Shop.example:443/a/b/c"), k, F.lit("?s=1#top"))
    forms = [
        F.lit("../x"), F.lit("./y?utm_source=m&b=1&FBCLID=9"), F.lit("//Other.example:443/z/"),
        F.concat(F.lit("?q="), F.col("c_nationkey")), F.lit("#frag"), F.lit("mailto:a@b.example"), F.lit("/top/"),
        F.lit(" HTTP://plain.example:8080 "), F.lit("/a/./b/../../../up"),
    ]
    raw = F.concat(F.lit("rel/"), F.col("c_nationkey"))
    for i, f in reversed(list(enumerate(forms))):
        raw = F.when(k % 10 == i, f).otherwise(raw)
    return c.select(k.alias("k"), U.canonical(raw, base).alias("url"))


shared(
    "asset_url",
    """SELECT p_partkey AS k, 'https://s.example/' || CASE p_partkey % 8 WHEN 0 THEN 'files/' || CAST(p_size AS STRING) || '.PDF' WHEN 1 THEN 'x.pdf?y=1'
      WHEN 2 THEN 'wp-admin/edit' WHEN 3 THEN 'cdn-cgi' WHEN 4 THEN 'wp-admins/' WHEN 5 THEN 'a.jpeg' WHEN 6 THEN '.well-known/x' ELSE lower(p_type) END AS url
    FROM {part}""",
)


@query("b2_page_filter", "SELECT k, url FROM asset_url WHERE k % 8 IN (1, 4, 7)")
def _(spark, sf):
    return derived(spark, sf, "asset_url").filter(U.is_page(F.col("url")))


@query("b3_same_origin", "SELECT src, dst FROM link_edge WHERE src LIKE 'https://%'")
def _(spark, sf):
    base = F.concat(F.lit("https://"), U.host(F.col("src")), F.lit(":443/"))
    return edges(spark, sf).filter(U.same_origin(F.col("dst"), base))


@query(
    "b4_same_site",
    """SELECT p.url, 'http://www.' || p.site_id || '/x?y=1' AS other, p.url NOT LIKE '%.org%' AS same
    FROM page p""",
)
def _(spark, sf):
    other = F.concat(F.lit("http://www."), F.col("site_id"), F.lit("/x?y=1"))
    foreign = F.col("url").contains(".org")
    probe = F.when(foreign, F.concat(F.lit("https://sub."), F.col("site_id"))).otherwise(other)
    return pages(spark, sf).select("url", other.alias("other"), U.same_site(F.col("url"), probe).alias("same"))


shared(
    "probe_log",
    """SELECT o_orderkey AS k, 'https://www.site' || CAST(o_custkey % 9 AS STRING) || '.example/p/' || CAST(o_orderkey AS STRING) AS url,
      CASE o_orderkey % 11 WHEN 3 THEN 'https://elsewhere.example/' WHEN 4 THEN 'http://site' || CAST(o_custkey % 9 AS STRING) || '.example/'
        ELSE 'https://www.site' || CAST(o_custkey % 9 AS STRING) || '.example/p/' || CAST(o_orderkey AS STRING) END AS final_url,
      CAST(CASE o_orderkey % 13 WHEN 2 THEN 404 WHEN 5 THEN 500 WHEN 7 THEN 302 ELSE 200 END AS INT) AS http_status
    FROM {orders}""",
)


@query(
    "b5_offsite_pages",
    """SELECT url, 'porta fuori dal sito (elsewhere.example), tolta dal giro' AS reason FROM probe_log WHERE k % 11 = 3""",
)
def _(spark, sf):
    return D.exclude_offsite(derived(spark, sf, "probe_log"))[1]


@query(
    "b6_broken_links",
    """SELECT url, http_status, 'risposta HTTP ' || http_status || ', tolta dal giro' AS reason
    FROM probe_log WHERE k % 13 IN (2, 5)""",
)
def _(spark, sf):
    return D.exclude_errors(derived(spark, sf, "probe_log"))[1]


# a link graph with cycles: every line item links its part to another one of the same site
shared(
    "link_graph",
    """SELECT DISTINCT 's' || CAST(l_partkey % 5 AS STRING) AS site_id, 'https://s' || CAST(l_partkey % 5 AS STRING) || '.example/' || CAST(l_partkey AS STRING) AS src,
      'https://s' || CAST(l_partkey % 5 AS STRING) || '.example/' || CAST((l_partkey * 3 + l_suppkey * 5 - l_partkey * 3 % 5 + l_partkey % 5) % 1000 - ((l_partkey * 3 + l_suppkey * 5 - l_partkey * 3 % 5 + l_partkey % 5) % 1000) % 5 + l_partkey % 5 AS STRING) AS dst
    FROM {lineitem}""",
)


@query(
    "b7_link_reach",
    """SELECT site_id, url, min(depth)::INTEGER AS depth FROM reach GROUP BY site_id, url""",
)
def _(spark, sf):
    g = derived(spark, sf, "link_graph")
    n = F.array(*[F.lit(i) for i in range(5)])
    seeds = g.select("site_id").dropDuplicates().select(
        "site_id", F.concat(F.lit("https://"), "site_id", F.lit(".example/"), F.substr("site_id", F.lit(2))).alias("url")
    )
    return D.link_reach(seeds, g)


block(
    "reach",
    """SELECT DISTINCT site_id, 'https://' || site_id || '.example/' || substr(site_id, 2) AS url, 0 AS depth FROM link_graph
    UNION SELECT g.site_id, g.dst, r.depth + 1 FROM reach r JOIN link_graph g ON g.site_id = r.site_id AND g.src = r.url WHERE r.depth < 40""",
)


@query(
    "b8_merged_discovery",
    """SELECT coalesce(s.url, l.url) AS url, coalesce(s.site_id, l.site_id) AS site_id,
      CASE WHEN s.url IS NOT NULL THEN 0 ELSE l.depth END::INTEGER AS depth,
      CASE WHEN s.url IS NULL THEN l.http_status END::INTEGER AS http_status,
      CASE WHEN s.url IS NOT NULL THEN 'sitemap' ELSE 'link' END AS discovered_via
    FROM (SELECT url, 'site' AS site_id FROM probe_log WHERE k % 3 = 0) s
    FULL JOIN (SELECT url, 'site' AS site_id, k % 4 AS depth, http_status FROM probe_log WHERE k % 5 < 3) l ON s.url = l.url""",
)
def _(spark, sf):
    log = derived(spark, sf, "probe_log").withColumn("site_id", F.lit("site"))
    listed = log.filter("k % 3 = 0").select("site_id", "url")
    linked = log.filter("k % 5 < 3").select("site_id", "url", (F.col("k") % 4).cast("int").alias("depth"), "http_status")
    return D.merge_discoveries(listed, linked)


@query("b9_classed_path", "SELECT url, array_to_string(segs, '/') AS path FROM page_class")
def _(spark, sf):
    return url_pool(spark, sf).select("url", F.array_join(U.classed_segments(F.col("url")), "/").alias("path"))


@query("b10_url_shape", "SELECT url, host || '/' || array_to_string(segs, '/') || suffix AS shape FROM page_class")
def _(spark, sf):
    return url_pool(spark, sf).select("url", U.shape(F.col("url")).alias("shape"))


@query("b11_path_children", "SELECT prefix, depth::INTEGER AS depth, count(*) AS children FROM path_child GROUP BY prefix, depth")
def _(spark, sf):
    return D.path_children(url_pool(spark, sf)).groupBy("prefix", "depth").agg(F.count("*").alias("children"))


@query("b12_collections", "SELECT prefix, depth::INTEGER AS depth, children, leaf_share FROM collection")
def _(spark, sf):
    return D.collections(D.path_children(url_pool(spark, sf)))


@query("b13_url_pattern", "SELECT url, pattern FROM page_pattern")
def _(spark, sf):
    return D.url_patterns(url_pool(spark, sf))


@query("b14_pattern_groups", "SELECT site_id || '::' || pattern AS group_key, count(*) AS pages FROM page_pattern GROUP BY 1")
def _(spark, sf):
    p = url_pool(spark, sf)
    return D.pattern_groups(p, D.url_patterns(p)).groupBy("group_key").agg(F.count("*").alias("pages"))


block(
    "page_label",
    r"""SELECT url, CASE WHEN len(kept) = 0 THEN 'Homepage' WHEN len(kept) > 1 THEN 'Scheda ' || replace(kept[1], '-', ' ')
      ELSE upper(replace(kept[1], '-', ' ')[1]) || replace(kept[1], '-', ' ')[2:] END AS label
    FROM (SELECT url, list_filter(raw_segs, lambda s: NOT regexp_matches(s, '(?i)^[a-z]{2}(-[a-z]{2})?$')) AS kept FROM page_seg)""",
)


@query("b15_url_label", "SELECT url, label FROM page_label")
def _(spark, sf):
    return url_pool(spark, sf).select("url", U.readable_label(F.col("url")).alias("label"))


@query("b16_url_section", "SELECT url, CASE WHEN len(raw_segs) > 0 THEN raw_segs[1] ELSE '(radice)' END AS section FROM page_seg")
def _(spark, sf):
    return url_pool(spark, sf).select("url", U.section(F.col("url")).alias("section"))


@query(
    "m6_trial_pages",
    """SELECT site_id, url FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY k % 4, url) AS rn
      FROM (SELECT 'site' || (k % 7) AS site_id, url, k FROM probe_log)) WHERE rn <= 40""",
)
def _(spark, sf):
    log = derived(spark, sf, "probe_log").select(
        F.concat(F.lit("site"), F.col("k") % 7).alias("site_id"), "url", (F.col("k") % 4).alias("depth")
    )
    return D.cap_per_site(log, 40).select("site_id", "url")
