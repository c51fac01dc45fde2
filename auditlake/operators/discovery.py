"""From raw URLs, link edges and sitemaps to a discovered page set and its URL patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..lineage import cut, release

# Crawl defaults.
MIN_LINK_PAGES = 60
SITEMAP_NAMES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]
COLLECTION_CHILDREN = 4
COLLECTION_LEAF_SHARE = 0.85
ROOT_CHILDREN = 15
ROOT_LEAF_SHARE = 0.9


def exclude_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Drop pages whose URL matches one of their site's patterns anywhere (A2)."""
    # one pattern and so one row per site: the pages of a large site can be split among tasks
    whole = F.array_join(F.transform("exclude", lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    rules = sites.filter(F.size("exclude") > 0).select(F.col("site_id").alias("_site"), whole.alias("_pattern"))
    marked = pages.join(rules, F.col("site_id") == F.col("_site"), "left")
    return marked.filter(F.col("_pattern").isNull() | ~F.rlike("url", "_pattern")).drop("_site", "_pattern")


def link_edges(pages: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html, base_url)`` to distinct in-site edges ``(src, dst)`` (A4).

    The markup is scanned as raw text, so links in comments and scripts count.
    Only resolved links leave the scan; the markup itself is never shuffled,
    so ``keep(page_id)``, the pages that count, is applied to links.
    """
    hrefs = F.regexp_extract_all("html", F.lit(U.HREF), F.lit(1))
    resolved = F.transform(hrefs, lambda h: U.canonical(h, F.col("url")))
    kept = F.filter(resolved, lambda u: U.same_origin(u, F.col("base_url")) & U.is_page(u))
    links = pages.select("page_id", F.col("url").alias("src"), F.explode(F.array_distinct(kept)).alias("dst"))
    if keep is not None:
        links = links.join(keep.select("page_id"), "page_id", "left_semi")
    return links.select("src", "dst").dropDuplicates()


def sitemap_urls(docs: DataFrame, sites: DataFrame, max_pages: int | None = None, max_documents: int | None = None) -> DataFrame:
    """Sitemap documents ``docs(doc_url, body)`` to ``(site_id, url)``, following nested indexes (A3).

    Documents are visited breadth first per site, all of them by default. A
    caller may stop after ``max_documents`` of a site (50 is usual), or open no
    further one once ``max_pages`` URLs are known (800 is usual); that test sits
    between documents, so the last one may overshoot.
    """
    starts = sites.select(
        "site_id", "base_url", F.posexplode(F.array(*[F.lit(n) for n in SITEMAP_NAMES])).alias("pos", "name")
    )
    frontier = starts.select(
        "site_id", "base_url", U.canonical(F.col("name"), F.col("base_url")).alias("doc_url"), F.col("pos").cast("long").alias("rank")
    )
    index_links = docs.filter(F.col("body").rlike("(?i)<sitemapindex")).select(
        "doc_url", F.posexplode(F.regexp_extract_all("body", F.lit(U.LOC), F.lit(1))).alias("pos", "child")
    )
    order = Window.partitionBy("site_id").orderBy("rank")
    seen = cut(frontier.withColumn("seq", F.row_number().over(order).cast("long")))
    frontier = seen
    # a document is visited once per site, so the loop ends
    while True:
        children = (
            frontier.join(index_links, "doc_url")
            .groupBy("site_id", "base_url", F.col("child").alias("doc_url"))
            .agg(F.min(F.struct("seq", "pos")).alias("first"))
            .join(seen.select("site_id", "doc_url"), ["site_id", "doc_url"], "left_anti")
        )
        known = seen.groupBy("site_id").agg(F.max("seq").alias("last"))
        level = Window.partitionBy("site_id").orderBy("first.seq", "first.pos", "doc_url")
        numbered = (
            children.join(known, "site_id")
            .withColumn("seq", F.row_number().over(level) + F.col("last"))
        )
        if max_documents is not None:
            numbered = numbered.filter(F.col("seq") <= max_documents)
        frontier = cut(numbered.select("site_id", "base_url", "doc_url", F.col("seq").alias("rank"), "seq"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)

    locs = docs.filter(~F.col("body").rlike("(?i)<sitemapindex")).select(
        "doc_url", F.regexp_extract_all("body", F.lit(U.LOC), F.lit(1)).alias("locs")
    )
    resolved = F.transform("locs", lambda u: U.canonical(u, F.col("base_url")))
    kept = F.filter(resolved, lambda u: U.same_origin(u, F.col("base_url")) & U.is_page(u))
    found = (
        seen.join(locs, "doc_url")
        .select("site_id", "seq", F.explode(kept).alias("url"))
        .groupBy("site_id", "url")
        .agg(F.min("seq").alias("seq"))
    )
    if max_pages is None:
        return found.select("site_id", "url")
    # one row per document of a site reaches this window
    per_doc = found.groupBy("site_id", "seq").agg(F.count("*").alias("n"))
    before = F.sum("n").over(
        Window.partitionBy("site_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    readable = per_doc.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_pages)
    return found.join(readable.select("site_id", "seq"), ["site_id", "seq"], "left_semi").select("site_id", "url")


def exclude_offsite(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(url, final_url, ...)`` into kept pages and ``(url, reason)`` for off-site arrivals."""
    stays = U.same_site(F.col("final_url"), F.col("url"))
    reason = F.concat(
        F.lit("porta fuori dal sito ("), F.coalesce(U.host(F.col("final_url")), F.lit("")), F.lit("), tolta dal giro")
    )
    return results.filter(stays), results.filter(~stays).select("url", reason.alias("reason"))


def exclude_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(url, http_status, ...)`` into kept pages and broken links with a reason."""
    broken = F.coalesce(F.col("http_status"), F.lit(0)) >= 400
    reason = F.concat(F.lit("risposta HTTP "), F.col("http_status").cast("string"), F.lit(", tolta dal giro"))
    return results.filter(~broken), results.filter(broken).select("url", "http_status", reason.alias("reason"))


def link_reach(
    seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, max_pages: int | None = None
) -> DataFrame:
    """Breadth-first reach ``(site_id, url, depth)`` over recorded edges.

    ``seeds(site_id, url)``, ``edges(site_id, src, dst)``. All reachable pages
    by default. A caller may stop at ``max_depth`` (3 is usual; those pages are
    kept and not expanded), and with ``max_pages`` keep the first quarter of that
    many pages of a site, 60 at least, by (depth, url); expansion runs level by
    level, so pages past that cap could only have led to pages past it. The edges are stored once, as every
    level reads them.
    """
    edges = cut(edges.select("site_id", F.col("src").alias("url"), "dst").repartition("site_id", "url"))
    frontier = cut(seeds.select("site_id", "url").dropDuplicates().withColumn("depth", F.lit(0)))
    visited = frontier
    depth = 0
    while depth != max_depth:
        depth += 1
        step = (
            frontier.join(edges, ["site_id", "url"])
            .select("site_id", F.col("dst").alias("url"))
            .dropDuplicates()
        )
        fresh = step.join(visited.select("site_id", "url"), ["site_id", "url"], "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    release(edges)
    if max_pages is None:
        return visited
    order = Window.partitionBy("site_id").orderBy("depth", "url")
    return visited.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(MIN_LINK_PAGES, max_pages // 4)).drop("_rn")


def merge_discoveries(from_sitemap: DataFrame, from_links: DataFrame) -> DataFrame:
    """Sitemap rows win; a URL known to both keeps the smaller depth.

    ``from_sitemap(site_id, url)``, ``from_links(site_id, url, depth, http_status)``.
    """
    s = from_sitemap.select("site_id", "url", F.lit(True).alias("_listed"))
    merged = s.join(from_links, ["site_id", "url"], "full_outer")
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    return merged.select(
        "url",
        "site_id",
        F.when(listed, F.least(F.lit(0), F.coalesce("depth", F.lit(0)))).otherwise(F.col("depth")).cast("int").alias("depth"),
        F.when(~listed, F.col("http_status")).cast("int").alias("http_status"),
        F.when(listed, F.lit("sitemap")).otherwise(F.lit("link")).alias("discovered_via"),
    )


def _prefix(host: Column, parts: Column) -> Column:
    return F.concat(host, F.lit("/"), F.array_join(parts, "/"))


def path_children(urls: DataFrame) -> DataFrame:
    """Distinct classed child per path prefix: ``(prefix, depth, child)``."""
    base = urls.filter(U.is_web(F.col("url"))).select(
        U.host(F.col("url")).alias("host"), U.classed_segments(F.col("url")).alias("segs")
    )
    # paths repeat heavily once classed: collapse them before exploding
    parts = base.dropDuplicates().select("host", "segs", F.posexplode("segs").alias("depth", "child"))
    prefix = F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("segs", F.lit(1), F.col("depth")), "/"))
    return parts.select(prefix.alias("prefix"), "depth", "child").dropDuplicates()


def collections(children: DataFrame, threshold: int = COLLECTION_CHILDREN, root_leaf_mode: str = "as_coded") -> DataFrame:
    """Prefixes whose children are mostly leaves (B12): ``(prefix, depth, children, leaf_share)``.

    ``root_leaf_mode``: at depth 0 the default counts every child as a leaf;
    ``as_documented`` looks the child up like at any other depth.
    """
    parents = children.select(F.col("prefix").alias("_parent")).dropDuplicates()
    at_root = F.col("depth") == 0
    path = F.concat(F.col("prefix"), F.when(at_root, F.lit("")).otherwise(F.lit("/")), F.col("child"))
    if root_leaf_mode == "as_coded":
        path = F.when(~at_root, path)
    joined = children.withColumn("_path", path).join(parents, F.col("_path") == F.col("_parent"), "left")
    scored = joined.groupBy("prefix", "depth").agg(
        F.count("*").alias("children"),
        F.avg(F.when(F.col("_parent").isNull(), 1.0).otherwise(0.0)).alias("leaf_share"),
    )
    flat_root = (F.col("children") >= ROOT_CHILDREN) & (F.col("leaf_share") >= ROOT_LEAF_SHARE)
    return scored.filter(
        (F.col("children") >= threshold)
        & (F.col("leaf_share") >= COLLECTION_LEAF_SHARE)
        & ((F.col("depth") > 0) | flat_root)
    )


def url_patterns(urls: DataFrame, threshold: int = COLLECTION_CHILDREN, root_leaf_mode: str = "as_coded") -> DataFrame:
    """``(url, pattern)``: collection members become ``:item``."""
    found = collections(path_children(urls), threshold, root_leaf_mode).select(F.col("prefix").alias("_prefix"))
    web = urls.select("url").dropDuplicates()
    shaped = web.filter(U.is_web(F.col("url"))).select(
        "url", U.host(F.col("url")).alias("host"), U.classed_segments(F.col("url")).alias("segs")
    )
    # decide once per distinct (host, segments), not once per URL
    kinds = shaped.select("host", "segs").dropDuplicates()
    parts = kinds.select("host", "segs", F.posexplode_outer("segs").alias("pos", "seg"))
    prefix = F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("segs", F.lit(1), F.coalesce("pos", F.lit(0))), "/"))
    marked = parts.withColumn("_key", prefix).join(found, F.col("_key") == F.col("_prefix"), "left")
    seg = F.when(F.col("seg").startswith(":") | F.col("_prefix").isNull(), F.col("seg")).otherwise(F.lit(":item"))
    rebuilt = marked.groupBy("host", "segs").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(F.col("pos"), seg.alias("seg"))))).alias("items")
    )
    stems = rebuilt.select("host", "segs", _prefix(F.col("host"), F.col("items.seg")).alias("stem"))
    patterned = shaped.join(stems, ["host", "segs"]).select(
        "url", F.concat(F.col("stem"), U.query_suffix(F.col("url"))).alias("pattern")
    )
    return patterned.unionByName(web.filter(~F.coalesce(U.is_web(F.col("url")), F.lit(False))).select("url", F.col("url").alias("pattern")))


def pattern_groups(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pages with their group key ``site::pattern``."""
    joined = pages.join(patterns, "url", "left")
    pattern = F.coalesce(F.col("pattern"), U.shape(F.col("url")))
    return joined.withColumn("pattern", pattern).withColumn("group_key", F.concat_ws("::", "site_id", "pattern"))


def cap_per_site(pages: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` pages of every site by (depth, url): the trial-run cap (M6)."""
    order = Window.partitionBy("site_id").orderBy("depth", "url")
    return pages.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")
