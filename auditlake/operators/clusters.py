"""Pages to templates, templates to samples, templates to language families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import half_up
from ..lineage import cut, release

# Sampling defaults and labels.
PROBES_PER_GROUP = 2
SAMPLES_PER_TEMPLATE = 3
LANGUAGE_SHARE = 0.6
UNKNOWN = "unknown"
MIXED = "mixed-"
UNKNOWN_LABEL = "Pagine senza tipo"
UNNAMED_LABEL = "Tipo senza nome"
MIXED_SUFFIX = " (strutture diverse)"
GENERIC_LABELS = ["Pagina di contenuto", "Pagina con tabelle", "Pagina con form", "Elenco", "Contenuto con sidebar"]


def representatives(rows: DataFrame, group: str | list[str], n: int | Column) -> DataFrame:
    """The ``n`` shallowest, then shortest URLs of each group.

    A ranked cut: with a constant ``n`` every task keeps at most ``n`` rows per
    group before the shuffle, so a huge group costs no more than a small one.
    """
    keys = [group] if isinstance(group, str) else group
    order = Window.partitionBy(*keys).orderBy(U.path_depth(F.col("url")), F.length("url"), "url")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def probes(pages: DataFrame, per_group: int = PROBES_PER_GROUP) -> DataFrame:
    """Pages to probe per URL-pattern group: at least two (E2). A failed probe is not replaced."""
    return representatives(pages, "group_key", max(per_group, 2))


def usable_probes(probed: DataFrame) -> DataFrame:
    """Probes that stayed on site and answered below 400: ``probed(url, final_url, http_status)``."""
    return probed.filter(U.same_site(F.col("final_url"), F.col("url")) & (F.coalesce("http_status", F.lit(0)) < 400))


def assign_fingerprints(pages: DataFrame, probe_prints: DataFrame) -> DataFrame:
    """Spread probe fingerprints over their groups.

    ``pages(url, group_key, pattern)``, ``probe_prints(url, group_key, fingerprint)``.
    """
    kinds = probe_prints.groupBy("group_key").agg(
        F.countDistinct("fingerprint").alias("kinds"), F.min("fingerprint").alias("only")
    )
    own = probe_prints.select("url", "group_key", F.col("fingerprint").alias("own"))
    joined = pages.join(kinds, "group_key", "left").join(own, ["url", "group_key"], "left")
    # the whole pattern names the group: cut ones would merge groups
    mixed = F.concat(F.lit(MIXED), F.sha1("pattern"))
    fingerprint = (
        F.when(F.col("kinds") == 1, F.col("only"))
        .when(F.col("kinds") > 1, F.coalesce("own", mixed))
        .otherwise(F.lit(UNKNOWN))
    )
    return joined.withColumn("fingerprint", fingerprint).withColumn("heterogeneous", F.coalesce(F.col("kinds") > 1, F.lit(False))).drop(
        "kinds", "only", "own"
    )


def templates(pages: DataFrame) -> DataFrame:
    """Per fingerprint: pages, sites, first member (E5). Members stay in the page table."""
    return pages.groupBy("fingerprint").agg(
        F.count("*").alias("page_count"),
        F.countDistinct("site_id").alias("site_count"),
        F.min("url").alias("first_url"),
    )


def labelled(template_rows: DataFrame, structural: DataFrame) -> DataFrame:
    """Add ``label`` (E6). ``structural(fingerprint, structural_label)``."""
    joined = template_rows.join(structural, "fingerprint", "left")
    from_url = U.readable_label(F.col("first_url"))
    mixed = F.concat(F.coalesce(from_url, F.lit("Gruppo")), F.lit(MIXED_SUFFIX))
    hint = F.when(F.col("fingerprint").startswith(MIXED), mixed).otherwise(F.col("structural_label"))
    label = (
        F.when(F.col("fingerprint") == UNKNOWN, F.lit(UNKNOWN_LABEL))
        .when(hint.isNotNull() & ~hint.isin(GENERIC_LABELS), hint)
        .otherwise(F.coalesce(from_url, hint, F.lit(UNNAMED_LABEL)))
    )
    return joined.withColumn("label", label).drop("structural_label")


def sample_size(
    template_rows: DataFrame,
    per_template: int = SAMPLES_PER_TEMPLATE,
    cap: int | None = None,
    scan_all_under: int = 0,
) -> DataFrame:
    """Add ``sample_size`` (E7): about the square root of a template's pages.

    A caller may cap it (8 is usual) and ask for every page of a run of at most
    ``scan_all_under`` pages (40 is usual); by default runs of all sizes behave
    alike.
    """
    total = template_rows.agg(F.sum("page_count")).scalar()
    n = F.col("page_count")
    uncertain = (F.col("fingerprint") == UNKNOWN) | F.col("fingerprint").startswith(MIXED)
    root = F.ceil(F.sqrt(n.cast("double")))
    root = root if cap is None else F.least(root, F.lit(cap))
    bounded = F.greatest(F.lit(per_template), root) + F.when(uncertain, 1).otherwise(0)
    small = (F.lit(scan_all_under) > 0) & (total <= scan_all_under)
    return template_rows.withColumn("sample_size", F.when(small, n).otherwise(F.least(n, bounded)))


def samples(pages: DataFrame, sized: DataFrame) -> DataFrame:
    """Sampled ``(fingerprint, url)`` per template.

    Two cuts: first by the largest size asked for, which limits every task
    before the shuffle, then by the template's own size on the rows left.
    """
    most = sized.agg(F.max("sample_size")).first()[0] or 0
    few = representatives(pages.select("fingerprint", "url"), "fingerprint", most)
    return representatives(few.join(sized.select("fingerprint", "sample_size"), "fingerprint"), "fingerprint", F.col("sample_size")).select(
        "fingerprint", "url"
    )


def to_measure(pages: DataFrame, sampled: DataFrame) -> DataFrame:
    """Pages whose URL is in some sample."""
    return pages.join(sampled.select("url"), "url", "left_semi")


def dominant_language(pages: DataFrame) -> DataFrame:
    """``(fingerprint, code)`` where one language covers most members.

    The reference order of ties is arrival; ours is the code.
    """
    counted = pages.groupBy("fingerprint", U.language(F.col("url")).alias("code")).agg(F.count("*").alias("n"))
    best = counted.groupBy("fingerprint").agg(
        F.sum("n").alias("all"),
        F.min(F.when(F.col("code").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("code").alias("code")))).alias("best"),
    )
    share = -F.col("best.neg") / F.col("all")
    return best.filter(share > LANGUAGE_SHARE).select("fingerprint", F.col("best.code").alias("code"))


def neutral_shapes(pages: DataFrame) -> DataFrame:
    """``(fingerprint, shape)`` that all members share: depth and first section, language aside."""
    parts = F.filter(F.split(U.neutral_path(F.col("url")), "/"), lambda s: s != "")
    shape = F.concat(F.size(parts).cast("string"), F.lit(":"), F.coalesce(F.get(parts, 1), F.lit("")))
    return (
        pages.select("fingerprint", "url").withColumn("shape", F.when(U.language(F.col("url")).isNotNull(), shape))
        .groupBy("fingerprint")
        .agg(F.countDistinct("shape").alias("k"), F.count_if(F.col("shape").isNull()).alias("gaps"), F.min("shape").alias("shape"))
        .filter((F.col("k") == 1) & (F.col("gaps") == 0))
        .select("fingerprint", "shape")
    )


def variant_edges(languages: DataFrame, shapes: DataFrame, pages: DataFrame | None = None, alternates: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` between templates that are language variants.

    Equal shape: a shape with two languages is one component, so every member is
    linked to one centre instead of to each other. Declared alternates link the
    templates of both URLs when their languages differ.
    """
    shaped = shapes.join(languages, "fingerprint")
    centres = (
        shaped.groupBy("shape")
        .agg(F.countDistinct("code").alias("codes"), F.min("fingerprint").alias("b"))
        .filter(F.col("codes") >= 2)
    )
    edges = shaped.join(centres, "shape").filter(F.col("fingerprint") != F.col("b")).select(F.col("fingerprint").alias("a"), "b")
    if alternates is None:
        return edges
    member = pages.select("url", "fingerprint").join(languages, "fingerprint")
    left = member.select("url", F.col("fingerprint").alias("a"), F.col("code").alias("_ca"))
    right = member.select(F.col("url").alias("alt_url"), F.col("fingerprint").alias("b"), F.col("code").alias("_cb"))
    declared = (
        alternates.join(left, "url")
        .join(right, "alt_url")
        .filter((F.col("a") != F.col("b")) & (F.col("_ca") != F.col("_cb")))
        .select("a", "b")
    )
    return edges.unionByName(declared).dropDuplicates()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40, salts: int = 8) -> DataFrame:
    """``(node, component)`` with the smallest member as component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    node learns the smallest neighbour by a map-side-combined minimum and edges
    are rewired to it, which converges in a logarithmic number of rounds and
    never gathers a neighbourhood. A hub's edges are spread over ``salts`` join
    keys, each with a copy of its smallest neighbour.
    """
    salt = F.pmod(F.xxhash64("v"), F.lit(salts))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        if not large:
            both = both.filter(F.col("v") < F.col("u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.withColumn("_salt", salt.cast("int")).join(low.select("*", copies.alias("_salt")), ["u", "_salt"])
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).dropDuplicates()

    links = cut(edges.select("a", "b").filter(F.col("a") != F.col("b")).dropDuplicates())
    state = None
    for _ in range(max_rounds):
        before, links = links, cut(star(star(links, True), False))
        release(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("component", "node").alias("component"))


def language_roles(template_rows: DataFrame, languages: DataFrame, components: DataFrame) -> DataFrame:
    """``(fingerprint, code, primary_code, is_primary)`` (E15): the language with most pages stays primary."""
    family = languages.join(components.select(F.col("node").alias("fingerprint"), "component"), "fingerprint").join(
        template_rows.select("fingerprint", "page_count"), "fingerprint"
    )
    per_code = family.groupBy("component", "code").agg(F.sum("page_count").alias("n"))
    best = per_code.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("code").alias("code"))).alias("best"))
    return family.join(best, "component").select(
        "fingerprint", "code", F.col("best.code").alias("primary_code"), (F.col("code") == F.col("best.code")).alias("is_primary")
    )


def spot_check(template_rows: DataFrame, roles: DataFrame, spot_samples: int = 1) -> DataFrame:
    """Secondary templates fall to a spot check: smaller sample, marked label."""
    secondary = roles.filter(~F.col("is_primary")).select("fingerprint", F.col("code").alias("_code"))
    joined = template_rows.join(secondary, "fingerprint", "left")
    marked = F.concat("label", F.lit(" ["), F.upper("_code"), F.lit(": controllo a campione]"))
    return (
        joined.withColumn("sample_size", F.when(F.col("_code").isNotNull(), F.least(F.lit(spot_samples), "page_count")).otherwise(F.col("sample_size")))
        .withColumn("label", F.when(F.col("_code").isNotNull(), marked).otherwise(F.col("label")))
        .drop("_code")
    )


def compression(template_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: groups, templates, pages, samples, pages per sample, mixed pages."""
    out = template_rows.agg(
        F.count("*").alias("templates"),
        F.sum("page_count").alias("pages"),
        F.sum("sample_size").alias("samples"),
        F.sum(F.when(F.col("fingerprint").startswith(MIXED), F.col("page_count")).otherwise(F.lit(0))).alias("mixed_pages"),
    )
    return out.select(
        groups.agg(F.countDistinct("group_key")).scalar().alias("groups"),
        "templates", "pages", "samples", "mixed_pages",
        F.when(F.col("samples") > 0, half_up(F.col("pages") / F.col("samples"), 1)).alias("compression"),
    )
