"""Element rows to page structure: landmarks, skeleton, shape, token inventory, names, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.identity import page_usable_id, syntactically_stable

# Landmark selectors and limits.
LANDMARK_TAGS = ["header", "nav", "main", "aside", "footer", "form"]
LANDMARK_ROLES = ["banner", "navigation", "main", "complementary", "contentinfo", "search", "form"]
SKELETON_DEPTH = 4


def attr(name: str) -> Column:
    return F.col("attrs").getItem(name)


def is_landmark() -> Column:
    named = (F.col("tag") == "section") & (attr("aria-label").isNotNull() | attr("aria-labelledby").isNotNull())
    return F.col("tag").isin(LANDMARK_TAGS) | named | F.coalesce(attr("role").isin(LANDMARK_ROLES), F.lit(False))


def landmarks(elements: DataFrame, key: str = "url") -> DataFrame:
    """Landmark values in document order, one array per page."""
    value = F.lower(F.coalesce(F.when(attr("role") != "", attr("role")), F.col("tag")))
    rows = elements.filter(is_landmark()).select(key, "ordinal", value.alias("landmark"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "landmark")))
    return rows.groupBy(key).agg(ordered.getField("landmark").alias("landmarks"))


def skeleton(elements: DataFrame) -> DataFrame:
    """``(url, skeleton array<struct<depth,tag,classes>>)`` of the main area, else of the body."""
    is_main = (F.col("tag") == "main") | F.coalesce(attr("role") == "main", F.lit(False))
    rank = F.when(is_main, F.lit(0)).otherwise(F.lit(1))
    roots = (
        elements.filter(is_main | (F.col("tag") == "body"))
        .groupBy("url")
        .agg(F.min(F.struct(rank.alias("rank"), "ordinal", "last", "depth")).alias("root"))
    )
    inside = (F.col("ordinal") > F.col("root.ordinal")) & (F.col("ordinal") <= F.col("root.last"))
    rel = F.col("depth") - F.col("root.depth") - 1
    nodes = (
        elements.filter(~F.col("skipped"))
        .join(roots, "url")
        .filter(inside & (rel <= SKELETON_DEPTH))
        .select("url", "ordinal", rel.alias("depth"), "tag", class_list().alias("classes"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "depth", "tag", "classes")))
    return nodes.groupBy("url").agg(
        F.transform(ordered, lambda n: F.struct(n["depth"].alias("depth"), n["tag"].alias("tag"), n["classes"].alias("classes"))).alias("skeleton")
    )


def class_list() -> Column:
    """Distinct class words in source order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), lambda c: c != ""))


def shape_counts(elements: DataFrame, key: str = "url") -> DataFrame:
    """Forms, tables, h1-h3, images, lists, articles, sidebar (C4)."""

    def n(*tags: str) -> Column:
        return F.count_if(F.col("tag").isin(*tags))

    aside = (F.col("tag") == "aside") | F.coalesce(attr("role") == "complementary", F.lit(False))
    return elements.groupBy(key).agg(
        n("form").alias("forms"),
        n("table").alias("tables"),
        n("h1", "h2", "h3").alias("headings"),
        n("img").alias("images"),
        n("ul", "ol").alias("lists"),
        n("article").alias("articles"),
        F.bool_or(aside).alias("has_sidebar"),
    )


def class_inventory(elements: DataFrame, key: str = "url") -> DataFrame:
    """Distinct ``(page, token)`` over all classed elements."""
    classed = elements.filter(attr("class").isNotNull())
    return classed.select(key, F.explode(class_list()).alias("token")).dropDuplicates()


def id_inventory(elements: DataFrame, key: str = "url") -> DataFrame:
    """Distinct ``(page, token)`` over all elements carrying an id."""
    return elements.filter(attr("id") != "").select(key, attr("id").alias("token")).dropDuplicates()


def alternates(elements: DataFrame) -> DataFrame:
    """Declared translations ``(url, alt_url)``: ``x-default`` tested on the href."""
    rel = F.array_contains(F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+"), "alternate")
    links = elements.filter((F.col("tag") == "link") & rel & attr("hreflang").isNotNull() & attr("href").isNotNull())
    resolved = links.select("url", "ordinal", U.canonical(attr("href"), F.col("url")).alias("alt_url"))
    return resolved.filter(F.col("alt_url").isNotNull() & ~F.col("alt_url").rlike("(?i)x-default")).select("url", "alt_url")


def nearest(*tags: str) -> Column:
    """Ordinal of the closest self-or-ancestor with one of the tags, from the context column."""
    hits = F.filter("context", lambda c: c["tag"].isin(*tags))
    return F.get(hits, 0)["ordinal"]


def accessible_names(elements: DataFrame, of: Column) -> DataFrame:
    """Approximate accessible name of the elements matching ``of`` (C7): adds ``name``.

    Labels are found by equi-joins on (url, id), (url, for) and (url, wrapping
    label); only elements that need one take part.
    """
    targets = elements.filter(of)
    is_field = F.col("tag").isin("input", "select", "textarea")
    by_id = (
        elements.filter(attr("id").isNotNull() & (attr("id") != ""))
        .groupBy("url", attr("id").alias("_id"))
        .agg(F.min_by("text", "ordinal").alias("_id_text"))
    )
    refs = targets.filter(attr("aria-labelledby").isNotNull()).select(
        "url", "ordinal", F.posexplode(F.split(attr("aria-labelledby"), r"\s+")).alias("_pos", "_id")
    )
    labelled = (
        refs.join(by_id, ["url", "_id"], "left")
        .groupBy("url", "ordinal")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_id_text", F.lit("")).alias("t")))).getField("t").alias("_ts"))
        .select("url", "ordinal", F.trim(F.array_join("_ts", " ")).alias("_labelledby"))
    )
    labels = elements.filter(F.col("tag") == "label")
    by_for = (
        labels.filter(attr("for").isNotNull())
        .groupBy("url", attr("for").alias("_fid"))
        .agg(F.min_by(F.coalesce("text", F.lit("")), "ordinal").alias("_for"))
    )
    wraps = labels.select("url", F.col("ordinal").alias("_wrap_ord"), F.coalesce("text", F.lit("")).alias("_wrap"))
    joined = (
        targets.withColumn("_fid", F.when(is_field & (attr("id") != ""), attr("id")))
        .withColumn("_wrap_ord", F.when(is_field, nearest("label")))
        .join(labelled, ["url", "ordinal"], "left")
        .join(by_for, ["url", "_fid"], "left")
        .join(wraps, ["url", "_wrap_ord"], "left")
    )
    field_name = F.coalesce("_for", "_wrap", F.trim(F.when(attr("title") != "", attr("title"))), F.lit(""))
    own = (
        F.when(is_field, field_name)
        .when(F.col("tag") == "img", F.trim(F.coalesce(attr("alt"), F.lit(""))))
        .otherwise(F.coalesce("text", F.lit("")))
    )
    name = (
        F.when(F.coalesce(attr("aria-label"), F.lit("")) != "", F.trim(attr("aria-label")))
        .when(F.coalesce(F.col("_labelledby"), F.lit("")) != "", F.col("_labelledby"))
        .otherwise(own)
    )
    return joined.withColumn("name", name).drop("_fid", "_wrap_ord", "_labelledby", "_for", "_wrap")


def visible(elements: DataFrame) -> DataFrame:
    """Statically visible elements: neither they nor an ancestor are hidden."""
    return elements.filter("visible")


def css_path(stable_class: Callable[[Column], Column] = syntactically_stable, levels: int | None = None, max_classes: int | None = None) -> Column:
    """Selector from the ``lineage`` column, up to the nearest usable id.

    A caller may shorten it to ``levels`` (6 is usual) and ``max_classes`` a level (2 is usual).
    """
    nodes = F.col("lineage") if levels is None else F.slice("lineage", 1, levels)
    usable = F.transform(nodes, lambda n: F.coalesce(page_usable_id(n["id"]), F.lit(False)))
    stop = F.array_position(usable, True).cast("int")
    kept = F.when(stop > 0, F.slice(nodes, F.lit(1), stop)).otherwise(nodes)

    def describe(n: Column) -> Column:
        classes = F.filter(F.array_distinct(n["classes"]), stable_class)
        classes = classes if max_classes is None else F.slice(classes, 1, max_classes)
        place = F.when(n["same"] > 1, F.concat(F.lit(":nth-of-type("), n["nth"].cast("string"), F.lit(")"))).otherwise(F.lit(""))
        words = F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(classes, "."))).otherwise(F.lit(""))
        by_id = F.coalesce(page_usable_id(n["id"]), F.lit(False))
        return F.when(by_id, F.concat(n["tag"], F.lit("#"), n["id"])).otherwise(F.concat(n["tag"], words, place))

    return F.array_join(F.reverse(F.transform(kept, describe)), " > ")


def signature_input() -> Column:
    """Recorded chain of an element as JSON: up to the landmark inclusive."""
    nodes = F.col("lineage")
    closest = F.array_position(F.transform(nodes, lambda n: n["landmark"]), True).cast("int")
    kept = F.when(closest > 0, F.slice(nodes, F.lit(1), closest)).otherwise(nodes)
    # named_struct, not aliases: those are dropped next to an explode in the same select
    chain = F.transform(
        kept,
        lambda n: F.named_struct(
            F.lit("tag"), n["tag"],
            F.lit("classes"), F.array_distinct(n["classes"]),
            F.lit("id"), n["id"],
            F.lit("role"), n["role"],
            F.lit("testAttr"), n["test_attr"],
            F.lit("landmark"), F.when(n["landmark"], F.lit(True)),
        ),
    )
    return F.to_json(F.named_struct(F.lit("chain"), chain, F.lit("vendor"), F.col("vendor")))


def flat_skeleton(elements: DataFrame, key: str = "url") -> DataFrame:
    """Skeleton from a flat tag stream: everything after the body tag at depth 0, same skips."""
    skip = ["script", "style", "noscript", "svg", "path", "br", "template"]
    body = elements.filter(F.col("tag") == "body").groupBy(key).agg(F.min("ordinal").alias("_body"))
    nodes = elements.filter(~F.col("tag").isin(skip)).join(body, key).filter(F.col("ordinal") > F.col("_body"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "tag", class_list().alias("classes"))))
    return nodes.groupBy(key).agg(
        F.transform(ordered, lambda n: F.struct(F.lit(0).alias("depth"), n["tag"].alias("tag"), n["classes"].alias("classes"))).alias("skeleton")
    )


def page_material(elements: DataFrame, flat: bool = False) -> DataFrame:
    """Everything a fingerprint needs, one row per page (input of D7)."""
    body = elements.filter(F.col("tag") == "body").groupBy("url").agg(F.min_by(class_list(), "ordinal").alias("body_classes"))
    frame = flat_skeleton(elements) if flat else skeleton(elements)
    joined = shape_counts(elements).join(body, "url", "left").join(landmarks(elements), "url", "left").join(frame, "url", "left")
    none = F.array().cast("array<string>")
    no_nodes = F.array().cast("array<struct<depth:int,tag:string,classes:array<string>>>")
    return (
        joined.withColumn("body_classes", F.coalesce("body_classes", none))
        .withColumn("landmarks", F.coalesce("landmarks", none))
        .withColumn("skeleton", F.coalesce("skeleton", no_nodes))
    )
