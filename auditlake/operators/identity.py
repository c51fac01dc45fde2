"""Which tokens are structural, page fingerprints, component signatures.

Token sets can run to millions on a large corpus, so they are never turned into
literals or arrays: tokens are exploded, semi-joined with the stable set and
regrouped, and the work is done once per *distinct* chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims.rules import CHAIN_VENDORS
from ..functions.identity import is_bare_word, is_junk, looks_hashed, signature_usable_id, syntactically_stable
from ..functions.text import half_up

# Thresholds.
MIN_PAGES = 2
MIN_BARE_COVERAGE = 0.4
MIN_ID_COVERAGE = 0.3
ID_CHARS = 60
HOSTILE_RATIO = 0.5
VENDOR_PREFIX = "terze-parti:"
CONSENT_PREFIX = "banner-consenso > "
WRAPPERS = ["div", "span", "section"]
CHAIN_DDL = (
    "struct<chain:array<struct<tag:string,classes:array<string>,id:string,role:string,testAttr:string,landmark:boolean>>,vendor:string>"
)


def token_registry(page_tokens: DataFrame, key: str = "url") -> DataFrame:
    """Distinct pages per token: ``(token, pages)``."""
    return page_tokens.select(key, "token").dropDuplicates().groupBy("token").agg(F.count("*").alias("pages"))


def stable_classes(registry: DataFrame, sampled_pages: Column, accept_below: int = 0) -> DataFrame:
    """Tokens of the registry fit for signatures (D4); a caller may waive frequency below ``accept_below`` pages (3 is usual)."""
    token, n = F.col("token"), sampled_pages
    frequent = (
        F.when(n < accept_below, F.lit(True))
        .when(is_bare_word(token), ~looks_hashed(token) & (F.col("pages") / n >= MIN_BARE_COVERAGE))
        .otherwise(F.col("pages") >= MIN_PAGES)
    )
    return registry.filter(syntactically_stable(token) & frequent)


def stable_ids(registry: DataFrame, sampled_pages: Column, min_coverage: float = MIN_ID_COVERAGE, accept_below: int = 0) -> DataFrame:
    """Ids that recur enough to name a slot (D5); a caller may waive coverage below ``accept_below`` pages (4 is usual)."""
    token, n = F.col("token"), sampled_pages
    fit = (token != "") & (F.length(token) <= ID_CHARS) & ~is_junk(token)
    return registry.filter(fit & ((n < accept_below) | (F.col("pages") / n >= min_coverage)))


def generated_ratio(registry: DataFrame, stable: DataFrame) -> DataFrame:
    """One row ``(tokens, unstable, ratio)`` (D6); with ``hostile`` set past one half."""
    marked = registry.join(stable.select("token", F.lit(1).alias("_s")), "token", "left")
    out = marked.agg(F.count("*").alias("tokens"), F.count_if(F.col("_s").isNull()).alias("unstable"))
    ratio = F.when(F.col("tokens") > 0, half_up(F.col("unstable") / F.col("tokens"), 2)).otherwise(F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("hostile", F.col("ratio") > HOSTILE_RATIO)


def _bucket(n: Column) -> Column:
    return F.when(n == 0, F.lit("0")).when(n <= 3, F.lit("pochi")).otherwise(F.lit("molti"))


def shape_key() -> Column:
    """Coarse shape from the counts of C4."""
    return F.concat(
        F.lit("f"), _bucket(F.col("forms")), F.lit(",t"), _bucket(F.col("tables")), F.lit(",l"), _bucket(F.col("lists")),
        F.when(F.col("has_sidebar"), F.lit(",sb")).otherwise(F.lit(",nosb")),
    )


def page_fingerprints(material: DataFrame, stable: DataFrame) -> DataFrame:
    """Structural fingerprint per page (D7) and its inferred label.

    ``material(url, body_classes, landmarks, skeleton, forms, tables, lists,
    articles, has_sidebar)``. An empty stable set accepts every syntactically
    stable class.
    """
    nodes = material.select(
        "url",
        F.posexplode(
            F.concat(
                F.array(F.struct(F.lit(-1).alias("depth"), F.lit("body").alias("tag"), F.col("body_classes").alias("classes"))),
                F.col("skeleton"),
            )
        ).alias("pos", "n"),
    )
    tokens = nodes.select("url", "pos", F.explode("n.classes").alias("token")).filter(syntactically_stable(F.col("token")))
    no_registry = stable.limit(1).agg(F.count("*")).scalar() == 0
    kept = (
        tokens.join(stable.select("token", F.lit(True).alias("_s")), "token", "left")
        .filter(F.col("_s").isNotNull() | no_registry)
        .groupBy("url", "pos")
        .agg(F.array_sort(F.collect_list("token")).alias("kept"))
    )
    marks = kept.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("pos", "kept"))).alias("kept"))
    joined = material.join(marks, "url", "left")

    def token_at(pos: Column) -> Column:
        return F.element_at("kept", pos)

    drawn = F.transform(
        "skeleton",
        lambda n, i: F.concat(
            F.repeat(F.lit("."), n["depth"]),
            n["tag"],
            F.coalesce(F.concat(F.lit("#"), F.get(token_at(i + 1), 0)), F.lit("")),
        ),
    )
    body = F.coalesce(token_at(F.lit(0)), F.array().cast("array<string>"))
    drawn_all = joined.select("*", body.alias("_body"), F.array_join(drawn, "|").alias("skeleton_text"), shape_key().alias("_shape"))
    source = F.concat_ws("||", F.array_join("_body", " "), F.array_join("landmarks", ">"), "_shape", "skeleton_text")
    return drawn_all.select(
        "url",
        F.left(F.sha1(source), F.lit(12)).alias("fingerprint"),
        inferred_label(F.col("_body")).alias("inferred_label"),
        F.col("_body").alias("body_classes"),
        "landmarks",
        F.col("skeleton_text").alias("skeleton"),
    )


# Body-class hints, in order: pattern and label ({1}, {2} are groups).
LABEL_HINTS = [
    (r"^(path-)?front(page)?$", "Homepage"),
    (r"node-?-?type-?-?([a-z]+)", "Scheda {1}"),
    (r"page-node-type-([a-z]+)", "Scheda {1}"),
    (r"^page-([a-z]+)$", "Pagina {1}"),
    (r"^(single|post-type)-([a-z]+)$", "Scheda {2}"),
    (r"search", "Risultati di ricerca"),
    (r"archive|listing|views", "Elenco"),
    (r"taxonomy|category|term", "Categoria"),
    (r"contact", "Contatti"),
]


def _hint(cls: Column) -> Column:
    """Label of the first matching hint for one class, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(LABEL_HINTS):
        if "{" in label:
            group = int(label[label.index("{") + 1])
            text = F.concat(F.lit(label.split("{")[0]), F.regexp_extract(cls, pattern, group))
        else:
            text = F.lit(label)
        out = F.when(cls.rlike(pattern), F.trim(text)).otherwise(out)
    return out


def inferred_label(body_classes: Column) -> Column:
    """Template label from body classes, else from the page shape."""
    from_class = F.get(F.filter(F.transform(body_classes, _hint), lambda x: x.isNotNull()), 0)
    from_shape = (
        F.when(F.col("tables") >= 1, F.lit("Pagina con tabelle"))
        .when((F.col("articles") >= 3) | (F.col("lists") >= 4), F.lit("Elenco"))
        .when((F.col("forms") >= 1) & (F.col("articles") == 0), F.lit("Pagina con form"))
        .when(F.array_contains("landmarks", "main") & F.col("has_sidebar"), F.lit("Contenuto con sidebar"))
        .otherwise(F.lit("Pagina di contenuto"))
    )
    return F.coalesce(from_class, from_shape)


# ---------------------------------------------------------------- signatures


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda token: token.rlike(pattern)


def chain_vendor(chain: Column) -> Column:
    """Vendor recognised from class and id tokens, inner nodes first."""

    def of_node(n: Column) -> Column:
        tokens = F.concat(F.coalesce(n["classes"], F.array().cast("array<string>")), F.filter(F.array(n["id"]), lambda x: x.isNotNull() & (x != "")))
        return F.coalesce(*[F.when(F.exists(tokens, _matches(p)), F.lit(v)) for v, p in CHAIN_VENDORS])

    return F.get(F.filter(F.transform(chain, of_node), lambda v: v.isNotNull()), 0)


def component_signatures(inputs: DataFrame, stable: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(signature_input, signature)`` for the distinct chains among ``inputs(signature_input)``.

    Text that is not a recorded chain passes through. ``ids=None`` means no id
    registry: any usable id counts.
    """
    distinct = inputs.select("signature_input").filter(F.col("signature_input").isNotNull()).dropDuplicates()
    parsed = F.when(F.col("signature_input").startswith("{"), F.from_json("signature_input", CHAIN_DDL))
    chains = distinct.select("signature_input", F.md5("signature_input").alias("k"), parsed.alias("s"))
    recorded = chains.filter(F.col("s.chain").isNotNull())
    nodes = recorded.select("k", F.posexplode("s.chain").alias("pos", "n"))

    first_class = (
        nodes.select("k", "pos", F.posexplode("n.classes").alias("cpos", "token"))
        .join(stable.select("token"), "token", "left_semi")
        .groupBy("k", "pos")
        .agg(F.min_by("token", "cpos").alias("cls"))
    )
    usable = nodes.filter(signature_usable_id(F.col("n.id"))).select("k", "pos", F.col("n.id").alias("token"))
    if ids is not None:
        usable = usable.join(ids.select("token"), "token", "left_semi")
    marks = (
        first_class.select("k", "pos", "cls", F.lit(None).cast("string").alias("id"))
        .unionByName(usable.select("k", "pos", F.lit(None).cast("string").alias("cls"), F.col("token").alias("id")))
        .groupBy("k", "pos")
        .agg(F.max("cls").alias("cls"), F.max("id").alias("id"))
        # a chain has at most nine nodes, so this list is short
        .groupBy("k")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("cls", "id")))).alias("marks"))
    )
    joined = chains.join(marks, "k", "left")

    def describe(n: Column, i: Column) -> Column:
        mark = F.element_at("marks", i)
        tag = F.lower(n["tag"])
        return (
            F.when(F.coalesce(n["testAttr"], F.lit("")) != "", F.concat(tag, F.lit("["), n["testAttr"], F.lit("]")))
            .when(mark["id"].isNotNull(), F.concat(tag, F.lit("#"), mark["id"]))
            .when(mark["cls"].isNotNull(), F.concat(tag, F.lit("."), mark["cls"]))
            .when(F.coalesce(n["role"], F.lit("")) != "", F.concat(tag, F.lit("["), n["role"], F.lit("]")))
            .otherwise(tag)
        )

    described = joined.withColumn("parts", F.transform("s.chain", describe)).withColumn(
        "top", F.coalesce(F.element_at("s.chain", F.when(F.size("s.chain") > 0, F.lit(-1)))["landmark"], F.lit(False))
    )
    inner = F.when(F.col("top"), F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts"))
    kept = F.filter(inner, lambda d, i: (i == 0) | ~d.isin(WRAPPERS))
    landmark = F.when(F.col("top"), F.element_at("parts", -1)).otherwise(F.lit("body"))
    composed = F.concat(landmark, F.lit(" > "), F.array_join(F.reverse(kept), " > "))
    vendor = F.coalesce(F.when(F.col("s.vendor") != "", F.col("s.vendor")), chain_vendor(F.col("s.chain")))
    signature = (
        F.when(F.col("s.chain").isNull(), F.col("signature_input"))
        .when(vendor.isNotNull(), F.concat(F.lit(VENDOR_PREFIX), vendor))
        .when(F.size("s.chain") == 0, F.lit("unknown"))
        .otherwise(composed)
    )
    return described.select("signature_input", signature.alias("signature"))


def rederive(composed: Column, drop_class=lambda c: is_bare_word(c) & looks_hashed(c)) -> Column:
    """A composed signature with rejected classes and anonymous wrappers removed."""
    consent = composed.startswith(CONSENT_PREFIX)
    prefix = F.when(consent, F.lit(CONSENT_PREFIX)).otherwise(F.lit(""))
    parts = F.split(F.when(consent, F.substr(composed, F.lit(len(CONSENT_PREFIX) + 1))).otherwise(composed), " > ")

    def strip(d: Column) -> Column:
        cls = F.regexp_extract(d, r"^[^.#\[]+\.(.+)$", 1)
        return F.when((cls != "") & drop_class(cls), F.regexp_extract(d, r"^([^.#\[]+)\.", 1)).otherwise(d)

    stripped = F.transform(parts, strip)
    last = F.size(parts) - 1
    kept = F.filter(stripped, lambda d, i: (i == 0) | (i == last) | ~d.isin(WRAPPERS))
    return (
        F.when((composed == "") | composed.startswith(VENDOR_PREFIX) | (F.size(parts) < 2), composed)
        .otherwise(F.concat(prefix, F.array_join(kept, " > ")))
    )
