"""Observations to evidence: ids, sources, signatures, rule-engine rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .identity import CONSENT_PREFIX, component_signatures

# Limits, prefixes and impact defaults.
SALTS = 8
COMMON = 1000
CONSENT_MARK = "__consentBanner"
CONSENT_TEXT = "[banner di consenso] "
OVERLAP = r"(?i)overlap(ped|s)\b"
UNDECIDED_SUFFIX = " (esito incerto: da guardare a mano)."

NODE_DDL = (
    "struct<html:string,target:string,failure_summary:string,component_signature:string,"
    "any:array<struct<id:string,message:string,data:string>>>"
)
RULE_RESULT_DDL = (
    "page_url string, outcome string, rule_id string, impact string, help string, description string, "
    f"help_url string, tags array<string>, nodes array<{NODE_DDL}>"
)


def evidence_id(site_id: Column, url: Column, check_id: Column, selector: Column, observation: Column) -> Column:
    """16 hex digits over site, page, check, selector and the whole text (H1)."""
    return F.left(F.sha1(F.concat_ws("|", site_id, url, check_id, selector, observation)), F.lit(16))


def evidence_source(check_id: Column) -> Column:
    """Which instrument a check belongs to, by prefix (H2)."""
    return (
        F.when(check_id.startswith("axe"), F.lit("axe-core"))
        .when(check_id.startswith("keyboard") | check_id.startswith("focus"), F.lit("keyboard-walk"))
        .when(check_id.startswith("img") | check_id.startswith("bg-"), F.lit("media"))
        .when(check_id.startswith("link-"), F.lit("links"))
        .when(check_id.startswith("form-"), F.lit("forms"))
        .when(check_id.startswith("contrast-"), F.lit("contrast-states"))
        .when(check_id.startswith("reflow") | check_id.startswith("text-spacing"), F.lit("reflow"))
        .otherwise(F.lit("structure"))
    )


def is_consent_marked(data: Column) -> Column:
    return F.coalesce(F.get_json_object(data, f"$.{CONSENT_MARK}") == "true", F.lit(False))


def resolve_signatures(rows: DataFrame, stable: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Add ``component_signature`` computed from ``signature_input``; consent rows get their prefix."""
    prefix = F.when(is_consent_marked(F.col("data")), F.lit(CONSENT_PREFIX)).otherwise(F.lit(""))
    # rows without a chain (nulls, "document", "unknown") need no lookup and would meet on one key
    has_chain = F.coalesce(F.col("signature_input").startswith("{"), F.lit(False))
    # texts stay out of the join: a chain is met by its digest
    chained = rows.filter(has_chain).withColumn("_k", F.md5("signature_input"))
    # one chain may own a share of all rows: those with over a thousandth of them, fewer than a thousand, serve as several join keys
    share = chained.agg(F.count("*") / F.lit(COMMON)).scalar()
    common = F.broadcast(chained.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select("_k", F.lit(True).alias("_common")))
    copies = F.when(F.col("_common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(F.col("_common"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    signatures = component_signatures(chained, stable, ids).select(F.md5("signature_input").alias("_k"), "signature")
    computed = signatures.join(common, "_k", "left").select("_k", "signature", F.explode(copies).alias("_salt"))
    salted = chained.join(common, "_k", "left").withColumn("_salt", own).drop("_common")
    found = salted.join(computed, ["_k", "_salt"], "left").drop("_k", "_salt")
    plain = rows.filter(~has_chain).withColumn("signature", F.lit(None).cast("string"))
    return found.unionByName(plain).withColumn("component_signature", F.concat(prefix, F.coalesce("signature", "signature_input"))).drop("signature")


def to_evidence(observations: DataFrame, pages: DataFrame, stable: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Observation rows with their page's site and template (H3).

    ``pages(url, site_id, fingerprint)``. The raw chain stays beside the
    resolved signature, so signatures can be recomputed later.
    """
    rows = observations.withColumnRenamed("component_signature", "signature_input")
    if stable is None:
        rows = rows.withColumn("component_signature", F.col("signature_input"))
    else:
        rows = resolve_signatures(rows, stable, ids)
    joined = rows.join(pages.select("url", "site_id", "fingerprint"), "url")
    return joined.select(
        evidence_id(F.col("site_id"), F.col("url"), F.col("check_id"), F.col("selector"), F.col("observation")).alias("id"),
        evidence_source(F.col("check_id")).alias("source"),
        "check_id",
        F.col("url").alias("page_url"),
        "site_id",
        "fingerprint",
        "criteria",
        "selector",
        "component_signature",
        "signature_input",
        "html",
        "observation",
        "data",
        "engine_impact",
        "ordinal",
    )


def tag_criteria(tags: Column) -> Column:
    """Criterion numbers among rule tags: ``wcag143`` is 1.4.3, ``wcag1410`` is 1.4.10."""
    own = F.filter(tags, lambda t: t.rlike(r"^wcag\d{3,4}$"))
    return F.array_distinct(F.transform(own, lambda t: F.regexp_replace(t, r"^wcag(\d)(\d)(\d+)$", "$1.$2.$3")))


def rules_to_criteria(results: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add ``criteria``: from the tags, else from the override table, else empty (H7)."""
    table = dims.or_own(overrides, dims.rule_criteria(results.sparkSession))
    tagged = results.withColumn("_tagged", tag_criteria(F.col("tags"))).join(table, "rule_id", "left")
    none = F.array().cast("array<string>")
    return tagged.withColumn(
        "criteria", F.when(F.size("_tagged") > 0, F.col("_tagged")).otherwise(F.coalesce("rule_criteria", none))
    ).drop("_tagged", "rule_criteria")


# Fixed values in the keys (rule ids); the wording is ours (H9).
RULE_TEXT = {
    "html-has-lang": "La pagina non dichiara la lingua.",
    "html-lang-valid": "La lingua dichiarata non esiste.",
    "image-alt": "La figura non ha alt.",
    "link-name": "Il collegamento non ha nome.",
    "button-name": "Il pulsante non ha nome.",
    "label": "Il campo non ha etichetta.",
    "select-name": "La tendina non ha nome.",
    "document-title": "Il documento non ha titolo.",
    "heading-order": "Il livello del titolo non segue il precedente.",
    "landmark-one-main": "Manca un'area principale.",
    "region": "Il contenuto sta fuori dalle aree.",
    "bypass": "Manca il salto dei blocchi ripetuti.",
    "frame-title": "Il riquadro non ha titolo.",
    "meta-viewport": "L'ingrandimento è limitato.",
    "list": "L'elenco ha figli che non sono voci.",
    "listitem": "La voce sta fuori da un elenco.",
    "nested-interactive": "Un comando ne contiene un altro.",
    "aria-hidden-focus": "Elemento nascosto che riceve il focus.",
    "input-image-alt": "Il pulsante figura non ha alt.",
    "svg-img-alt": "La figura non ha nome.",
    "role-img-alt": "La figura non ha nome.",
    "meta-refresh": "La pagina si ricarica da sola.",
}
CONTRAST_RULES = ["color-contrast", "color-contrast-enhanced"]
DUPLICATE_RULES = ["duplicate-id", "duplicate-id-active", "duplicate-id-aria"]


def rule_observation(rule_id: Column, help_text: Column, checks: Column, fallback: Column) -> Column:
    """Text of one rule-engine row from its measured values, never with holes in it (H9)."""
    data = F.get(checks, 0)["data"]

    def value(name: str) -> Column:
        found = F.get_json_object(data, f"$.{name}")
        return F.when((found != "") & (found != "0") & (found != "false"), found)

    extra = F.concat(
        F.coalesce(F.concat(F.lit(", "), value("fontSize")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), F.when(value("fontWeight") != "normal", value("fontWeight"))), F.lit("")),
    )
    contrast = F.coalesce(
        F.concat(
            F.lit("Contrasto "), value("contrastRatio"), F.lit(":1 fra testo "), value("fgColor"), F.lit(" e sfondo "), value("bgColor"),
            extra, F.lit("; soglia "), F.coalesce(value("expectedContrastRatio"), F.lit("4.5:1")), F.lit("."),
        ),
        F.lit("Contrasto non misurabile in automatico: va guardato a mano."),
    )
    size = F.coalesce(
        F.concat(F.lit("L'area misura "), value("width"), F.lit("x"), value("height"), F.lit(" pixel, meno di 24x24.")),
        F.lit("L'area è sotto i 24x24 pixel."),
    )
    duplicate = F.concat(F.lit('L\'id "'), F.coalesce(value("id"), F.lit("")), F.lit('" è ripetuto.'))
    fixed = F.coalesce(*[F.when(rule_id == k, F.lit(v)) for k, v in RULE_TEXT.items()])
    return (
        F.when(rule_id.isin(CONTRAST_RULES), contrast)
        .when(rule_id.isin(DUPLICATE_RULES), duplicate)
        .when(rule_id == "target-size", size)
        .otherwise(F.coalesce(fixed, F.when(fallback != "", fallback), help_text))
    )


def blocked_by_overlap(checks: Column) -> Column:
    """Some message says another layer hid the text (H6); null and empty lists say nothing."""
    return F.coalesce(F.exists(checks, lambda c: F.coalesce(c["message"].rlike(OVERLAP), F.lit(False))), F.lit(False))


def rule_observations(results: DataFrame, overrides: DataFrame | None = None, undecided: int | None = None) -> DataFrame:
    """Rule-engine log to observation rows.

    ``results`` has the columns of ``RULE_RESULT_DDL``. A caller may count the
    first ``undecided`` nodes of an undecided rule on a page only (5 is usual);
    the overlap filter comes after that cut.
    """
    rows = rules_to_criteria(results, overrides)
    failed = F.col("outcome") == "violation"
    nodes = F.col("nodes") if undecided is None else F.when(failed, F.col("nodes")).otherwise(F.slice("nodes", 1, undecided))
    flat = rows.select("*", F.posexplode(nodes).alias("ordinal", "node")).withColumnRenamed("page_url", "url")
    kept = flat.filter(failed | (F.col("rule_id") != "color-contrast") | ~blocked_by_overlap(F.col("node.any")))
    checks = F.col("node.any")
    summary = F.trim(F.regexp_replace(F.coalesce("node.failure_summary", F.lit("")), r"\n+", " "))
    told = F.when(failed, F.trim(F.concat(F.col("help"), F.lit(". "), summary))).otherwise(F.col("help"))
    text = rule_observation(F.col("rule_id"), F.col("help"), checks, told)
    # check data is JSON text in the log: keep it nested, not quoted
    parsed = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                F.coalesce(checks, F.array().cast("array<struct<id:string,message:string,data:string>>")),
                lambda c: F.concat(
                    F.lit("{\"id\":"), F.coalesce(_quote(c["id"]), F.lit("null")), F.lit(",\"message\":"), F.coalesce(_quote(c["message"]), F.lit("null")),
                    F.lit(",\"data\":"), F.coalesce(c["data"], F.lit("null")), F.lit("}"),
                ),
            ),
            ",",
        ),
        F.lit("]"),
    )
    head = F.to_json(
        F.struct(
            F.col("rule_id").alias("axeRule"),
            F.when(failed, F.col("description")).alias("axeDescription"),
            F.when(failed, F.col("node.failure_summary")).alias("axeFailureSummary"),
            F.col("help_url").alias("helpUrl"),
            F.col("outcome").alias("axeResult"),
        )
    )
    data = F.concat(F.left(head, F.length(head) - 1), F.lit(',"checks":'), parsed, F.lit("}"))
    return kept.select(
        "url",
        F.col("ordinal").cast("int").alias("ordinal"),
        F.concat(F.when(failed, F.lit("axe:")).otherwise(F.lit("axe-incomplete:")), "rule_id").alias("check_id"),
        "criteria",
        F.coalesce("impact", F.when(failed, F.lit("moderate")).otherwise(F.lit("minor"))).alias("engine_impact"),
        F.col("node.target").alias("selector"),
        F.coalesce("node.component_signature", F.lit("unknown")).alias("component_signature"),
        F.coalesce("node.html", F.lit("")).alias("html"),
        F.when(failed, text).otherwise(F.concat(text, F.lit(UNDECIDED_SUFFIX))).alias("observation"),
        data.alias("data"),
    )


def _quote(text: Column) -> Column:
    """JSON string literal of a text column."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def mark_consent(observations: DataFrame, banners: DataFrame) -> DataFrame:
    """Rows measured inside a consent banner carry a mark and a text prefix.

    ``banners(url, ordinal, last)``: the banner's element and the last one inside
    it, one banner a page; ``observations`` keep their own ``ordinal``.
    """
    scope = banners.select("url", F.col("ordinal").alias("_from"), F.col("last").alias("_to"))
    placed = observations.join(scope, "url", "left")
    inside = F.coalesce(F.col("ordinal").between(F.col("_from"), F.col("_to")), F.lit(False))
    body = F.substr("data", F.lit(2))
    mark = F.when(F.trim("data") == "{}", F.lit(f'{{"{CONSENT_MARK}":true}}')).otherwise(
        F.concat(F.lit(f'{{"{CONSENT_MARK}":true,'), body)
    )
    return placed.select(
        *[c for c in observations.columns if c not in ("data", "observation")],
        F.when(inside, mark).otherwise(F.col("data")).alias("data"),
        F.when(inside, F.concat(F.lit(CONSENT_TEXT), "observation")).otherwise(F.col("observation")).alias("observation"),
    )


def screenshot_requests(evidence: DataFrame, per_page: int | None = None) -> DataFrame:
    """Elements worth a picture: grave, locatable, one per component (H11); a caller may take ``per_page`` (12 is usual)."""
    grave = evidence.filter(F.col("engine_impact").isin("critical", "serious") & ~F.coalesce("selector", F.lit("")).isin("", "body"))
    order = ["ordinal", "check_id", "id"]
    one = Window.partitionBy("page_url", "component_signature").orderBy(*order)
    few = Window.partitionBy("page_url").orderBy(*order)
    first = grave.withColumn("_rn", F.row_number().over(one)).filter(F.col("_rn") == 1)
    if per_page is not None:
        first = first.withColumn("_rn", F.row_number().over(few)).filter(F.col("_rn") <= per_page)
    return first.select("id", "site_id", "page_url", "component_signature", "selector", F.concat("site_id", F.lit("/"), "id", F.lit(".png")).alias("path"))


def rule_tally(results: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """Undecided nodes per page, counted before any cut, and the rules passed."""
    nodes = F.when(F.col("outcome") == "incomplete", F.greatest(F.size("nodes"), F.lit(0))).otherwise(F.lit(0))
    out = results.groupBy(F.col("page_url").alias("url")).agg(F.sum(nodes).alias("incomplete_count"))
    if passes is None:
        return out
    # the rule catalogue is closed, so the set per page is small
    passed = passes.groupBy(F.col("page_url").alias("url")).agg(F.array_sort(F.collect_set("rule_id")).alias("passed_rules"))
    return out.join(passed, "url", "full_outer").select("url", F.coalesce("incomplete_count", F.lit(0)).alias("incomplete_count"), "passed_rules")
