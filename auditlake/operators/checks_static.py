"""Checks decided from markup alone.

Every function takes element rows (tree or flat) and returns observation rows;
``pages(url)`` is needed where the absence of an element is the finding.

All families are one pass: elements that matter are gathered once per page, what
a check needs from elsewhere in the page (the heading before, the text of the
link around a picture, a field's label) is looked up in the page's own row, and
one projection makes the observations of the rows that come out of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import urls as U
from ..functions.text import bind, snippet
from .observations import hit, page_level, union
from .structure import attr, css_path, signature_input

# Vocabularies and limits.
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: tags the checks report on: the ``detail`` a tree needs for them
CHECK_TAGS = {*HEADINGS, "main", "nav", "a", "img", "input", "select", "textarea"}
SKIP_TEXT = r"salta|skip|vai al contenuto|contenuto principale"
GENERIC_LINK = (
    r"(?i)^(leggi (tutto|di piu.?|l.articolo)|continua|clicca (qui|qua)|qui|qua|questo link|link|scopri( di piu.?)?|vai|dettagli"
    r"|approfondisci|read more|more|click here|here|download|scarica)[\s.!:]*$"
)
NEW_WINDOW = r"(?i)nuova finestra|nuova scheda|new window|new tab|si apre in"
PLACEHOLDER_ALT = r"(?i)^(immagine|image|img|foto|photo|picture|logo|icona|icon|banner|grafica)\s*\d*$"
REQUIRED_MARK = r"(?i)\*|obbligatorio|required"
AUTOCOMPLETE_HINTS = [
    ("email", "email"),
    ("tel", "tel"),
    ("phone", "tel"),
    ("telefono", "tel"),
    ("nome", "given-name"),
    ("cognome", "family-name"),
    ("name", "name"),
    ("indirizzo", "street-address"),
    ("address", "street-address"),
    ("cap", "postal-code"),
    ("citta", "address-level2"),
    ("password", "current-password"),
]
ALT_CHARS = 200
RAW_URL_CHARS = 40
SAME_TEXT_CHARS = 60


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` rows of each page in document order, or all of them."""
    if n is None:
        return rows
    order = Window.partitionBy("url").orderBy("ordinal")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def _is_main() -> Column:
    return (F.col("tag") == "main") | F.coalesce(attr("role") == "main", F.lit(False))


def _is_nav() -> Column:
    return (F.col("tag") == "nav") | F.coalesce(attr("role") == "navigation", F.lit(False))


def _absent(name: str) -> Column:
    return F.coalesce(attr(name), F.lit("")) == ""


FAMILIES = ("headings", "landmarks", "titles", "skip", "images", "links", "forms")

#: what an item holds beside its element, each for the kinds of item that need it
_EXTRAS = {
    "from_level": "int", "from_text": "string", "n": "int", "m": "int", "mains": "int", "skips": "boolean", "texts": "array<string>",
    "wrapped": "boolean", "wrap_text": "string", "caption": "string", "label": "string",
}
_LOCATORS = ("context", "vendor", "lineage", "html", "selector")


def _kind() -> Column:
    return F.lower(F.coalesce(attr("type"), F.lit("")))


def _is_field() -> Column:
    return F.col("tag").isin("select", "textarea") | ((F.col("tag") == "input") & (_kind() != "hidden"))


def _is_link() -> Column:
    return (F.col("tag") == "a") & attr("href").isNotNull() & F.col("visible")


def _within(e: Column, *tags: str) -> Column:
    """Ordinal of the closest self-or-ancestor of an element with one of the tags."""
    return F.get(F.filter(e["context"], lambda c: c["tag"].isin(*tags)), 0)["ordinal"]


def _gathered(elements: DataFrame, families: Sequence[str], tree: bool) -> dict[str, Column]:
    """Aggregates of one page: the elements that families look at, whole, and what lookups need of others."""
    own = F.struct("ordinal", "tag", "attrs", "text", "visible", *[c for c in _LOCATORS if c in elements.columns])
    order = lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).otherwise(1)

    def those(when: Column, value: Column = own) -> Column:
        return F.collect_list(F.when(when, value))

    def keyed(when: Column, key: Column) -> Column:
        return F.array_sort(those(when, F.struct(key.alias("key"), "ordinal", F.coalesce("text", F.lit("")).alias("text"))))

    none = F.array().cast("array<struct<ordinal:int,tag:string>>")
    around = lambda tag: F.filter(F.col("context") if tree else none, lambda c: c["tag"] == tag)
    found: dict[str, Column] = {}
    if "headings" in families:
        head = F.col("tag").isin(HEADINGS) & F.col("visible")
        found |= {"heads": F.array_sort(those(head), order), "h1s": F.array_sort(those(head & (F.col("tag") == "h1"), F.struct("ordinal", "text")))}
    if "landmarks" in families:
        unlabelled = _is_nav() & _absent("aria-label") & _absent("aria-labelledby")
        found |= {
            "marks": those(_is_main() | _is_nav()), "mains": F.array_sort(those(_is_main(), F.col("ordinal"))),
            "navs": F.count_if(_is_nav()), "bare": F.count_if(unlabelled), "first_bare": F.min(F.when(unlabelled, F.col("ordinal"))),
        }
    if "titles" in families:
        found["title"] = F.trim(F.min_by("text", F.when(F.col("tag") == "title", F.col("ordinal"))))
    if "skip" in families:
        found["skips"] = F.max((F.col("tag") == "a") & F.startswith(attr("href"), F.lit("#")) & F.lower("text").rlike(SKIP_TEXT))
    if "images" in families:
        figures = F.transform(around("figure"), lambda c: F.struct(c["ordinal"].alias("key"), F.col("ordinal"), F.coalesce("text", F.lit("")).alias("text")))
        found |= {
            "images": those((F.col("tag") == "img") & F.col("visible") & attr("alt").isNotNull()),
            "wraps": those(F.col("tag").isin("a", "button"), F.struct(F.col("ordinal"), F.coalesce("text", F.lit("")))),
            "captions": F.array_sort(F.flatten(those(F.col("tag") == "figcaption", figures))),
        }
    if "links" in families:
        found["links"] = those(_is_link())
    if "forms" in families:
        radio = (F.col("tag") == "input") & (_kind() == "radio") & ~_absent("name")
        tied = ~F.col("visible") | (F.size(around("fieldset")) > 0)
        submit = (F.col("tag") == "button") | ((F.col("tag") == "input") & (_kind() == "submit"))
        found |= {
            "fields": those(_is_field() & F.col("visible")),
            "fors": keyed((F.col("tag") == "label") & attr("for").isNotNull(), attr("for")),
            "labels": those(F.col("tag") == "label", F.struct(F.col("ordinal"), F.coalesce("text", F.lit("")))),
            "radios": those(radio), "radio_names": F.array_sort(those(radio, F.struct(attr("name").alias("key"), tied.alias("tied"), "ordinal"))),
            "searches": those((F.col("tag") == "input") & (_kind() == "search")),
            "served": F.flatten(those(submit, F.transform(around("form"), lambda c: c["ordinal"]))),
        }
    if tree and ("links" in families or "forms" in families):
        found["ids"] = keyed(attr("id").isNotNull() & (attr("id") != ""), attr("id"))
    return found


def _lookups(page: DataFrame) -> DataFrame:
    """Gathered lists to maps, made once per page: behind a generator they aren't substituted into what uses them."""

    def first_of(name: str) -> Column:
        own = F.col(name)
        first = F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["key"] != x["key"]))
        return F.map_from_entries(F.transform(first, lambda x: F.struct(x["key"], x["text"])))

    names = F.col("radio_names")

    def groups(starts: Column) -> Column:
        # the first of a group is the first that no fieldset holds, if there is one
        each = F.transform(starts, lambda s, i: F.struct(F.get(names, s)["ordinal"].alias("ordinal"), F.get(names, s)["tied"].alias("tied"), (F.coalesce(F.get(starts, i + 1), F.size(names)) - s).alias("n")))
        return F.map_from_entries(F.transform(F.filter(each, lambda g: ~g["tied"] & (g["n"] > 1)), lambda g: F.struct(g["ordinal"], g["n"])))

    def loose() -> Column:
        places = F.transform(names, lambda x, i: F.struct(i.alias("i"), ((i == 0) | (F.get(names, i - 1)["key"] != x["key"])).alias("first")))
        return bind(F.transform(F.filter(places, lambda p: p["first"]), lambda p: p["i"]), groups)

    made = {c: F.col(c) for c in page.columns}
    made |= {c: first_of(c) for c in ("captions", "fors", "ids") if c in made}
    made |= {c: F.map_from_entries(c) for c in ("wraps", "labels") if c in made}
    if "radio_names" in made:
        made["radio_names"] = loose()
    return page.select(F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def _items(page: DataFrame, elements: DataFrame, families: Sequence[str], tree: bool) -> DataFrame:
    """Rows ``url, kind``, element, ``_EXTRAS``: one per element and family that looks at it, and one per page."""
    kinds: dict[str, DataType] = {f.name: f.dataType for f in elements.schema if f.name in ("ordinal", "tag", "attrs", "text", "visible", *_LOCATORS)}

    def item(kind: str, e: Column | None, **extras: Column) -> Column:
        own = [(F.lit(None).cast(t) if e is None else e[c]).alias(c) for c, t in kinds.items()]
        return F.struct(F.lit(kind).alias("kind"), *own, *[extras.get(c, F.lit(None)).cast(t).alias(c) for c, t in _EXTRAS.items()])

    def looked(name: str, key: Column) -> Column:
        return F.try_element_at(F.col(name), key)

    def name(e: Column, own: Column) -> Column:
        """Approximate accessible name: aria-label, the texts that aria-labelledby names, then its own."""
        if not tree:
            return e["text"]
        said, refs = e["attrs"]["aria-label"], F.split(e["attrs"]["aria-labelledby"], r"\s+")
        labelled = F.trim(F.array_join(F.transform(refs, lambda r: F.coalesce(looked("ids", r), F.lit(""))), " "))
        return F.when(F.coalesce(said, F.lit("")) != "", F.trim(said)).when(F.coalesce(labelled, F.lit("")) != "", labelled).otherwise(own)

    def head(e: Column, i: Column) -> Column:
        before, second = F.get("heads", i - 1), e["ordinal"] == F.get("h1s", F.lit(1))["ordinal"]
        texts = F.when(second, F.transform("h1s", lambda h: h["text"]))
        return item("heading", e, from_level=F.substr(before["tag"], F.lit(2)), from_text=before["text"], n=F.size("h1s"), texts=texts)

    def mark(e: Column) -> Column:
        second, first = e["ordinal"] == F.get("mains", F.lit(1)), (e["ordinal"] == F.col("first_bare")) & (F.col("navs") > 1)
        return item("mark", e, mains=F.when(second, F.size("mains")), n=F.when(first, F.col("navs")), m=F.when(first, F.col("bare")))

    def image(e: Column) -> Column:
        return item("image", e, wrapped=_within(e, "a", "button").isNotNull(), wrap_text=looked("wraps", _within(e, "a", "button")), caption=looked("captions", _within(e, "figure")))

    def field(e: Column) -> Column:
        a = e["attrs"]
        own = F.coalesce(looked("fors", F.when(a["id"] != "", a["id"])), looked("labels", _within(e, "label")), F.trim(F.when(a["title"] != "", a["title"])), F.lit(""))
        return item("field", e, label=name(e, own))

    def link(e: Column) -> Column:
        return item("link", e, label=name(e, F.coalesce(e["text"], F.lit(""))))

    has = page.columns
    facts = {"n": F.size("heads"), "m": F.size("h1s")} if "heads" in has else {}
    facts |= {"mains": F.size("mains")} if "mains" in has else {}
    facts |= {c: F.col(n) for c, n in (("label", "title"), ("skips", "skips")) if n in has}
    lists = [F.array(item("page", None, **facts))]
    made = {"heads": head, "marks": mark, "images": image, "links": link, "fields": field}
    lists += [F.transform(F.col(c), make) for c, make in made.items() if c in has]
    if "forms" in families:
        lists.append(F.transform(F.filter("radios", lambda e: looked("radio_names", e["ordinal"]).isNotNull()), lambda e: item("radio", e, n=looked("radio_names", e["ordinal"]))))
        lone = lambda e: _within(e, "form").isNotNull() & ~F.array_contains("served", _within(e, "form")) if tree else F.lit(False)
        lists.append(F.transform(F.filter("searches", lone), lambda e: item("search", e)))
    # a page without elements has no lists
    return page.select("url", F.inline(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))))


def _heading_hits() -> list[Column]:
    """F1 no h1, F2 several h1, F3 skipped level, F4 empty heading."""
    head, level = F.col("kind") == "heading", F.substr("tag", F.lit(2)).try_cast("int")
    quoted = F.array_join("texts", '", "')
    return [
        hit("heading-no-h1", (F.col("kind") == "page") & (F.coalesce("m", F.lit(0)) <= 0), F.lit("Nella pagina manca un titolo h1."), {"headingCount": F.greatest(F.lit(0), F.coalesce("n", F.lit(0)))}),
        hit(
            "heading-multiple-h1", head & F.col("texts").isNotNull(),
            F.concat(F.lit("Titoli h1 nella pagina: "), F.col("n").cast("string"), F.lit(' ("'), quoted, F.lit('").')),
            {"count": F.col("n"), "texts": F.col("texts")},
        ),
        hit(
            "heading-skipped-level", head & (level - F.col("from_level") > 1),
            F.concat(
                F.lit("Da h"), F.col("from_level").cast("string"), F.lit(' ("'), F.col("from_text"),
                F.lit('") si passa a h'), level.cast("string"), F.lit(' ("'), F.col("text"), F.lit('").'),
            ),
            {"from": F.col("from_level"), "to": level},
        ),
        hit("heading-empty", head & (F.col("text") == ""), F.concat(F.lit("Titolo "), F.col("tag"), F.lit(" vuoto."))),
    ]


def _landmark_hits() -> list[Column]:
    """F5 no main, F6 several main, F7 unlabelled navigation; visibility is not tested."""
    mark = F.col("kind") == "mark"
    return [
        hit("landmark-no-main", (F.col("kind") == "page") & (F.coalesce("mains", F.lit(0)) <= 0), F.lit("La pagina non delimita il contenuto principale.")),
        hit("landmark-multiple-main", mark & (F.col("mains") > 1), F.concat(F.lit("Aree principali nella pagina: "), F.col("mains").cast("string"), F.lit(".")), {"count": F.col("mains")}),
        hit(
            "landmark-nav-unlabeled", mark & F.col("n").isNotNull(),
            F.concat(F.lit("Aree di navigazione: "), F.col("n").cast("string"), F.lit(", senza etichetta: "), F.col("m").cast("string"), F.lit(".")),
            {"total": F.col("n"), "unlabeled": F.col("m")},
        ),
    ]


def _title_hits() -> list[Column]:
    """F8 missing title, F9 short title; the first title element counts."""
    page, title = F.col("kind") == "page", F.coalesce("label", F.lit(""))
    return [
        hit("title-missing", page & (title == ""), F.lit("Manca il titolo della pagina.")),
        hit("title-too-short", page & (title != "") & (F.length(title) < 6), F.concat(F.lit('Titolo troppo breve: "'), title, F.lit('".')), {"title": title}),
    ]


def _skip_hits() -> list[Column]:
    """no in-page link skips to the content."""
    return [hit("skiplink-missing", (F.col("kind") == "page") & ~F.coalesce("skips", F.lit(False)), F.lit("Nessun collegamento interno salta al contenuto."))]


def _image_hits() -> list[Column]:
    """F11-F16 on visible images that declare an alt."""
    image, alt, src = F.col("kind") == "image", F.trim(attr("alt")), F.coalesce(attr("src"), F.lit(""))
    filename = F.regexp_extract(F.regexp_extract(src, r"([^/]*)$", 1), r"^([^?]*)", 1)
    bare_file = F.regexp_replace(F.regexp_replace(F.lower(filename), r"\.[a-z0-9]+$", ""), r"[_\-.]", " ")
    blank = image & (alt == "")
    mute_wrap = F.col("wrapped") & (F.coalesce("wrap_text", F.lit("")) == "")
    is_file = image & (alt != "") & (bare_file != "") & (F.regexp_replace(F.lower(alt), r"[_\-.]", " ") == bare_file)
    filler = image & (alt != "") & ~is_file & alt.rlike(PLACEHOLDER_ALT)
    told = image & (alt != "") & ~is_file & ~filler
    data = {"src": src, "alt": alt}
    return [
        hit("img-empty-alt-in-link", blank & mute_wrap, F.lit("Una figura con alt vuoto è il solo contenuto del comando."), data),
        hit("img-empty-alt-review", blank & ~mute_wrap, F.lit("Figura dichiarata decorativa: da confermare."), data),
        hit("img-alt-is-filename", is_file, F.concat(F.lit('Alt uguale al nome del file: "'), alt, F.lit('".')), data),
        hit("img-alt-placeholder", filler, F.concat(F.lit('Alt riempitivo: "'), alt, F.lit('".')), data),
        hit(
            "img-alt-too-long", told & (F.length(alt) > ALT_CHARS), F.concat(F.lit("Alt di "), F.length(alt).cast("string"), F.lit(" caratteri.")),
            {"src": src, "altLength": F.length(alt), "alt": alt},
        ),
        hit(
            "img-alt-duplicates-caption", told & (F.coalesce("caption", F.lit("")) != "") & (F.lower("caption") == F.lower(alt)),
            F.lit("Alt e didascalia dicono la stessa frase."), {"alt": alt},
        ),
    ]


def _link_label() -> Column:
    return F.trim(F.regexp_replace("label", r"\s+", " "))


def _link_hits() -> list[Column]:
    """F17 generic text, F18 unannounced window, F19 raw URL."""
    link, label = F.col("kind") == "link", F.col("link_label")
    around = F.concat_ws(" ", label, F.coalesce(attr("title"), F.lit("")), F.coalesce(attr("aria-label"), F.lit("")))
    opens = F.coalesce(attr("target") == "_blank", F.lit(False))
    data = {"text": label, "href": U.resolve(attr("href"), F.col("url"))}
    return [
        hit("link-generic-text", link & (label != "") & label.rlike(GENERIC_LINK), F.concat(F.lit('Testo vago: "'), label, F.lit('".')), data),
        hit("link-new-window-unannounced", link & opens & ~around.rlike(NEW_WINDOW), F.concat(F.lit('"'), label, F.lit('" apre una finestra nuova senza dirlo.')), data),
        hit("link-raw-url-text", link & label.rlike(r"(?i)^https?://") & (F.length(label) > RAW_URL_CHARS), F.lit("Il testo è un indirizzo intero."), data),
    ]


def _form_hits() -> list[Column]:
    """F21-F25 on visible fields; F25 ignores visibility."""
    field, name = F.col("kind") == "field", F.col("label")
    hint, named = F.coalesce(attr("placeholder"), F.lit("")), F.coalesce(attr("name"), F.lit(""))
    required = attr("required").isNotNull() | F.coalesce(attr("aria-required") == "true", F.lit(False))
    hay = F.lower(F.concat_ws(" ", named, F.coalesce(attr("id"), F.lit("")), name, hint))
    # the first hint in list order decides
    suggested = F.coalesce(*[F.when(hay.contains(word), F.lit(value)) for word, value in AUTOCOMPLETE_HINTS])
    return [
        hit("form-placeholder-as-label", field & (name == "") & (hint != ""), F.concat(F.lit('Solo il segnaposto "'), hint, F.lit('" nomina il campo.')), {"placeholder": hint, "type": _kind()}),
        hit(
            "form-required-not-indicated", field & required & (name != "") & ~name.rlike(REQUIRED_MARK),
            F.concat(F.lit('Il campo "'), name, F.lit('" è obbligatorio e non lo dice.')), {"label": name},
        ),
        hit(
            "form-missing-autocomplete", field & (F.col("tag") == "input") & _absent("autocomplete") & suggested.isNotNull(),
            F.concat(F.lit("Manca autocomplete: atteso "), suggested, F.lit(".")), {"suggested": suggested, "fieldName": named},
        ),
        hit("form-radiogroup-no-fieldset", F.col("kind") == "radio", F.concat(F.lit("Scelte senza domanda: "), F.col("n").cast("string"), F.lit(".")), {"group": attr("name"), "count": F.col("n")}),
        hit("form-search-no-submit", F.col("kind") == "search", F.lit("La ricerca non ha un comando di invio.")),
    ]


def _same_text(links: DataFrame) -> DataFrame:
    """F20 same text to different targets, from rows ``url, ordinal, link_label, attrs`` of links."""
    told = links.filter((F.col("link_label") != "") & (F.length("link_label") < SAME_TEXT_CHARS))
    # pairs are made distinct first, so a menu repeated a thousand times costs one row
    pairs = told.groupBy("url", F.lower("link_label").alias("text"), U.resolve(attr("href"), F.col("url")).alias("href")).agg(F.min("ordinal").alias("ordinal"))
    # every target of one text comes from one document, so the list is bounded by that document
    targets = F.array_sort(F.collect_list(F.struct("ordinal", "href")))
    several = pairs.groupBy("url", "text").agg(F.count("*").alias("n"), targets.getField("href").alias("samples")).filter(F.col("n") > 1)
    return page_level(
        several,
        "link-same-text-different-targets",
        F.concat(F.lit('Il testo "'), F.col("text"), F.lit('" porta a '), F.col("n").cast("string"), F.lit(" mete diverse.")),
        {"text": F.col("text"), "targetCount": F.col("n"), "samples": F.col("samples")},
        selector="a",
    )


def static_checks(pages: DataFrame | None, elements: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """The static checks of some families, all by default, over tree or flat element rows.

    ``elements`` is read once. One aggregate per page gathers what the families
    look at, ``pages(url)`` joins it where absence is a finding (without
    ``pages`` only pages with elements are judged), and one projection per
    gathered element holds all checks. A page's row is as large as the page;
    nothing is kept across pages, and lookups stay in the row. Only the links'
    texts and targets are grouped once more.
    """
    tree = "context" in elements.columns
    page = _lookups(elements.groupBy("url").agg(*[c.alias(n) for n, c in _gathered(elements, families, tree).items()]))
    if pages is not None:
        page = pages.select("url").join(page, "url", "left")
    # the label is used many times: made in the generator, it is computed once
    rows = _items(page, elements, families, tree)
    if "links" in families:
        rows = rows.select("*", F.explode(F.array(F.when(F.col("kind") == "link", _link_label()))).alias("link_label"))
    hits = {"headings": _heading_hits, "landmarks": _landmark_hits, "titles": _title_hits, "skip": _skip_hits, "images": _image_hits, "links": _link_hits, "forms": _form_hits}
    whole = F.col("kind") == "page"
    about = F.col("h.check_id").startswith("title-")
    located = rows.select(
        "url",
        F.coalesce("ordinal", F.lit(0)).cast("int").alias("ordinal"),
        "kind",
        F.when(~whole, css_path() if tree else F.col("selector")).alias("selector"),
        F.when(whole, F.lit("document")).otherwise(signature_input() if tree else F.lit("unknown")).alias("component_signature"),
        F.when(whole, F.lit("")).otherwise(snippet(F.col("html")) if tree else F.lit("")).alias("html"),
        F.explode(F.filter(F.array(*[h for f in families for h in hits[f]()]), lambda h: h.isNotNull())).alias("h"),
    )
    selector = F.when(~whole, F.col("selector")).when(about, F.lit("head > title")).otherwise(F.lit("body"))
    found = located.select("url", "ordinal", "h.check_id", "h.criteria", "h.engine_impact", selector.alias("selector"), "component_signature", "html", "h.observation", "h.data")
    return union(found, _same_text(rows.filter("kind = 'link'"))) if "links" in families else found


def heading_checks(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """F1 to F4."""
    return static_checks(pages, elements, ["headings"])


def landmark_checks(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """F5 to F7."""
    return static_checks(pages, elements, ["landmarks"])


def title_checks(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """F8 and F9."""
    return static_checks(pages, elements, ["titles"])


def image_checks(elements: DataFrame) -> DataFrame:
    """F11 to F16."""
    return static_checks(None, elements, ["images"])


def link_checks(elements: DataFrame) -> DataFrame:
    """F17 to F20."""
    return static_checks(None, elements, ["links"])


def form_checks(elements: DataFrame) -> DataFrame:
    """F21 to F25."""
    return static_checks(None, elements, ["forms"])


def skip_link_check(pages: DataFrame, elements: DataFrame, among: int | None = None) -> DataFrame:
    """no in-page link skips to the content; a caller may look ``among`` the first few only (5 is usual)."""
    local = _first(elements.filter((F.col("tag") == "a") & attr("href").startswith("#")), among)
    skips = local.filter(F.lower("text").rlike(SKIP_TEXT)).select("url")
    return page_level(
        pages.select("url").join(skips, "url", "left_anti"),
        "skiplink-missing",
        F.lit("Nessun collegamento interno salta al contenuto."),
    )
