"""URL columns without a UDF.

One split pattern is used everywhere, so an odd URL never raises: it yields a
null canonical form. Hosts are lower-cased and default ports dropped; nothing
is percent-encoded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# URL vocabularies and patterns.
TRACKING_KEY = r"(?i)^(utm_|fbclid|gclid|mc_cid|mc_eid|_ga)"
SKIP_EXTENSION = (
    r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz|jpe?g|png|gif|webp|avif|svg|ico|mp4|mp3|wav|avi|mov"
    r"|css|js|json|xml|rss|woff2?|ttf|eot)$"
)
SKIP_PATH = r"(?i)/(cdn-cgi|wp-json|xmlrpc\.php|wp-admin|wp-login\.php|\.well-known)(/|$)"
HREF = r"(?i)<a\b[^>]*\shref\s*=\s*[\"']([^\"']+)[\"']"
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
LOCALE_SEGMENT = r"(?i)^[a-z]{2}(-[a-z]{2})?$"
LANGUAGE_SEGMENT = r"(?i)^([a-z]{2})([-_][a-z]{2,4})?$"
KNOWN_LANGUAGES = (
    "it", "en", "fr", "de", "es", "pt", "nl", "da", "sv", "no", "fi", "pl", "cs", "sk", "sl", "hu", "ro", "bg",
    "el", "ru", "uk", "tr", "ar", "he", "zh", "ja", "ko", "ca", "eu", "gl", "ga", "cy", "et", "lv", "lt", "sr",
    "hr", "mt", "is",
)

# scheme, authority, path, query, in one pass; the fragment is dropped
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_SEP = "\u0001"
_WEB = r"(?i)^https?://(?:[^/?#@]*@)?[^/?#@\s<>^|\\]+"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def _split(raw: Column) -> Column:
    flat = F.regexp_replace(F.trim(raw), r"[\t\r\n]", "")
    return F.split(F.regexp_replace(flat, _SPLIT, f"$1{_SEP}$2{_SEP}$3{_SEP}$4"), _SEP)


def host(url: Column) -> Column:
    """Lower-case host, port excluded."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    """Query with its question mark, or an empty string."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def is_web(url: Column) -> Column:
    return url.rlike(_WEB)


def origin(url: Column) -> Column:
    """``scheme://host[:port]``, default port dropped; null unless http(s)."""
    start = F.lower(F.regexp_replace(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1), r"//[^@]*@", "//"))
    bare = F.regexp_replace(start, r"^(?:(http://.*?):(?:80)?|(https://.*?):(?:443)?)$", "$1$2")
    return F.when(is_web(url), bare)


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: F.length(s) > 0)


def query_keys(url: Column) -> Column:
    """Sorted query keys, repeats kept."""
    pairs = F.filter(F.split(F.substr(query(url), F.lit(2)), "&"), lambda p: F.length(p) > 0)
    return F.array_sort(F.transform(pairs, lambda p: F.regexp_extract(p, r"^([^=]*)", 1)))


def _without_dots(raw_path: Column) -> Column:
    """Resolve ``.`` and ``..``; only evaluated when the path holds one."""

    def fold(parts: Column) -> Column:
        kept = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s)),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)

    resolved = F.regexp_replace(bind(F.split(F.substr(raw_path, F.lit(2)), "/"), fold), r"^/+$", "/")
    return F.when(raw_path.rlike(r"/\.\.?(/|$)"), resolved).otherwise(raw_path)


def _without_tracking(raw_query: Column) -> Column:
    """Drop tracking keys; a query without any is returned untouched."""
    pairs = F.split(F.substr(raw_query, F.lit(2)), "&")

    def rebuild(all_pairs: Column) -> Column:
        kept = F.filter(all_pairs, lambda p: (F.length(p) > 0) & ~p.rlike(TRACKING_KEY))
        joined = F.array_join(kept, "&")
        return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit(""))

    tracked = raw_query.rlike(r"(?i)[?&](utm_|fbclid|gclid|mc_cid|mc_eid|_ga)")
    return F.when(tracked, bind(pairs, rebuild)).otherwise(raw_query)


def _full_path(raw_path: Column) -> Column:
    full = F.replace(F.when(raw_path == "", F.lit("/")).otherwise(raw_path), F.lit("\\"), F.lit("/"))
    return bind(full, _without_dots)


def _strip_slash(p: Column) -> Column:
    return F.when(F.length(p) > 1, F.regexp_replace(p, r"/$", "")).otherwise(p)


def _on_base(r: Column, b: Column) -> tuple[Column, Column, Column]:
    """Origin, path and query of a scheme-less reference ``r`` on its base ``b`` (split columns)."""
    start = F.concat(b[0], F.lit(":"), F.when(r[1] != "", r[1]).otherwise(b[1]))
    folder = F.concat(F.regexp_replace(b[2], r"/[^/]*$", ""), F.lit("/"))
    new_path = (
        F.when((r[1] != "") | r[2].startswith("/"), r[2]).when(r[2] == "", b[2]).otherwise(F.concat(folder, r[2]))
    )
    inherits = (r[1] == "") & (r[2] == "") & (r[3] == "")
    return origin(start), new_path, F.when(inherits, b[3]).otherwise(r[3])


def _rooted(raw: Column, base: Column | None, build: Callable[[Column, Column, Column], Column]) -> Column:
    def absolute(r: Column) -> Column:
        return build(origin(F.concat(r[0], F.lit(":"), r[1])), r[2], r[3])

    if base is None:
        return bind(_split(raw), absolute)
    return bind(
        _split(raw),
        lambda r: F.when(r[0] != "", absolute(r)).otherwise(bind(_split(base), lambda b: build(*_on_base(r, b)))),
    )


def canonical(raw: Column, base: Column | None = None) -> Column:
    """Canonical http(s) URL of ``raw`` resolved against ``base``, or null (B1)."""

    def build(start: Column, raw_path: Column, raw_query: Column) -> Column:
        return F.concat(start, bind(_full_path(raw_path), _strip_slash), _without_tracking(raw_query))

    return _rooted(raw, base, build)


def resolve(raw: Column, base: Column) -> Column:
    """``raw`` made absolute and otherwise untouched, fragment kept; other schemes pass through."""
    whole = _rooted(raw, base, lambda start, p, q: F.concat(start, _full_path(p), q))
    return F.coalesce(F.concat(whole, F.regexp_extract(raw, r"(#.*)$", 1)), F.trim(raw))


def is_page(url: Column) -> Column:
    """Neither a file by extension nor a service endpoint; looks at the whole URL (B2)."""
    return ~url.rlike(SKIP_EXTENSION) & ~url.rlike(SKIP_PATH)


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host and port agree; anything unparsable is foreign."""
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def bare_host(url: Column) -> Column:
    """Host without one leading ``www.``; null when there is none."""
    bare = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(is_web(url) & (bare != ""), bare)


def same_site(a: Column, b: Column) -> Column:
    """Hosts agree up to a leading ``www.``."""
    return F.coalesce(bare_host(a) == bare_host(b), F.lit(False))


def segment_class(segment: Column) -> Column:
    """Placeholder for identifying segments, else lower case."""
    return (
        F.when(segment.rlike(r"^\d+$"), F.lit(":num"))
        .when(segment.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"), F.lit(":uuid"))
        .when(segment.rlike(r"\d{3,}"), F.lit(":id"))
        .otherwise(F.lower(segment))
    )


def classed_segments(url: Column) -> Column:
    return F.transform(segments(url), segment_class)


def query_suffix(url: Column) -> Column:
    keys = query_keys(url)
    return F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, ","))).otherwise(F.lit(""))


def shape(url: Column) -> Column:
    """Shape of one URL on its own: host, classed segments, query keys."""
    return F.when(
        is_web(url),
        F.concat(host(url), F.lit("/"), F.array_join(classed_segments(url), "/"), query_suffix(url)),
    ).otherwise(url)


def readable_label(url: Column) -> Column:
    """Human label from the path, locale segments skipped."""
    kept = F.filter(segments(url), lambda s: ~s.rlike(LOCALE_SEGMENT))
    section = F.replace(F.element_at(kept, 1), F.lit("-"), F.lit(" "))
    titled = F.concat(F.upper(F.left(section, F.lit(1))), F.substr(section, F.lit(2)))
    return (
        F.when(~is_web(url), F.lit(None).cast("string"))
        .when(F.size(kept) == 0, F.lit("Homepage"))
        .when(F.size(kept) > 1, F.concat(F.lit("Scheda "), section))
        .otherwise(titled)
    )


def section(url: Column) -> Column:
    """First path segment, or a marker for the root."""
    segs = segments(url)
    return F.when(is_web(url), F.when(F.size(segs) > 0, F.element_at(segs, 1)).otherwise(F.lit("(radice)")))


def language(url: Column) -> Column:
    """Language code in the first path segment, closed list."""
    segs = segments(url)
    first = F.when(F.size(segs) > 0, F.element_at(segs, 1))
    code = F.lower(F.regexp_extract(first, LANGUAGE_SEGMENT, 1))
    return F.when(code.isin(*KNOWN_LANGUAGES), code)


def neutral_path(url: Column) -> Column:
    """Path with the language segment replaced by a placeholder."""
    rest = F.slice(segments(url), 2, F.greatest(F.size(segments(url)), F.lit(1)))
    return F.when(language(url).isNotNull(), F.concat(F.lit("/{lang}/"), F.array_join(rest, "/")))


def path_depth(url: Column) -> Column:
    """Number of slash-separated parts of the path, the leading empty one included."""
    return F.size(F.split(path(url), "/"))
