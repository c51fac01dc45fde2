"""Page markup to element rows: the one place where Python sees the data.

A documented, simpler tree than a browser's: optional end tags are implied for
paragraphs, list items, options and table parts; void and raw-text elements are
honoured; a missing body is supplied; unclosed formatting elements are *not*
re-opened in the next block. What passes from an element to what is inside it
(visibility, vendor) is found in the same sweep; everything after this step is
column expressions.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims

# Element classes and attribute lists.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
RAW_TEXT = {
    "script", "style", "textarea", "title",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul",
}
# start tag -> (open tags it ends, tags the search stops at)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
HEAD_TAGS = {
    "title", "meta", "link", "base", "style", "script",
}
LANDMARK_TAGS = {
    "header", "nav", "main", "aside", "footer", "form",
}
LANDMARK_ROLES = {
    "banner", "navigation", "main", "complementary", "contentinfo", "search",
}
TEST_ATTRS = (
    "data-testid", "data-test-id", "data-cy", "data-component", "data-qa", "data-block",
)
SKELETON_SKIP = {
    "script", "style", "noscript", "svg", "path", "br", "template",
}
NOT_RENDERED = {
    "head", "title", "meta", "link", "base", "script", "style", "template", "noscript",
}
CONTEXT_TAGS = {
    "a", "button", "figure", "label", "fieldset", "form",
}
TEXT_TAGS = {
    "a", "button", "h1", "h2", "h3", "h4", "h5", "h6", "label", "figcaption", "title", "option", "legend",
}
BATCH_PAGES = 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_CLEAR = re.compile(r"opacity:0*\.?0*(;|$)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

NODE_TYPE = pa.struct(
    [
        ("tag", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("id", pa.string()),
        ("role", pa.string()),
        ("test_attr", pa.string()),
        ("landmark", pa.bool_()),
        ("nth", pa.int32()),
        ("same", pa.int32()),
    ]
)
ELEMENTS = pa.list_(
    pa.struct(
        [
            ("ordinal", pa.int32()),
            ("parent", pa.int32()),
            ("depth", pa.int32()),
            ("last", pa.int32()),
            ("tag", pa.string()),
            ("attrs", pa.map_(pa.string(), pa.string())),
            ("text", pa.string()),
            ("visible", pa.bool_()),
            ("skipped", pa.bool_()),
            ("vendor", pa.string()),
            ("context", pa.list_(pa.struct([("ordinal", pa.int32()), ("tag", pa.string())]))),
            ("lineage", pa.list_(NODE_TYPE)),
            ("html", pa.string()),
        ]
    )
)
NODE_DDL = (
    "struct<tag:string,classes:array<string>,id:string,role:string,test_attr:string,landmark:boolean,nth:int,same:int>"
)
ELEMENTS_DDL = (
    "array<struct<ordinal:int,parent:int,depth:int,last:int,tag:string,attrs:map<string,string>,text:string,"
    f"visible:boolean,skipped:boolean,vendor:string,context:array<struct<ordinal:int,tag:string>>,lineage:array<{NODE_DDL}>,html:string>>"
)


class Element:
    __slots__ = ("ordinal", "parent", "depth", "last", "tag", "attrs", "start", "stop", "words", "said", "nth", "kinds", "context", "classes")

    def __init__(self, ordinal, parent, tag, attrs, start, words):
        self.ordinal, self.parent, self.tag, self.attrs, self.start = ordinal, parent, tag, attrs, start
        self.depth = parent.depth + 1 if parent else 0
        self.last, self.stop, self.kinds = ordinal, None, {}
        self.words = self.said = words
        self.nth = 1
        if parent:
            self.nth = parent.kinds[tag] = parent.kinds.get(tag, 0) + 1
        self.classes = attrs.get("class", "").split()
        inner = parent.context if parent else ()
        self.context = ((ordinal, tag), *inner) if tag in CONTEXT_TAGS else inner

    def node(self):
        role = self.attrs.get("role") or None
        test = next((f"{a}={self.attrs[a]}" for a in TEST_ATTRS if self.attrs.get(a)), None)
        return {
            "tag": self.tag,
            "classes": self.classes,
            "id": self.attrs.get("id") or None,
            "role": role,
            "test_attr": test,
            "landmark": self.tag in LANDMARK_TAGS or role in LANDMARK_ROLES,
            "nth": self.nth,
            "same": self.parent.kinds[self.tag] if self.parent else 1,
        }


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _markup(source: str, el: Element, chars: int | None) -> str:
    """Collapsed outer markup, all of it or the first ``chars`` characters."""
    stop = el.stop if el.stop is not None else len(source)
    size = len(source) if chars is None else 4 * chars
    while True:
        flat = re.sub(r"\s+", " ", source[el.start : min(stop, el.start + size)])
        if el.start + size >= stop or len(flat) >= (chars or 0):
            return flat[:chars]
        size *= 4


def parse(source: str) -> tuple[list[Element], list[str]]:
    """Elements of one page in document order, and its pieces of text; an element holds a range of those."""
    elements: list[Element] = []
    stack: list[Element] = []
    said: list[str] = []

    def push(tag, attrs, start):
        el = Element(len(elements), stack[-1] if stack else None, tag, attrs, start, len(said))
        elements.append(el)
        stack.append(el)
        return el

    def pop(end):
        el = stack.pop()
        el.stop, el.last, el.said = end, len(elements) - 1, len(said)

    def words(raw):
        if raw:
            said.append(entities.unescape(raw))

    def prepare(tag, at):
        """Close what the start tag implies and supply html, head and body."""
        if not stack:
            push("html", {}, at)
        if len(stack) == 1 and tag not in ("head", "body", "frameset"):
            push("head" if tag in HEAD_TAGS and not any(e.tag in ("head", "body") for e in elements) else "body", {}, at)
        elif len(stack) == 2 and stack[1].tag == "head" and tag not in HEAD_TAGS and tag != "noscript":
            pop(at)
            if tag not in ("body", "frameset"):
                push("body", {}, at)
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 1, -1):
                if stack[i].tag in ("button", "table", "td", "th", "caption"):
                    break
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop(at)
                    break
        ends, limit = IMPLIED_END.get(tag, ((), ()))
        while ends:
            hit = None
            for i in range(len(stack) - 1, 1, -1):
                if stack[i].tag in limit:
                    break
                if stack[i].tag in ends:
                    hit = i
                    break
            if hit is None:
                break
            while len(stack) > hit:
                pop(at)

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        words(source[at : m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        closing, tag, raw = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i + 1:
                        pop(m.start())
                    pop(at)
                    break
            else:
                if tag == "p":
                    prepare("p", m.start())
                    push("p", {}, m.start())
                    pop(at)
            continue
        attrs = _attributes(raw)
        if tag in ("html", "body", "head"):
            known = next((e for e in elements if e.tag == tag), None)
            if known:
                for k, v in attrs.items():
                    known.attrs.setdefault(k, v)
                known.classes = known.attrs.get("class", "").split()
                continue
            if tag == "html":
                push("html", attrs, m.start())
                continue
        prepare(tag, m.start())
        push(tag, attrs, m.start())
        if tag in VOID:
            pop(at)
        elif tag in RAW_TEXT:
            end = re.compile(rf"</{tag}", re.I).search(source, at)
            if tag in ("title", "textarea"):
                words(source[at : end.start() if end else len(source)])
            at = end.start() if end else len(source)
    while stack:
        pop(len(source))
    return elements, said


def _lineage(el: Element) -> list[dict]:
    out, node = [], el
    while node is not None and (node.tag != "body" or node is el):
        out.append(node.node())
        node = node.parent
    return out


class Rules:
    """Vendor rules by what they look at, so that an element meets only those on its own tag and attributes."""

    def __init__(self, rows: Iterable[tuple[int, str, str, str, str, str]]):
        self.vendors: dict[int, str] = {}
        self.by: dict[str, list[tuple[int, str, str, str]]] = {}
        for order, vendor, tag, attr, op, value in sorted(rows):
            self.vendors[order] = vendor
            self.by.setdefault(attr, []).append((order, tag, op, value))

    def first(self, el: Element) -> int | None:
        """Order of the first rule that the element itself meets."""
        told = {"?": lambda have, value: True, "=": str.__eq__, "*": str.__contains__, "^": str.startswith, "~": lambda have, value: value in have.split()}
        met = [order for order, tag, _, _ in self.by.get("", ()) if tag in ("", el.tag) and (el.attrs or "-" in el.tag)]
        for name, have in el.attrs.items():
            if name:
                met += [order for order, tag, op, value in self.by.get(name, ()) if tag in ("", el.tag) and told[op](have, value)]
        return min(met, default=None)


def states(elements: list[Element], rules: Rules) -> Iterator[tuple[bool, bool, str | None]]:
    """Whether each element is visible, whether the skeleton skips it, and its vendor.

    All three pass from an element to what is inside it. Elements come in
    document order, so one sweep finds what is around an element at its parent:
    not rendered are the tags that never are, ``hidden`` and ``display:none``;
    the closest ``visibility`` decides; ``opacity:0`` hides the element alone;
    the first vendor rule that the element or one around it meets names the vendor.
    """
    seen: list[tuple[bool, bool, bool, int | None]] = []
    for el in elements:
        off, unseen, quiet, rule = seen[el.parent.ordinal] if el.parent else (False, False, False, None)
        style = el.attrs.get("style", "").lower().replace(" ", "")
        off = off or el.tag in NOT_RENDERED or "hidden" in el.attrs or "display:none" in style
        unseen = "visibility:hidden" in style if "visibility:" in style else unseen
        quiet = quiet or el.tag in SKELETON_SKIP
        own = rules.first(el)
        rule = own if rule is None or (own is not None and own < rule) else rule
        seen.append((off, unseen, quiet, rule))
        yield not (off or unseen or _CLEAR.search(style)), quiet, rules.vendors.get(rule)


def page_elements(source: str, rules: Rules, detail: set[str] | None = None, markup_chars: int | None = None) -> list[dict]:
    """Elements of a page as records: tags, attributes, places, texts, states, ancestors.

    Markup is copied for tags of ``detail`` and for main and navigation areas
    only: other areas may nest, and would each repeat what is inside them.
    """
    elements, said = parse(source)
    out = []
    for el, (visible, skipped, vendor) in zip(elements, states(elements, rules)):
        shown = detail is None or el.tag in detail or el.attrs.get("role") in ("main", "navigation")
        detailed = shown or "role" in el.attrs
        told = el.tag in TEXT_TAGS or "id" in el.attrs
        out.append({
            "ordinal": el.ordinal, "parent": el.parent.ordinal if el.parent else None, "depth": el.depth, "last": el.last, "tag": el.tag, "attrs": list(el.attrs.items()),
            "text": re.sub(r"\s+", " ", "".join(said[el.words : el.said])).strip() if told else None, "visible": visible, "skipped": skipped, "vendor": vendor,
            "context": [{"ordinal": o, "tag": t} for o, t in el.context],
            "lineage": _lineage(el) if detailed else None, "html": _markup(source, el, markup_chars) if shown else None,
        })
    return out


def element_tree(pages: DataFrame, rules: DataFrame | None = None, detail: set[str] | None = None, markup_chars: int | None = None) -> DataFrame:
    """``pages(url, html)`` to element rows.

    ``detail`` limits the wide columns to the tags a caller needs: ancestor
    lineage, which elements with a role always carry, and markup, which main and
    navigation areas always carry. A caller that shows only the head of the
    markup may pass ``markup_chars``. ``rules`` is a closed list of vendor rules.
    Pages are parsed one at a time, in time linear in their elements; batches
    are kept small because markup is wide
    (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    """
    table = Rules(map(tuple, rules.select("rule_order", "vendor", "tag", "attr", "op", "value").collect()) if rules is not None else dims.vendor_rule_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(first, BATCH_PAGES)
                parsed = [page_elements(source or "", table, detail, markup_chars) for source in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(parsed, ELEMENTS)], names=["url", "elements"])

    parsed = pages.select("url", "html").mapInArrow(run, f"url string, elements {ELEMENTS_DDL}")
    return parsed.select("url", F.inline("elements"))
