from auditlake.operators import checks_static as S
from auditlake.operators import structure as ST
from auditlake.sources import html_tree
from tests.conftest import rows


def tags(source):
    return [(e.tag, e.depth) for e in html_tree.parse(source)[0]]


def test_implied_end_tags():
    assert tags("<ul><li>a<li>b</ul><p>x<p>y<div>z</div>") == [
        ("html", 0), ("body", 1), ("ul", 2), ("li", 3), ("li", 3), ("p", 2), ("p", 2), ("div", 2),
    ]
    assert tags("<table><tr><td>1<td>2<tr><td>3</table>")[2:] == [("table", 2), ("tr", 3), ("td", 4), ("td", 4), ("tr", 3), ("td", 4)]
    assert [t for t, _ in tags("<select><option>a<option>b</select><br><img>")] == ["html", "body", "select", "option", "option", "br", "img"]


def test_raw_text_comments_and_entities():
    e, said = html_tree.parse('<title>A &amp; B</title><script>"</p><div>"</script><!-- <h1>no</h1> --><h1 title="a>b">Tre</h1>')
    assert [x.tag for x in e] == ["html", "head", "title", "script", "body", "h1"]
    assert "".join(said[e[2].words : e[2].said]) == "A & B" and e[5].attrs["title"] == "a>b"


def test_stray_and_unclosed():
    assert [t for t, _ in tags("a</div></p><b>c")] == ["html", "body", "p", "b"]
    assert [t for t, _ in tags('<a href="x>y')][:2] == ["html", "body"]
    assert tags("") == []


def page(spark, *bodies):
    return spark.createDataFrame([(f"https://x.example/{i}", b) for i, b in enumerate(bodies)], "url string, html string")


def test_caption_of_the_closest_figure(spark):
    p = page(spark, '<figure><figcaption>Fuori</figcaption><figure><img src=a alt="Dentro"><figcaption>dentro</figcaption></figure></figure>')
    assert rows(S.image_checks(html_tree.element_tree(p)), "check_id") == [("img-alt-duplicates-caption",)]


def test_visibility_is_inherited_but_opacity_is_not(spark):
    p = page(spark, '<div hidden><h2>a</h2></div><div style="opacity:0"><h3>b</h3></div><div style="visibility:hidden"><h4 style="visibility: visible">c</h4></div>')
    e = html_tree.element_tree(p)
    assert rows(e.filter("visible and tag like 'h_' and tag <> 'hr'"), "tag") == [("h3",), ("h4",)]


def test_late_body_attributes_and_inner_visibility(spark):
    late = page(spark, "<p>a</p><body hidden><h2>b</h2>")
    assert html_tree.element_tree(late).filter("visible and tag in ('p', 'h2')").count() == 0
    nested = '<div style="visibility:hidden"><div style="visibility:visible"><h2>a</h2><div style="Visibility: Hidden"><h3>b</h3></div></div><h4>c</h4></div>'
    e = html_tree.element_tree(page(spark, nested)).filter("tag like 'h_' and visible")
    assert rows(e, "tag") == [("h2",)]


def test_text_of_nested_ids_is_assembled_once_per_element(spark):
    p = page(spark, "<div id=a>x<div id=b>y <b>z</b></div>w</div>")
    assert rows(html_tree.element_tree(p).filter("text is not null"), "tag", "text") == [("div", "xy zw"), ("div", "y z")]


def test_skeleton_skips_subtrees_and_prefers_main(spark):
    p = page(spark, "<div><p>x</p></div><main><section><svg><path></path></svg><ul><li><a><b><i>x</i></b></a></ul></section></main>")
    drawn = ST.skeleton(html_tree.element_tree(p)).first()["skeleton"]
    assert [(n["depth"], n["tag"]) for n in drawn] == [(0, "section"), (1, "ul"), (2, "li"), (3, "a"), (4, "b")]


def test_one_partition_or_many(spark):
    bodies = [f"<h1>{i}</h1><a href='/x'>leggi tutto</a><img src='f{i}.png' alt='f{i}'>" for i in range(12)]
    p = page(spark, *bodies)
    out = [rows(S.static_checks(p.select("url"), html_tree.element_tree(p.repartition(n)))) for n in (1, 8)]
    assert out[0] == out[1] and len(out[0]) > 12


def test_many_menus_make_one_same_text_row(spark):
    links = "".join(f'<a href="/m{i % 7}#s{i}">Apri</a>' for i in range(300))
    p = page(spark, links)
    found = S.link_checks(html_tree.element_tree(p)).filter("check_id = 'link-same-text-different-targets'").collect()
    assert len(found) == 1 and '"targetCount":300' in found[0]["data"]


def test_evidence_shows_whole_markup(spark):
    from auditlake.plans.corpus import audit_inputs

    link = f'<a href="/x" title="{"lungo " * 100}">clicca qui</a>'
    pages = [(i, f"https://a.example.org/p/{i}", f'<html lang="it"><body><main><h1>T</h1><p>{link}</p></main></body></html>') for i in range(3)]
    evidence = audit_inputs(spark.createDataFrame(pages, "page_id long, url string, html string"))[0]
    shown = {r["html"] for r in evidence.filter("check_id = 'link-generic-text'").select("node.html" if "node" in evidence.columns else "html").collect()}
    assert shown == {link}


def _work(body: str) -> int:
    """Python calls and lines that a page takes: a measure of work that no clock disturbs."""
    import sys

    from auditlake import dims

    rules, steps = html_tree.Rules(dims.vendor_rule_rows()), 0

    def trace(frame, event, arg):
        nonlocal steps
        steps += 1
        return trace

    sys.settrace(trace)
    try:
        html_tree.page_elements(body, rules, S.CHECK_TAGS)
    finally:
        sys.settrace(None)
    return steps


def test_work_grows_with_the_elements_of_a_page():
    icons = lambda n: "<p hidden>a</p><br><svg class='fb-root'></svg>" * n
    assert _work(icons(2000)) < 2.1 * _work(icons(1000))


def test_nested_areas_do_not_repeat_their_markup(spark):
    inner = "<p>lungo</p>" * 2000
    p = page(spark, "<div role=region>" * 50 + inner + "</div>" * 50 + "<nav><a href=/x>vai</a></nav>")
    shown = html_tree.element_tree(p, detail=S.CHECK_TAGS).filter("html is not null")
    assert rows(shown, "tag") == [("a",), ("nav",)]


def test_states_of_nested_elements(spark):
    body = '<div hidden><p style="visibility:visible">a</p></div><svg><path></path></svg><p style="opacity: 0.00">b</p><iframe x=1 y="in q z"><b>c</b></iframe>'
    given = spark.createDataFrame([(2, "late", "", "x", "=", "1"), (1, "early", "b", "", "", ""), (3, "word", "iframe", "y", "~", "q")], "rule_order int, vendor string, tag string, attr string, op string, value string")
    e = html_tree.element_tree(page(spark, body), given).filter("tag not in ('html', 'body')")
    got = [tuple(r) for r in e.orderBy("ordinal").select("tag", "visible", "skipped", "vendor").collect()]
    assert got == [
        ("div", False, False, None), ("p", False, False, None), ("svg", True, True, None), ("path", True, True, None),
        ("p", False, False, None), ("iframe", True, False, "late"), ("b", True, False, "late"),
    ]
