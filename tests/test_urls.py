import pytest
from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.operators import discovery as D
from tests.conftest import rows

BASE = "https://www.Biblio.example:443/it/orari/estate?anno=1#su"
RESOLVED = [
    ("../mappa", "https://www.biblio.example/it/mappa"),
    ("./giugno", "https://www.biblio.example/it/orari/giugno"),
    ("/a//b/", "https://www.biblio.example/a//b"),
    ("?utm_campaign=z", "https://www.biblio.example/it/orari/estate"),
    ("?x=1&gclid=2&y=3", "https://www.biblio.example/it/orari/estate?x=1&y=3"),
    ("#giu", "https://www.biblio.example/it/orari/estate?anno=1"),
    ("", "https://www.biblio.example/it/orari/estate?anno=1"),
    ("//altro.example/x/", "https://altro.example/x"),
    ("http://altro.example:80", "http://altro.example/"),
    ("http://altro.example:8080/", "http://altro.example:8080/"),
    ("../../../../z/..", "https://www.biblio.example/"),
    ("tel:0101", None),
    ("javascript:void(0)", None),
    ("https://", None),
]


@pytest.mark.parametrize("raw,expected", RESOLVED)
def test_canonical(spark, raw, expected):
    df = spark.createDataFrame([(raw, BASE)], "raw string, base string")
    assert df.select(U.canonical(F.col("raw"), F.col("base"))).first()[0] == expected


def test_same_site_truth_table(spark):
    cases = [
        ("https://biblio.example/a", "https://ateneo.example/a", False),
        ("https://www.biblio.example/", "https://biblio.example/x", True),
        ("http://biblio.example/", "https://biblio.example/", True),
        ("https://biblio.example/?a=1", "https://biblio.example/?a=2", True),
        ("https://foto.biblio.example/", "https://biblio.example/", False),
        ("non un indirizzo", "https://biblio.example/", False),
        ("non un indirizzo", "non un indirizzo", False),
    ]
    df = spark.createDataFrame(cases, "a string, b string, expected boolean")
    assert df.filter(U.same_site(F.col("a"), F.col("b")) != F.col("expected")).count() == 0


def test_page_filter_looks_at_the_whole_url(spark):
    urls = ["https://x.example/a.pdf", "https://x.example/a.pdf?v=1", "https://x.example/WP-JSON/x", "https://x.example/wp-jsonish"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").filter(U.is_page(F.col("u")))
    assert rows(df) == [("https://x.example/a.pdf?v=1",), ("https://x.example/wp-jsonish",)]


def test_root_collection_modes(spark):
    urls = [(f"https://x.example/sez{chr(97 + i)}/pagina",) for i in range(16)]
    children = D.path_children(spark.createDataFrame(urls, "url string"))
    coded = rows(D.collections(children), "prefix")
    documented = rows(D.collections(children, root_leaf_mode="as_documented"), "prefix")
    assert coded == [("x.example/",)] and documented == []


def test_sitemap_stops_between_documents(spark):
    docs = [
        ("https://x.example/sitemap.xml", "<sitemapindex><loc>https://x.example/a.xml</loc><loc>https://x.example/b.xml</loc></sitemapindex>"),
        ("https://x.example/a.xml", "".join(f"<url><loc>https://x.example/a{i}</loc></url>" for i in range(3))),
        ("https://x.example/b.xml", "<loc>https://x.example/b</loc><loc>https://x.example/sitemap.xml</loc>"),
        ("https://x.example/sitemap-index.xml", "<loc>https://x.example/first</loc>"),
    ]
    sites = spark.createDataFrame([("x", "https://x.example")], "site_id string, base_url string")
    table = spark.createDataFrame(docs, "doc_url string, body string")
    everything = {u for (u,) in rows(D.sitemap_urls(table, sites), "url")}
    assert everything == {f"https://x.example/{p}" for p in ("a0", "a1", "a2", "b", "first")}
    # 'first' is read before the nested documents; three more come from one document, then it stops
    few = {u for (u,) in rows(D.sitemap_urls(table, sites, max_pages=2), "url")}
    assert few == {f"https://x.example/{p}" for p in ("a0", "a1", "a2", "first")}


def test_link_reach_cap_is_by_depth_then_url(spark):
    edges = [("s", "https://x.example/", f"https://x.example/{i:03d}") for i in range(80)]
    seeds = spark.createDataFrame([("s", "https://x.example/")], "site_id string, url string")
    out = D.link_reach(seeds, spark.createDataFrame(edges, "site_id string, src string, dst string"), max_pages=100)
    got = rows(out, "url")
    assert len(got) == 60 and ("https://x.example/058",) in got and ("https://x.example/059",) not in got
    chain = [("s", f"https://x.example/{i}", f"https://x.example/{i + 1}") for i in range(6)] + [("s", "https://x.example/6", "https://x.example/0")]
    far = D.link_reach(spark.createDataFrame([("s", "https://x.example/0")], "site_id string, url string"), spark.createDataFrame(chain, "site_id string, src string, dst string"))
    assert [d for (d,) in rows(far, "depth")] == list(range(7))
