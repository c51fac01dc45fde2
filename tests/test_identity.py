import json
import random

from pyspark.sql import functions as F

from auditlake.functions import identity as FI
from auditlake.operators import clusters as E
from auditlake.operators import evidence as H
from auditlake.operators import identity as ID
from auditlake.operators import replay as M
from tests.conftest import rows


def words(spark, *tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def test_hash_words(spark):
    generated = ["qwpzrS", "trnlbX", "kxcvD", "bcdfg", "aEiou", "false", "undefined"]
    real = ["scheda", "foto", "mini", "rosso", "grande"]
    df = spark.createDataFrame([(w, w in generated) for w in generated + real], "w string, expected boolean")
    assert df.filter(FI.looks_hashed(F.col("w")) != F.col("expected")).count() == 0


def test_volatile_has_no_end_anchor(spark):
    df = words(spark, "opensans", "currently", "box-hidden-x", "reopen", "sc-abcd", "sc-ab")
    kept = rows(df.filter(FI.syntactically_stable(F.col("token"))))
    assert kept == [("reopen",), ("sc-ab",)]


def test_stable_ids_need_coverage(spark):
    registry = spark.createDataFrame([("sez-uno", 1), ("sez-due", 1), ("lista", 2), ("salta", 58), ("radice", 88)], "token string, pages long")
    assert rows(ID.stable_ids(registry, F.lit(88)), "token") == [("radice",), ("salta",)]
    assert ID.stable_ids(registry, F.lit(3)).count() == 5


def chain(*nodes, vendor=None):
    return json.dumps({"chain": list(nodes), **({"vendor": vendor} if vendor else {})})


def test_rare_ids_split_signatures_only_without_a_registry(spark):
    top = {"tag": "main", "classes": ["corpo-pagina"], "landmark": True}
    a = chain({"tag": "a", "classes": ["voce-menu"]}, {"tag": "div", "classes": ["blocco-testo"], "id": "sez-uno"}, top)
    b = chain({"tag": "a", "classes": ["voce-menu"]}, {"tag": "div", "classes": ["blocco-testo"]}, top)
    inputs = spark.createDataFrame([(a,), (b,)], "signature_input string")
    stable = words(spark, "voce-menu", "blocco-testo", "corpo-pagina")
    assert len({s for (s,) in rows(ID.component_signatures(inputs, stable), "signature")}) == 2
    agreed = {s for (s,) in rows(ID.component_signatures(inputs, stable, words(spark, "radice")), "signature")}
    assert agreed == {"main.corpo-pagina > div.blocco-testo > a.voce-menu"}


def test_vendors_and_empty_chains(spark):
    cases = [
        (chain({"tag": "i", "classes": []}, vendor="Crisp"), "terze-parti:Crisp"),
        (chain({"tag": "i", "classes": []}, {"tag": "div", "classes": ["x", "uw-panel"]}), "terze-parti:UserWay"),
        (chain(), "unknown"),
        ("{broken", "{broken"),
        ("document", "document"),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "signature_input string")
    assert dict(rows(ID.component_signatures(df, words(spark)), "signature_input", "signature")) == dict(cases)


def test_rederived_signature_equals_recomputed(spark):
    """Composing the old way (hash classes kept) and re-deriving gives today's signature."""
    rng = random.Random(5)
    solid, hashed = ["voce-menu", "scheda-a", "elenco_b"], ["qwpzrS", "bcdfg"]
    data, old = [], []
    for _ in range(60):
        nodes = []
        for depth in range(rng.randint(1, 5)):
            cls = rng.choice([*solid, *hashed, None])
            nodes.append({"tag": rng.choice(["div", "span", "a", "li"]), "classes": [cls] if cls else []})
        nodes.append({"tag": "main", "classes": [rng.choice(solid + hashed)], "landmark": True})
        parts = [n["tag"] + (f".{n['classes'][0]}" if n["classes"] else "") for n in nodes]
        old.append(f"{parts[-1]} > {' > '.join(reversed(parts[:-1]))}")
        data.append(chain(*nodes))
    df = spark.createDataFrame(list(zip(data, old)), "signature_input string, composed string").dropDuplicates()
    now = ID.component_signatures(df.select("signature_input"), words(spark, *solid))
    both = df.join(now, "signature_input").select("signature", ID.rederive(F.col("composed")).alias("again"))
    assert both.filter("signature <> again").collect() == []


def test_rederive_keeps_vendors_and_consent(spark):
    df = spark.createDataFrame(
        [("terze-parti:Crisp", "terze-parti:Crisp"), ("banner-consenso > main.qwpzrS > div > div.bcdfg > a.bcdfg", "banner-consenso > main > a"), ("document", "document")],
        "c string, expected string",
    )
    assert df.filter(ID.rederive(F.col("c")) != F.col("expected")).collect() == []


def test_replay_is_idempotent(spark):
    text = chain({"tag": "a", "classes": ["voce-menu"]}, {"tag": "main", "classes": [], "landmark": True})
    ev = spark.createDataFrame([("1", text, "vecchia", "{}"), ("2", None, "main.qwpzrS > a", "{}")], "id string, signature_input string, component_signature string, data string")
    once = M.replay_signatures(ev, words(spark, "voce-menu"))
    assert rows(once, "id", "component_signature", "changed") == [("1", "main > a.voce-menu", True), ("2", "main > a", True)]
    assert M.replay_signatures(once.drop("changed"), words(spark, "voce-menu")).filter("changed").count() == 0


def test_replay_rederives_each_signature_once(spark):
    ev = spark.createDataFrame([("1", None, "main.qwpzrS > a", "{}"), ("2", "", "main.qwpzrS > a", "{}"), ("3", None, None, "{}")], "id string, signature_input string, component_signature string, data string")
    out = M.replay_signatures(ev, words(spark))
    assert "BroadcastHashJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "regexp_extract" not in plan
    assert rows(out, "id", "component_signature", "changed") == [("1", "main > a", True), ("2", "main > a", True), ("3", None, None)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(90)] + [("n000", n) for n in nodes[60:90]]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = E.connected_components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string"))
    assert dict(rows(got, "node", "component")) == {n: find(n) for n in nodes}


def language_case(spark, members, alternates=()):
    pages = spark.createDataFrame([(fp, u) for fp, urls in members.items() for u in urls], "fingerprint string, url string")
    tpl = pages.groupBy("fingerprint").agg(F.count("*").alias("page_count"))
    languages, shapes = E.dominant_language(pages), E.neutral_shapes(pages)
    alt = spark.createDataFrame(list(alternates), "url string, alt_url string") if alternates else None
    edges = E.variant_edges(languages, shapes, pages, alt)
    families = E.connected_components(languages.select(F.col("fingerprint").alias("node")), edges)
    roles = E.language_roles(tpl, languages, families)
    return {fp: (code, primary) for fp, code, primary in rows(roles, "fingerprint", "code", "is_primary")}


def urls(lang, section, n):
    return [f"https://x.example/{lang}/{section}/v{i}" for i in range(n)]


def test_language_families(spark):
    assert language_case(spark, {"a": urls("it", "blog", 20), "b": urls("en", "blog", 9)}) == {"a": ("it", True), "b": ("en", False)}
    assert language_case(spark, {"a": urls("it", "blog", 20), "b": urls("it", "blog", 9)}) == {"a": ("it", True), "b": ("it", True)}
    three = language_case(spark, {"a": urls("it", "blog", 20), "b": urls("en", "blog", 9), "c": urls("it", "blog", 5)})
    assert three == {"a": ("it", True), "b": ("en", False), "c": ("it", True)}
    slugs = {"a": urls("it", "eventi", 12), "b": urls("en", "events", 4)}
    assert language_case(spark, slugs) == {"a": ("it", True), "b": ("en", True)}
    declared = [("https://x.example/it/eventi/v1", "https://x.example/en/events/v1")]
    assert language_case(spark, slugs, declared) == {"a": ("it", True), "b": ("en", False)}
    assert language_case(spark, {"a": ["https://x.example/"], "b": ["https://x.example/servizi/x"]}) == {}


def test_signatures_meet_by_digest_and_only_common_chains_are_copied(spark):
    text = '{"chain":[{"tag":"a","classes":["x-%s"]},{"tag":"header","classes":[],"landmark":true}]}'
    chains = [text % i for i in range(1500)] + [text % "hot"] * 3000 + [None, "unknown"]
    rows = spark.createDataFrame([(i, c, "{}") for i, c in enumerate(chains)], "k int, signature_input string, data string")
    stable = spark.createDataFrame([("x-hot",), ("x-7",)], "token string")
    out = H.resolve_signatures(rows, stable)
    found = {r.k: r.component_signature for r in out.collect()}
    wanted = {7: "header > a.x-7", 1500: "header > a.x-hot", 4499: "header > a.x-hot", 4500: None, 4501: "unknown"}
    assert len(found) == len(chains) and all(found[k] == v for k, v in wanted.items())
    assert {found[k] for k in range(1500) if k != 7} == {"header > a"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line and "_salt" in line]
    assert joins and not any("signature_input" in line for line in joins)
    assert "_common" in plan
