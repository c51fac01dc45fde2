"""Mixing, exact and line deduplication, personal data, URLs on small fixtures."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.llm import exact, lines, mixing, pii, urls

WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- mixing
def mixed(df, **options):
    return [r.asDict() for r in mixing.mix(df, carry=False, **options).collect()]


def test_targets_share_the_excess_of_dry_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    budget = 1.5 * 2510
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(budget)
    # null is the fourth source and weighs 3; it stops at 1000, b and c share the rest 1 : 2
    assert got[None] == 1000 and got["c"] == pytest.approx(2 * got["b"]) and got["c"] <= 2000


def test_mix_comes_near_its_targets(frame, prose):
    docs = [(i, prose(i, 20 + i % 30), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    got = mixed(frame(docs))
    assert len(got) == 600 and got == sorted(mixed(frame(docs, 7)), key=lambda r: [x["doc_id"] for x in got].index(r["doc_id"]))
    taken, target = Counter(), {}
    for r in got:
        assert r["size"] == len(re.findall(WORD, docs[r["doc_id"]][1])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(taken.values()) <= 1.5 * sum(r["size"] for r in got)
    for source, words in taken.items():
        assert abs(words - target[source]) <= 60


def test_mix_of_odd_rows(frame, clashing, odd):
    got = mixed(frame(odd))
    assert len(got) == len(odd) and {r["taken"] for r in got if r["size"] == 0} == {0}
    assert sorted(map(str, mixed(frame(odd, 1)))) == sorted(map(str, got))
    df = clashing(odd)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    empty = frame(odd).limit(0)
    assert mixed(empty) == [] and mixing.mixed(empty).count() == 0
    assert {r["taken"] for r in mixed(frame([(1, ""), (2, None)]))} == {0}


# ---------------------------------------------------------------- exact
def test_exact_groups(frame, odd):
    rows = odd + [(10, "A  b\tc"), (11, "A b\nc"), (12, "a b c"), (13, "A b c "), (14, "A b c\r\n")]
    got = [r.asDict() for r in exact.deduplicate(frame(rows)).drop("row").collect()]
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
    want = sorted(
        (str(i), str(min((x for x, u in norm if u == t and x is not None), default=None)), sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm
    )
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["digest"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_content_decides_where_digests_meet(frame):
    rows = [(i, f"text {i % 4}") for i in range(40)]
    weak = exact.deduplicate(frame(rows), digest=lambda text: F.length(text).cast("string"))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in weak.collect()) == [(i, i % 4, 10) for i in range(40)]


def test_exact_keeps_clashing_columns(clashing, odd):
    df = clashing(odd)
    assert exact.deduplicate(df).select("row.*").columns == df.columns
    assert exact.deduplicate(df.limit(0)).count() == 0


# ---------------------------------------------------------------- lines
def dropped(rows, min_chars=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    holders = Counter(k for _, ls in split for k in {key(x) for x in ls})
    first = {}
    for i, ls in split:
        for x in ls:
            first[key(x)] = min(first.get(key(x), float("inf")), float("inf") if i is None else i)
    out = []
    for i, ls in split:
        kept = [x for x in ls if len(key(x)) < min_chars or holders[key(x)] < 2 or first[key(x)] == (float("inf") if i is None else i)]
        out.append((str(i), len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_brute_force(frame, odd):
    rows = odd + [
        (20, "Shared line here\nown line number one\nshort\nShared line here"),
        (21, "  SHARED LINE HERE \r\nshort\nother"),
        (22, "ÀSHARED line hereÀ\nàSHARED LINE HEREà\nx"),
        (23, "shared line here"),
        (None, "shared line here\nkept by nobody else"),
        (24, "ends with nel\u0085 \nends with nel\u0085 "),
        (25, "ends with nel\u0085"),
    ]
    got = lines.drop_shared_lines(frame(rows)).drop("row").collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == dropped(rows)


def test_lines_keep_clashing_columns(clashing, odd):
    df = clashing(odd)
    out = lines.drop_shared_lines(df)
    assert out.select("row.*").columns == df.columns and out.count() == len(odd)
    assert lines.drop_shared_lines(df.limit(0)).count() == 0


# ---------------------------------------------------------------- personal data
def spans(frame, text):
    r = pii.find(frame([(1, text)])).collect()[0]
    return [(s["kind"], s["value"], s["start"], s["end"]) for s in r["spans"]]


def test_base_spans_have_code_point_places(frame):
    text = "𝒳 mail a.b+c@d-e.org, then x@y and 10.0.0.255 256.1.1.1 call +1 (988) 555-2485."
    got = spans(frame, text)
    assert [g[:2] for g in got] == [("email", "a.b+c@d-e.org"), ("ip", "10.0.0.255"), ("phone", "+1 (988) 555-2485")]
    assert all(text[s:e] == v for _, v, s, e in got)


def test_checksums_decide(frame):
    assert spans(frame, "card 4111 1111 1111 1111 4111 1111 1111 1112") == []  # one run of 32 digits
    assert [g[0] for g in spans(frame, "4111-1111-1111-1111, 4111-1111-1111-1112")] == ["card"]
    assert [g[0] for g in spans(frame, "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00")] == ["iban"]
    assert spans(frame, "number 123-45-6789 alone") == [] and [g[0] for g in spans(frame, "SSN 123-45-6789")] == ["ssn"]


def test_base_matches_plain_patterns(frame):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "card": r"[0-9]([\x20-]?[0-9])+",
    }
    tricky = [
        "a@b.c+x@y.z_q@r.s.", "1.2.3.4.5.6.7.8 999.1.1.1.2 01.002.0003.4", "@@a@b@c.d a@b..c -x@-.-", "+1+22 33 44 55 66-+1234567890123456 +1 2", "4242 4242-4242 4242 4 4242424242424242 49927398716",
        "1" * 3000 + ".1.1.1", "x" * 3000 + "@" + "y." * 2000 + "z", "",
    ]
    rows = pii.find(frame(list(enumerate(tricky)))).collect()
    for r in rows:
        text = tricky[r["doc_id"]]
        want = []
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                total = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits)))
                fine = {
                    "email": True,
                    "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "phone": 9 <= len(digits) <= 15,
                    "card": 12 <= len(digits) <= 19 and total % 10 == 0,
                }
                if fine[kind]:
                    want.append((m.start(), kind, m.end()))
        assert sorted((s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE) == sorted(want), text[:60]


def test_personal_data_of_odd_rows(frame, clashing, odd):
    assert pii.find(frame(odd)).count() == len(odd)
    df = clashing(odd)
    assert pii.find(df).select("row.*").columns == df.columns and pii.find(df.limit(0)).count() == 0


# ---------------------------------------------------------------- URLs
def pages(spark, entries):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(entries)], "page_id long, url string, html string")


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_and_parts(spark):
    some = [
        "https://www.Example.com/en/1?x#y", "http://a.example.com/en/2", "http://example.com/es/", "http://evil-example.com/en/1", "ftp://x.net/es/1", "ftp://net/fr/", "http://x.net", "no scheme",
        None, "a://b://c.com/d", "http://x.com?q=/en/", "http://x.com#/", "://COM/", "http://é.org/ü?a=1&b=2", "http://x.example.com/english", "", "http://",
    ] + [f"https://s{i}.example.{t}/{p}/{i}" for i in range(20) for t in ("net", "com", "org") for p in ("en", "es")]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, some)).collect()}
    for i, u in enumerate(some):
        host, path, rule, verdict = rule_of(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    again = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, some).repartition(5)).collect()}
    assert again == {i: r["verdict"] for i, r in got.items()}


def test_trees_learn_what_labels_show(spark):
    """Long paths full of digits are blocked; the suffix says nothing."""
    rules = (urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "good.org", "/"))
    train = [f"http://h{i}.bad.org/" + "9" * (30 + i % 7) + f"?a={i}" for i in range(80)] + [f"http://h{i}.good.org/about" for i in range(80)]
    new = ["http://k.new.org/" + "9" * 33 + "?a=1", "http://k.new.org/about"]
    got = {r["url"]: r["verdict"] for r in urls.judge(pages(spark, train + new), rules).select("row.url", "verdict").collect()}
    assert [got[u] for u in new] == ["block", "allow"]


def test_urls_without_labels(spark):
    assert urls.judge(pages(spark, [])).count() == 0
    assert {r["verdict"] for r in urls.judge(pages(spark, ["x://y.org/", None])).collect()} == {"allow"}
    assert {r["verdict"] for r in urls.judge(pages(spark, ["x://y.net/es/", "x://z.org/"])).collect()} == {"block"}
    named = pages(spark, ["x://y.org/"] * 2).withColumns({c: F.lit(1) for c in ("row", "host", "path", "fits", "features", "prediction", "tld_rate")})
    assert urls.judge(named).select("row.*").columns == named.columns


def test_all_labels_count(spark):
    """One URL in a third of all rows and first by digest, a rare kind, and a suffix of few labels."""
    rules = (urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "good.org", "/"))
    many = [f"http://h{i}.good.org/about" for i in range(200)]
    digest = lambda u: hashlib.md5(u.encode()).hexdigest()
    first = min((f"http://r{i}.good.org/" for i in range(30000)), key=digest)
    rare = sorted((f"http://h{i}.bad.org/" + "9" * (30 + i % 7) for i in range(400)), key=digest)[-4:]
    assert digest(first) < min(map(digest, many)) and digest(rare[0]) > sorted(map(digest, many))[40]
    new = ["http://k.new.org/" + "9" * 33, "http://k.new.org/about"]
    got = urls.judge(pages(spark, [first] * 100 + many + rare + new), rules, sample=40)
    found = {r["url"]: r["verdict"] for r in got.select("row.url", "verdict").collect()}
    assert got.count() == 100 + len(many) + len(rare) + len(new)
    assert [found[u] for u in new] == ["block", "allow"]
    rates = {r["domain"]: r["domain_rate"] for r in urls._rates(spark.createDataFrame([("a.b", 1.0)] * 6 + [("c.d", 0.0)] * 2, "domain string, label double"), "domain").collect()}
    assert rates == {"a.b": 7 / 8, "c.d": 1 / 4}
