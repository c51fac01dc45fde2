import random

from auditlake.operators import checks_measured as G
from auditlake.operators import evidence as H
from tests.conftest import rows

STOP = "url string, idx int, selector string, component string, label string, tag string, html string, top double, visible boolean, outline_style string, outline_width string, box_shadow string, tabindex string"


def walk(spark, selectors, tops=None, url="u"):
    tops = tops or [float(i) for i in range(len(selectors))]
    data = [(url, i, s, "c", "l", "a", "<a>", t, True, "solid", "2px", "", None) for i, (s, t) in enumerate(zip(selectors, tops))]
    return spark.createDataFrame(data, STOP)


def checks(spark, stops, *urls):
    pages = spark.createDataFrame([(u,) for u in urls or ("u",)], "url string")
    return rows(G.keyboard_checks(pages, stops), "check_id", "ordinal")


def test_fourth_visit_ends_the_walk(spark):
    stops = walk(spark, ["a", "b", "a", "c", "a", "a", "d", "b"])
    assert checks(spark, stops) == [("keyboard-trap-suspected", 5)]
    assert len(rows(G.tab_order(stops))) == 6


def test_backward_jumps_need_three(spark):
    two = walk(spark, list("abcde"), [500.0, 0.0, 500.0, 0.0, 500.0])
    three = walk(spark, list("abcdefg"), [500.0, 0.0, 500.0, 0.0, 500.0, 0.0, 0.0])
    exact = walk(spark, list("abcdefg"), [80.0, 0.0, 80.0, 0.0, 80.0, 0.0, 0.0])
    assert checks(spark, two) == [] and checks(spark, exact) == []
    assert checks(spark, three) == [("focus-order-suspicious", 0)]


def test_page_without_stops(spark):
    assert checks(spark, walk(spark, ["a"]), "u", "muta") == [("keyboard-no-focusable", 0)]


def test_chunked_lag_equals_plain_lag(spark):
    rng = random.Random(1)
    data = [(rng.choice("xy"), i, float(rng.randint(0, 9))) for i in rng.sample(range(100000), 400)]
    df = spark.createDataFrame(data, "k string, i long, v double")
    got = {(k, i): p for k, i, p in rows(G.previous_value(df, "k", "i", "v", "p", chunk=37), "k", "i", "p")}
    for key in "xy":
        last = None
        for _, i, v in sorted(r for r in data if r[0] == key):
            assert got[(key, i)] == last
            last = v


def sample(spark, *entries):
    ddl = "url string, ordinal int, selector string, signature string, state string, color string, bg_chain array<string>, font_size double, font_weight string, painted boolean"
    return spark.createDataFrame(entries, ddl)


def test_contrast_layers(spark):
    entries = [
        ("u", 1, "a", "s", "rest", "rgb(0, 0, 0)", ["rgb(255, 255, 255)"], 12.0, "400", False),
        ("u", 2, "a", "s", "rest", "rgb(0, 0, 0)", ["transparent", "rgba(0,0,0,0)"], 12.0, "400", False),
        ("u", 3, "a", "s", "rest", "rgba(0, 0, 0, 0.5)", ["rgb(255, 255, 255)"], 12.0, "400", False),
        ("u", 4, "a", "s", "rest", "rgb(0, 0, 0)", ["rgba(0, 0, 0, 0.5)", "rgba(0, 0, 0, 0.5)"], 12.0, "400", False),
        ("u", 5, "a", "s", "rest", "red", ["rgb(255, 255, 255)"], 12.0, "400", False),
    ]
    got = dict(rows(G.with_contrast(sample(spark, *entries)), "ordinal", "ratio"))
    assert got == {1: 21.0, 2: 21.0, 3: 3.98, 4: 1.0, 5: None}


def test_hover_thresholds(spark):
    white = ["rgb(255, 255, 255)"]

    def pair(i, size, weight, hover, rest="rgb(0, 0, 0)"):
        return [("u", i, "a", f"s{i}", "rest", rest, white, size, weight, False), ("u", i, "a", f"s{i}", "hover", hover, white, size, weight, False)]

    grey = "rgb(130, 130, 130)"
    data = pair(1, 12.0, "400", grey) + pair(2, 24.0, "400", grey) + pair(3, 19.0, "700", grey) + pair(4, 19.0, "400", grey)
    data += pair(5, 12.0, "400", "rgb(0, 0, 0)") + pair(6, 12.0, "400", grey, "rgb(254, 254, 254)")
    assert rows(G.hover_contrast_check(sample(spark, *data)), "ordinal") == [(1,), (4,)]


def test_overlap_messages(spark):
    drop = ["Element is overlapped by another element", "Element partially overlaps other elements"]
    keep = ["contains an image node", "background gradient", "insufficient contrast of 2.1", "overlapping"]
    ddl = "checks array<struct<message:string>>, expected boolean"
    data = [([(m,)], True) for m in drop] + [([(m,)], False) for m in keep] + [([], False), (None, False)]
    df = spark.createDataFrame(data, ddl)
    assert df.filter(H.blocked_by_overlap(df["checks"]) != df["expected"]).count() == 0


def test_consent_mark_keeps_the_record(spark):
    data = [("u", 5, "{}", "x"), ("u", 6, '{"a":1}', "y"), ("u", 9, "{}", "z"), ("v", 5, "{}", "x")]
    df = spark.createDataFrame(data, "url string, ordinal int, data string, observation string")
    marked = H.mark_consent(df, spark.createDataFrame([("u", 4, 6)], "url string, ordinal int, last int"))
    assert rows(marked.filter(H.is_consent_marked(marked["data"])), "url", "ordinal") == [("u", 5), ("u", 6)]
    assert rows(marked.selectExpr("get_json_object(data, '$.a') a"), "a") == [("1",), (None,), (None,), (None,)]


def test_rule_texts_never_have_holes(spark):
    from auditlake.sources import logs

    line = '{"url":"u","violations":[{"id":"color-contrast","help":"h","description":"d","helpUrl":"","tags":[],"nodes":[{"html":"x","target":"a","any":[{"id":"c","message":"m","data":"{\\"contrastRatio\\":0}"}]},{"html":"x","target":"a"}]},{"id":"target-size","help":"h","tags":[],"nodes":[{"target":"a","any":[]}]}]}'
    obs = H.rule_observations(logs.parse_rule_results(spark.createDataFrame([(line,), ("",)], "value string")))
    texts = [o for (o,) in rows(obs, "observation")]
    assert len(texts) == 3 and all(t and "null" not in t and "undefined" not in t for t in texts)
    assert rows(obs, "check_id", "criteria")[-1] == ("axe:target-size", ["2.5.8"])
