import itertools
import json
import random

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.operators import findings as I
from auditlake.operators import quality as J
from auditlake.operators import replay as M
from auditlake.operators import triage as T
from auditlake.sources import logs
from auditlake.streaming import intake
from tests.conftest import rows

EVIDENCE = "id string, check_id string, page_url string, site_id string, fingerprint string, criteria array<string>, selector string, component_signature string, observation string, data string, engine_impact string, ordinal int"


def evidence(spark, n=40):
    rng = random.Random(2)
    checks = [("landmark-no-main", ["1.3.1"]), ("focus-not-visible", ["2.4.7"]), ("axe-incomplete:color-contrast", ["1.4.3"]), ("axe:label", ["3.3.2", "4.1.2"]), ("img-alt-too-long", ["1.1.1"])]
    data = []
    for i in range(n):
        check, criteria = rng.choice(checks)
        data.append((f"{i:016x}", check, f"https://x.example/{i % 9}", "x", f"t{i % 4}", criteria, "a", rng.choice(["main > a", "main > b", ""]), "o", "{}", "serious", i))
    return spark.createDataFrame(data, EVIDENCE)


def analysed(spark, ev):
    templates = spark.createDataFrame([(f"t{i}", 10 * i) for i in range(4)], "fingerprint string, page_count long")
    sites = spark.createDataFrame([("x", "primary")], "site_id string, tier string")
    return I.analyse(ev, templates, sites)


def test_a_machine_never_fails_an_undecidable_criterion(spark):
    found = analysed(spark, evidence(spark)).findings
    assert found.filter("verdict = 'fail' and not can_fail").count() == 0
    assert found.filter("check_id like 'axe-incomplete:%' and verdict <> 'needs-review'").count() == 0
    assert {v for (v,) in rows(found.filter("check_id = 'focus-not-visible'"), "verdict")} == {"fail"}


def test_partitioning_does_not_matter(spark):
    one, many = (rows(analysed(spark, evidence(spark).repartition(n)).findings.drop("criteria")) for n in (1, 8))
    assert one == many


def test_hot_finding_keeps_and_cites_every_row(spark):
    ev = spark.range(3000).select(
        F.format_string("%016x", "id").alias("id"), F.lit("link-generic-text").alias("check_id"), F.concat(F.lit("https://x.example/"), "id").alias("page_url"),
        F.lit("x").alias("site_id"), F.lit("t1").alias("fingerprint"), F.array(F.lit("2.4.4")).alias("criteria"), F.lit("a").alias("selector"),
        F.concat(F.lit("main > a.c"), F.col("id") % 700).alias("component_signature"), F.lit("o").alias("observation"), F.lit("{}").alias("data"),
        F.lit("moderate").alias("engine_impact"), F.lit(0).alias("ordinal"),
    )
    a = analysed(spark, ev)
    row = a.findings.collect()
    assert len(row) == 1 and (row[0]["page_count"], row[0]["component_count"], row[0]["evidence_count"]) == (3000, 700, 3000)
    assert a.components.count() == 700
    assert sorted(r for (r,) in rows(a.citations, "rank")) == list(range(1, 3001))
    assert I.cite(ev, limit=25).count() == a.cited(25).count() == 25
    assert row[0]["component"].endswith("e altri 699 componenti")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_found_without_sorting_the_evidence(spark):
    """Also with nulls and repeated rows, the first of a group is the least of all its rows."""
    rng = random.Random(4)
    pick = lambda *values: rng.choice([None, *values])
    data = [
        (pick("1", "2"), rng.choice(["focus-not-visible", "axe:label"]), pick("p", "q"), "x", pick("t"), ["2.4.7"], "a", pick("main > a", "main > b", ""), pick("o", "u"), "{}", "serious", pick(0, 1, 2))
        for _ in range(80)
    ]
    ev = spark.createDataFrame(data + data[:20], EVIDENCE)
    got = I.group_evidence(ev)
    assert "LeftSemi" in planned(got)
    named = F.when(F.col("component_signature") != "", F.struct(*I.FIRST, "component_signature"))
    want = ev.withColumn("key", I.dedupe_key()).groupBy("key").agg(
        F.min(F.struct(*I.FIRST, "component_signature", "data", "observation")).alias("f"), F.min(named).alias("n"), F.count("*").alias("c")
    )
    assert rows(got, "key", "first.component_signature", "first.observation", "first_component", "evidence_count") == rows(
        want, "key", "f.component_signature", "f.observation", "n.component_signature", "c"
    )
    assert planned(I.touches(ev)).count("Exchange") == 1


def test_keys_are_made_before_rows_are_taken_apart(spark):
    plan = I.touches(evidence(spark))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode")
    assert "get_json_object" not in above and "get_json_object" in below


def test_cited_records_cross_one_shuffle(spark):
    ev = evidence(spark, 30).withColumn("page_url", F.when(F.col("ordinal") % 3 > 0, F.col("page_url")))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    cited = I.cite(ev)
    spark.conf.set(conf, "-1")
    try:
        whole = I.cited_evidence(cited.localCheckpoint(), ev.localCheckpoint(), "selector", "component_signature")
        assert planned(whole).count("Exchange hashpartitioning") == 2
        assert whole.count() == 30
    finally:
        spark.conf.set(conf, old)


def test_priority_equals_a_global_sort(spark):
    found = analysed(spark, evidence(spark, 200)).findings
    got = [i for i, _ in sorted(((r["finding_id"], r["priority"]) for r in I.with_priority(found).collect()), key=lambda x: x[1])]
    assert got == [r["finding_id"] for r in I.ranked(found).collect()]


def test_criteria_dimension(spark):
    c = dims.criteria(spark)
    assert c.filter("baseline").count() == 50 and c.filter("not baseline").count() == 6
    certain = {i for (i,) in rows(c.filter("baseline and automation = 'deterministic'"), "criterion")}
    assert certain == {"1.3.4", "1.3.5", "1.4.3", "1.4.10", "1.4.12", "2.1.2", "2.4.7", "2.5.3", "3.1.1", "3.3.2", "4.1.1"}
    texts = dims.texts(spark)
    assert texts.count() == texts.select("text_key").distinct().count() == 73


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    weak = {".w1", ".w2", "#w3"}
    marks = ["", ".s1", ".s2", ".w1", ".w2", "#w3"]
    comps = sorted({" > ".join(t + rng.choice(marks) for t in ("main", "div", "a")) for _ in range(60)})
    titles = {c: f"T{rng.randint(0, 5)}" for c in comps}
    findings = spark.createDataFrame([(f"f{i}", titles[c], c) for i, c in enumerate(comps)], "finding_id string, title string, component string")
    spread = spark.createDataFrame([(w, 1, True) for w in weak] + [(".s1", 9, False)], "token string, pages long, weak boolean")

    def mark(d):
        cut = min((d.index(x) for x in ".#" if x in d), default=len(d))
        return d[cut:]

    expected = set()
    for a, b in itertools.combinations(comps, 2):
        if titles[a] != titles[b]:
            continue
        diff = [(x, y) for x, y in zip(map(mark, a.split(" > ")), map(mark, b.split(" > "))) if x != y]
        if diff and all(x in weak or y in weak for x, y in diff):
            expected.add(titles[a])
    assert {t for (t,) in rows(J.duplicate_groups(findings, spread), "title")} == expected


def test_blocking_issue_breaks_trust(spark):
    issues = spark.createDataFrame([("a", "nota", "m", []), ("b", "bloccante", "m", [])], J.ISSUE_DDL)
    assert rows(J.trustworthy(issues)) == [(2, False)] and rows(J.trustworthy(issues.limit(0))) == [(0, True)]


def test_collapsed_cluster_is_blocking(spark):
    pages = spark.createDataFrame([("mixed-x", f"https://x.example/s{i % 4}/{i}") for i in range(50)] + [("t", "https://x.example/a")], "fingerprint string, url string")
    tpl = pages.groupBy("fingerprint").agg(F.count("*").alias("page_count"))
    assert rows(J.mixed_issue(tpl, pages), "severity") == [("bloccante",)]
    one = pages.withColumn("url", F.lit("https://x.example/news/a"))
    assert rows(J.mixed_issue(tpl, one), "severity") == [("nota",)]


def test_triage_cap(spark):
    ddl = "finding_id string, verdict string, confidence double, title string, description string, remediation string, code_example string, owner string, effort string, ai_generated boolean, can_fail boolean"
    found = spark.createDataFrame(
        [("f1", "needs-review", 0.3, "t", "d", "r", None, "cms", "basso", False, False), ("f2", "fail", 0.9, "t", "d", "r", "c", "cms", "basso", False, True),
         ("f3", "needs-review", 0.5, "t", "d", "r", None, "cms", "basso", False, True)], ddl)
    answers = spark.createDataFrame(
        [("f1", "fail", 0.9, "nuovo", "", "r2", None, "design", "alto", "a", 0), ("f2", "pass", 0.8, "", "d2", "", None, "cms", "basso", "a", 1),
         ("f3", "pass", 0.8, "", "", "", None, "cms", "basso", "a", 2), ("f3", "fail", 0.8, "", "", "", None, "cms", "basso", "b", 0)],
        "finding_id string, verdict string, confidence double, title string, description string, remediation string, code_example string, owner string, effort string, file string, position int")
    merged, refused = T.apply_triage(found, answers)
    got = {r["finding_id"]: r for r in merged.collect()}
    assert (got["f1"]["verdict"], got["f1"]["title"], got["f1"]["description"], got["f1"]["remediation"]) == ("needs-review", "nuovo", "d", "r2")
    assert got["f2"]["verdict"] == "pass" and got["f2"]["code_example"] == "c" and got["f2"]["description"] == "d2"
    assert got["f3"]["verdict"] == "fail" and got["f3"]["promoted"] and not got["f1"]["promoted"]
    assert rows(refused) == [("f1", "fail", "needs-review")]


def test_answers_with_fences_and_errors(spark):
    good = {"schemaVersion": "1.0", "packId": "p", "findings": [{"id": "f", "verdict": "pass", "confidence": 1, "title": "t", "description": "d", "remediation": "r", "owner": "cms", "effort": "alto", "rationale": "x"}]}
    bad = {**good, "findings": [{**good["findings"][0], "confidence": 1.5}]}
    files = [("a", json.dumps(good)), ("b", f"```json\n{json.dumps(good)}\n```\n"), ("c", json.dumps(bad)), ("d", "ciao"), ("e", json.dumps(good)[:-5])]
    answers, rejected = T.parse_answers(spark.createDataFrame(files, "file string, content string"))
    assert rows(answers, "file", "finding_id") == [("a", "f"), ("b", "f")] and rows(rejected) == [("c",), ("d",), ("e",)]


def result(i, **extra):
    ev = [{"id": f"e{i}", "checkId": "c", "pageUrl": f"u{i}", "selector": "a", "componentSignature": "s", "criteria": ["1.1.1"], "data": {"n": i}}]
    return {"url": f"u{i}", "siteId": "x", "evidence": ev, "passedRules": [], "durationMs": i, **extra}


def test_interrupted_log_resumes_to_the_same_evidence(spark, tmp_path):
    lines = [json.dumps(result(i)) for i in range(10)]
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(lines[:5]) + "\n\n" + lines[5][:60])
    previous, rejected = logs.parse_results(logs.read_lines(spark, str(log)))
    assert previous.count() == 5 and rejected.count() == 1
    whole = logs.parse_results(spark.createDataFrame([(x,) for x in lines], "value string"))[0]
    todo = M.pending_pages(whole.select("url"), previous)
    assert todo.count() == 5
    resumed = M.resume(previous, whole.join(todo, "url", "left_semi").select(*whole.columns))
    assert M.same_evidence(logs.evidence_of(resumed), logs.evidence_of(whole)).count() == 0
    assert logs.read_lines(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_stream_intake_keeps_each_page_once(spark, tmp_path):
    inbox, target, bad, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state")
    inbox.mkdir()

    def take():
        for query in intake.scan_intake(spark.readStream.text(str(inbox)), target, bad, state):
            query.awaitTermination()

    (inbox / "1.jsonl").write_text("\n".join(json.dumps(result(i)) for i in range(4)) + "\n" + json.dumps(result(9))[:40])
    take()
    slow = json.dumps(result(7) | {"durationMs": 99})
    (inbox / "2.jsonl").write_text("\n".join([slow, *(json.dumps(result(i)) for i in range(2, 10))]))
    take()
    assert rows(spark.read.parquet(target), "url", "duration_ms") == [(f"u{i}", i) for i in range(10)]
    assert rows(spark.read.parquet(bad)) == [(json.dumps(result(9))[:40],)]


def test_stream_intake_keeps_no_state_and_asks_the_store(spark, tmp_path):
    inbox, target, bad, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state")
    inbox.mkdir()

    def line(i, ms, title):
        return json.dumps(result(i) | {"durationMs": ms, "title": title})

    for n, lines in enumerate([[line(1, 9, "a"), line(1, 5, "b"), line(1, 5, "a"), line(2, 7, "x")], [line(1, 1, "late"), line(3, None, "z"), line(3, 8, "y")]]):
        (inbox / f"{n}.jsonl").write_text("\n".join(lines))
        for query in intake.scan_intake(spark.readStream.text(str(inbox)), target, bad, state):
            query.awaitTermination()
            assert all(not p["stateOperators"] for p in query.recentProgress)
    assert rows(spark.read.parquet(target), "url", "duration_ms", "title") == [("u1", 5, "a"), ("u2", 7, "x"), ("u3", 8, "y")]


def test_review_stream_latest_wins(spark, tmp_path):
    inbox, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def say(name, *decisions):
        (inbox / name).write_text("\n".join(json.dumps({"finding_id": f, "outcome": o, "note": "", "reviewer": "r", "ts": ts}) for f, o, ts in decisions))
        intake.review_intake(spark.readStream.schema(intake.REVIEW_DDL).json(str(inbox)), target, state).awaitTermination()

    say("1.json", ("f1", "conforme", "2026-01-01T10:00:00Z"), ("f2", "boh", "2026-01-01T10:00:00Z"))
    say("2.json", ("f1", "non-conforme", "2026-01-02T10:00:00Z"), ("f3", "irrilevante", "2026-01-02T10:00:00Z"))
    say("3.json", ("f1", "irrilevante", "2026-01-01T09:00:00Z"), ("f5", "boh", "2026-01-03T10:00:00Z"))
    kept = rows(intake.read_reviews(spark, target), "finding_id", "outcome")
    assert kept == [("f1", "non-conforme"), ("f3", "irrilevante")]  # one row a finding, the later one
    state = str(tmp_path / "again")  # all files once more, as after a lost checkpoint
    say("4.json")
    assert rows(intake.read_reviews(spark, target), "finding_id", "outcome") == kept
    findings = spark.createDataFrame([(f, "needs-review") for f in ("f1", "f2", "f3", "f4")], "finding_id string, verdict string")
    done = T.apply_reviews(findings, intake.read_reviews(spark, target))
    assert rows(done, "finding_id", "verdict") == [("f1", "fail"), ("f2", "needs-review"), ("f3", "needs-review"), ("f4", "needs-review")]
    assert rows(T.review_progress(done)) == [(2, 2)]


def test_run_store_replaces_one_run(spark, tmp_path):
    root = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    logs.store_run({"findings": df}, root, "r1")
    logs.store_run({"findings": df}, root, "r2")
    logs.store_run({"findings": df.withColumn("v", F.lit(2))}, root, "r1")
    assert rows(logs.read_run(spark, root, "findings", "r1")) == [("a", 2)] and rows(logs.read_run(spark, root, "findings", "r2")) == [("a", 1)]
    kept = M.reuse_discovery({"pages": df, "evidence": df, "findings": df})
    assert {k: v.count() for k, v in kept.items()} == {"pages": 1, "evidence": 0, "findings": 0}
    assert spark.sql("select current_timestamp() - interval 100 minutes as started_at").select(M.run_age_hours()).first()[0] == 2


def test_run_document_and_reports(spark, tmp_path):
    doc = tmp_path / "run.json"
    doc.write_text(json.dumps({"project": "p", "pages": [{"url": "u1"}, {"url": "u2"}], "templates": [{"fingerprint": "t", "pageCount": 2}], "findings": []}, indent=1))
    loaded = logs.load_run(spark, str(doc))
    assert rows(loaded["pages"]) == [("u1",), ("u2",)] and "findings" not in loaded
    logs.write_reports({"pagine": loaded["pages"]}, str(tmp_path / "rep"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "rep" / "pagine")).count() == 2


def test_gates_count_and_examples_are_rows(spark):
    classes = [f"xK{i}d" for i in range(30)]
    found = [(f"f{i}", f"NaN titolo {i}", "testo", f"div.{c} > a", "x") for i, c in enumerate(classes)]
    found += [(f"g{i}", "Titolo", "testo", f"p.solo{i}", "y") for i in range(2)]
    findings = spark.createDataFrame(found, "finding_id string, title string, description string, component string, check_id string")
    evidence = spark.createDataFrame([(f"u{i}", f"p.solo{i}") for i in range(2)], "page_url string, component_signature string")
    scanned = F.lit(100)
    tables = spark.createDataFrame([], "fingerprint string, page_count long"), spark.createDataFrame([], "fingerprint string, url string")
    issues = {r["kind"]: r for r in J.self_check(findings, evidence, *tables, F.lit(2), F.lit(100)).collect()}
    told = rows(J.examples(findings, evidence, scanned))
    for kind, n in (("duplicate-findings", 1), ("unstable-signature", 30), ("untranslated-text", 30)):
        own = [(severity, example) for k, severity, example in told if k == kind]
        assert not issues[kind]["samples"] and issues[kind]["message"].startswith(f"{n} ")
        assert len(own) == n and {severity for severity, _ in own} == {issues[kind]["severity"]}
    assert {e for k, _, e in told if k == "unstable-signature"} == set(classes)


def test_a_finding_on_a_million_pages_is_ranked_in_many_tasks(spark):
    """The largest task holds a share of it, not all."""
    from auditlake.functions import running

    n = 1_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.lit("rare")).otherwise(F.lit("hot")).alias("key"), F.md5(F.col("id").cast("string")).alias("page"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = running.ranked(rows, "key", ["page"], "rank")
        checked = ranked.groupBy("key", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("kinds")).collect()
        order = ranked.groupBy("key").agg(F.min_by("page", "rank").alias("first"), F.min("page").alias("least")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key, size in (("hot", n * 9 // 10), ("rare", n // 10)):
        own = [r for r in checked if r["key"] == key]
        assert sum(r["n"] for r in own) == sum(r["kinds"] for r in own) == max(r["high"] for r in own) == size and min(r["low"] for r in own) == 1
    assert max(r["n"] for r in checked) < n // 8
    assert all(r["first"] == r["least"] for r in order)


def test_running_sums_of_ties_and_nulls(spark):
    from auditlake.functions import running

    rows = [(k, o, v) for k in ("a", None, "b") for o, v in ((None, 5), ("x", 1), ("x", 1), ("y", 2))]
    df = spark.createDataFrame(rows, "k string, o string, v long").repartition(3)
    got = running.running_sum(df, "k", ["o"], F.col("v"), "s")
    assert sorted((r["k"] or "", r["s"]) for r in got.collect()) == sorted((k or "", s) for k in ("a", None, "b") for s in (5, 6, 7, 9))
    assert running.ranked(df.limit(0), "k", ["o"], "r").count() == 0


def test_ranks_need_a_window_over_ranges_only(spark):
    from auditlake.functions import running

    data = [(k, o, i) for i, (k, o) in enumerate(itertools.product(("a", None, "b"), [*range(50), None, 7]))]
    ranked = running.ranked(spark.createDataFrame(data, "k string, o int, i int").repartition(5), "k", ["o", "i"], "r")
    assert planned(ranked).count("Window [") == 1
    wanted = {i: sorted([(n is not None, n or 0, j) for q, n, j in data if q == k]).index((o is not None, o or 0, i)) + 1 for k, o, i in data}
    assert {r.i: r.r for r in ranked.collect()} == wanted and set(ranked.columns) == {"k", "o", "i", "r"}
