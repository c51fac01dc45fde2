"""The pipeline against its stages done plainly, and its handling of odd tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import language
from tests.llm.test_native import dropped
from tests.llm.test_python import groups, near_case, tongue


@pytest.fixture(scope="module")
def corpus():
    import random

    rng = random.Random(1)
    speak = tongue(11, "aeilnorst")
    prose = tongue(12, "bcdfgimpu")
    rows = [(i, t, "xx", f"s{i % 3}") for i, t, *_ in near_case(lambda seed, n: prose(random.Random(seed), n))]
    rows += [(1000 + i, speak(rng, 40) + "\na line that all of these share\n" + speak(rng, 30), "yy", "hot") for i in range(40)]
    return rows + [(2000, "1234 5678 !!", "xx", "s0"), (2001, None, None, None)]


def run_stages(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_stages_against_plain_forms(spark, frame, corpus):
    docs = frame(corpus)
    spoken, lines, unique, mix, packed = run_stages(spark, docs)
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert ids(spoken) == sorted(i for i, t, *_ in corpus if any(c.isalpha() for c in t or ""))
    plain = {int(i): text for i, _, _, text in dropped([(r["doc_id"], r["text"]) for r in spoken])}
    assert {r["doc_id"]: r["text"] for r in lines} == plain and all(r["n_chars"] == len(r["text"]) for r in lines)
    assert sum("that all of these" in r["text"] for r in lines) == 1
    assert ids(unique) == sorted(i for i, _, _, kept in groups([(r["doc_id"], r["text"]) for r in lines]) if kept)
    taken = Counter(r["doc_id"] for r in mix)
    assert max(taken.values()) <= 2 and set(taken) <= set(ids(unique))
    words = sum(len(r["text"].split()) for r in mix)
    assert 0.9 <= words / (1.5 * sum(len(r["text"].split()) for r in unique)) <= 1.0
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken
    used = defaultdict(int)
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert set(docs.columns) == set(spoken[0]) == set(lines[0]) == set(unique[0]) == set(mix[0])


def test_run_is_the_chain_of_stages(spark, corpus, frame, tmp_path):
    frame(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    last = run_stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"))[-1]
    assert got == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in last)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_takes_odd_tables(spark, clashing, odd, name, stage):
    df = clashing(odd)
    out, empty = stage(spark, df, ""), stage(spark, df.limit(0), "")
    assert empty.count() == 0
    n = out.count()
    if name != "pack":
        assert out.columns == df.columns
    if name == "near_duplicates":
        assert out.filter("doc_id = 5").count() == 1 and out.filter("doc_id IS NULL").count() == 2 and n == len(odd) - 1
    if name == "lines":
        assert n == len(odd)


def test_clean_short_texts_are_accepted(spark, frame):
    rows = [(i, t, "en") for i, t in enumerate(["Hi.", "Yes", "A plain sentence in some language of the table."])]
    assert corpus_pipeline.known_language(spark, frame(rows), "").count() == 3
    judged = spark.createDataFrame([(9.0, 500, "en"), (2.0, 500, "en"), (9.0, 10, "en"), (0.0, 0, "und")], "bits double, symbols long, lang string")
    assert [r["ok"] for r in judged.select(language.accepted(F.col("bits"), F.col("symbols"), F.col("lang")).alias("ok")).collect()] == [False, True, True, False]


def test_only_learned_languages_stay(spark, frame):
    import random

    rng, letters = random.Random(4), "aeilnorstdmpu"
    speak = {"xx": tongue(31, letters), "yy": tongue(32, letters)}
    clean = [t(rng, 4 + 5 * (i % 20)) for t in speak.values() for i in range(40)]
    labelled = [(i, t, lang) for i, (lang, t) in enumerate((lang, t(rng, 60)) for lang, t in speak.items() for _ in range(30))]
    unlearned, noise = tongue(33, letters), lambda n: "".join(rng.choice(letters + "   ") for _ in range(n))
    foreign = [unlearned(rng, 20 + 9 * i) for i in range(20)] + [noise(90 + 60 * i) for i in range(20)] + ["Привет, мир", "да", "короткий текст", "中文", "Γειά σου Κόσμε"]
    rows = labelled + [(1000 + i, t) for i, t in enumerate(clean)] + [(5000 + i, t) for i, t in enumerate(foreign)]
    got = {r["doc_id"] for r in corpus_pipeline.known_language(spark, frame(rows), "").collect()}
    assert got == {i for i, *_ in rows if i < 5000}


def test_clean_texts_of_many_letters_stay(spark, frame):
    """Unseen words of many letters take more bits than six a symbol."""
    import random

    rng = random.Random(5)
    odds = [1 / (i + 1) for i in range(600)]
    speak = lambda n: "".join(chr(0x4E00 + i) for i in rng.choices(range(600), odds, k=n))
    rows = [(i, speak(400), "zh") for i in range(30)] + [(1000 + i, speak(20 + 40 * i)) for i in range(20)]
    assert corpus_pipeline.known_language(spark, frame(rows), "").count() == 50
