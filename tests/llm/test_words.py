"""Spelling variants, token files and collocations against plain versions on small fixtures."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.lineage import folder
from auditlake.llm import phrases, spelling, tokenfiles

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(CAPITALS, CAPITALS.lower())


# ---------------------------------------------------------------- spelling
def grouped(counts, ratio=spelling.RATIO):
    """Forms and roots by comparing all words."""

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {}
    for a, own in near.items():
        best = min(own, key=lambda b: (-counts[b], b), default=None)
        if best is not None and counts[best] >= ratio * counts[a]:
            form[a] = best
    out = {}
    for a in counts:
        root = a
        while root in form:
            root = form[root]
        out[a] = (form.get(a), root, counts[a], len(near[a]), counts[form[a]] if a in form else None)
    return out


def found(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàö"])
def test_variants_against_all_pairs(spark, letters):
    rng = random.Random(letters)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)}
    for word in list(words):  # edits at every place, first and last letters too
        for _ in range(4):
            at, kind = rng.randint(0, len(word)), rng.choice("idr")
            new = word[:at] + (rng.choice(letters) if kind != "d" else "") + word[at + (kind != "i") :]
            if len(new) >= 4:
                words.add(new)
    counts = {w: 5 ** rng.randint(1, 8) + rng.randint(0, 1) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert found(got.collect()) == grouped(counts)


def test_chains_lead_to_their_root(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    counts = {w: 5**i for i, w in enumerate(chain)}
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect())
    assert got == grouped(counts) and {v[1] for v in got.values()} == {"bbbbbb"}


def test_pivots_are_the_lightest_grams_apart():
    rng = random.Random(4)
    for _ in range(200):
        places = [(i, rng.randint(1, 9)) for i in sorted(rng.sample(range(9), rng.randint(3, 8)))]
        pairs = [(a[1] + b[1]) for a in places for b in places if b[0] >= a[0] + spelling.GRAM]
        chosen = spelling.choose(places)
        weights = dict(places)
        assert (not pairs and not chosen) or (sum(weights[p] for p in chosen) == min(pairs) and chosen[1] - chosen[0] >= spelling.GRAM)


def test_words_of_odd_rows(frame, clashing, odd):
    rows = odd + [(8, "x" * 200000 + " Straße ÀÉÎÕÜ÷× naïveté NAÏVETÉ", None, None), (9, None, None, None)]
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    runs = spelling.runs(clashing(rows))
    words = runs.select(spelling.slipped(F.col("run"), F.col("doc_id")).alias("word"))
    got = {r["word"]: r["n"] for r in spelling.counted(words, least=1).collect()}
    assert got == counts and "NAÏVETÉ".translate(LOWER) in got
    assert spelling.variants(spelling.counted(spelling.runs(clashing(rows).limit(0)).withColumnRenamed("run", "word"))).count() == 0


def test_one_run_in_so_many_slips(spark):
    runs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("straße").alias("run"))
    got = Counter(r["w"] for r in runs.select(spelling.slipped(F.col("run"), F.col("doc_id")).alias("w")).collect())
    expected = Counter()
    for i in range(4000):
        h = zlib.crc32(f"{i}:straße".encode())
        expected["straße"[: h % 6] + "straße"[h % 6 + 1 :] if h % 199 == 0 else "straße"] += 1
    assert got == expected and len(got) > 3


# ---------------------------------------------------------------- token files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    data = b"xyz" + tokenfiles.EliasFano.of(np.array(values, np.int64)).written() + b"tail"
    code, end = tokenfiles.EliasFano.read(memoryview(data), 3)
    assert end == len(data) - 4 and len(code) == len(values)
    assert code.values().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert code.select(i) == values[i]
    for v in values[:3]:
        assert code.first_at_least(v) == values.index(v)
    assert code.first_at_least(1 << 41) == len(values)


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 50_000))
    assert len(tokenfiles.EliasFano.of(ends).written()) * 8 / len(ends) < 12  # 64 bits each in a table


@pytest.fixture(scope="module")
def byte_level():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_have_the_ids_of_the_whole_text(byte_level):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(byte_level)
    own = tokenfiles.Encoder(byte_level)
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", "a", "don't", "'s", "x1", "7", "é", "ß", "漢", "😀", "!?", "\x00", "é", "WORD"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>\n<|endoftext", " ".join(["long"] * 50000), "y" * 20000]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)[:80]


def test_plain_text_is_taken_to_pieces_at_once(byte_level):
    """Its chunks are neither split off nor kept, and all its characters have the tokenizer's ids."""
    own = tokenfiles.Encoder(byte_level)
    plain = [chr(c) for c in range(0x250) if not own.odd(chr(c))]
    texts = ["".join(plain), "", " ", "  a\n\n b \r\n c ", "Don't we'll 's", *[f"a {c}{c}1 {c}\n{c}" for c in plain]]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u2").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)[:80]
    assert not own and own.pieces


@pytest.mark.parametrize("file_ids", [tokenfiles.FILE_IDS, 40])
def test_files_round_trip(spark, clashing, odd, byte_level, file_ids):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(byte_level)
    rows = odd + [(i, f"text {i} " * (i % 7), None, None) for i in range(-5, 200, 3)]
    place = folder(spark)
    tokenfiles.write(clashing(rows), byte_level, place, file_ids)
    got = sorted(tokenfiles.read(spark, place).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(got) == len(rows)
    start, seen = 0, Counter()
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
        seen[r["doc_id"], bytes(r["ids"])] += 1
    expected = Counter((i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t, *_ in rows)
    assert seen == expected
    files = [tokenfiles.TokenFile(bytes(r["content"])) for r in spark.read.format("binaryFile").load(place).filter("length > 8").collect()]
    assert (len(files) > 10) == (file_ids == 40)
    file = next(f for f in files if f.find(10))
    assert whole.decode(file.ids(file.find(10)[0]).tolist()[:-1]) == "text 10 " * 3 and not file.find(12)


def test_query_of_files_against_the_tokenizer(spark, byte_level):
    from tokenizers import Tokenizer

    from auditlake.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no tables")
    whole, start, want = Tokenizer.from_file(byte_level), 0, []
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op12_token_files"](spark, small).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == want


def test_files_of_nothing(spark, frame, byte_level):
    place = folder(spark)
    tokenfiles.write(frame([(1, "x")]).limit(0), byte_level, place)
    assert tokenfiles.read(spark, place).count() == 0
    with pytest.raises(TypeError):
        tokenfiles.write(frame([(1, "x")]).withColumn("doc_id", F.lit("a")), byte_level, folder(spark))


# ---------------------------------------------------------------- phrases
def plain_collocations(rows, least, longest, top):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in known.items():
            score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    stock = [["red", "tape"], ["as", "a", "matter", "of", "fact"], ["matter", "of", "course"], ["New", "York"], ["ÉTÉ", "été"], ["x y", " "]]
    rows = []
    for i in range(120):
        words = [w for _ in range(30) for w in (rng.choice(stock) if rng.random() < 0.5 else ["the", "a", "of", "red", "und"][: rng.randint(1, 5)])]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", " \r\n"]) for w in words), rng.choice(["en", "fr", None, "und"]), None))
    return rows


@pytest.mark.parametrize("most", [phrases.MOST, 30, 0])
def test_collocations_against_plain_counts(frame, talk, most):
    """Also where a broadcast would be too large, from the first level or from a later one on."""
    got = phrases.collocations(frame(talk), least=20, top=25, most=most)
    assert told(got) == plain_collocations(talk, 20, 5, 25)


def test_more_phrases_than_a_broadcast_holds(frame, talk, monkeypatch):
    """Where words have ids, all levels are counted with tries, of a part of the phrases each."""

    def shuffled(*_):
        raise AssertionError("phrases of known words are not spelled out for a shuffle")

    counts = Counter()
    for _, text, lang, *_ in talk:
        counts.update(("und" if lang is None else lang, w) for w in re.findall("[^ \t.,;:!?\n-\r]+", text.translate(LOWER)))
    known = sum(f >= 20 for f in counts.values())
    made = []
    monkeypatch.setattr(phrases, "shuffled_phrases", shuffled)
    monkeypatch.setattr(phrases, "_tries", lambda *args, tries=phrases._tries: (made.append(len(x[2])) or x for x in tries(*args)))
    assert told(phrases.collocations(frame(talk), least=20, top=25, most=known)) == plain_collocations(talk, 20, 5, 25)
    assert len(made) > 3 and max(made) == known


def test_texts_split_at_once_and_lines_of_few_ids(frame, talk, odd, monkeypatch):
    """Pieces of a few texts and lines of a few ids give what whole ones give."""
    rows = talk + odd
    monkeypatch.setattr(phrases, "TEXTS", 50)
    monkeypatch.setattr(phrases, "IDS", 3)
    monkeypatch.setattr(phrases, "HELD", 20)
    words = phrases.words_of([b"To be,\tor\nnot  To", b"", "été".encode()]).to_pylist()
    assert words == [b"\xff", b"to", b"be", b"\xff", b"or", b"\xff", b"not", b"to", b"\xff", b"\xff", "été".encode(), b"\xff"]
    want = Counter((x, w) for _, text, lang, *_ in rows for x in ["und" if lang is None else lang] for w in re.findall("[^ \t.,;:!?\n-\r]+", (text or "").translate(LOWER)))
    got = phrases.counted_words(frame(rows))
    assert {(r["lang"], r["phrase"]): r["f"] for r in got.collect()} == want
    assert told(phrases.collocations(frame(rows), least=10)) == plain_collocations(rows, 10, 5, 2000)


def test_tasks_of_few_words_and_ids(frame, talk, monkeypatch):
    monkeypatch.setattr(phrases, "TRIED", 4)
    assert told(phrases.collocations(frame(talk, 40), least=10)) == plain_collocations(talk, 10, 5, 2000)


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 4 * 10**12, 9 * 10**13, 5 * 10**12 + 1, 7 * 10**12 + 3
    got = spark.createDataFrame([(n, a, left, right)], "n long, a long, l long, r long").select(phrases._score("n", "a", "l", "r")).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_trie_walks_all_places_alike():
    rng = np.random.default_rng(3)
    ids = rng.integers(-1, 12, 4000)
    trie, known = phrases.Trie(12), {(c,): c + 1 for c in range(12)}
    for length in range(2, 5):
        grams = {tuple(ids[i : i + length].tolist()) for i in rng.choice(3900, 300, replace=False)}
        grams = sorted(g for g in grams if min(g) >= 0 and g[:-1] in known)
        states = trie.add(np.array([known[g[:-1]] for g in grams]), np.array([g[-1] for g in grams]))
        assert len(set(states.tolist()) | set(known.values())) == len(grams) + len(known)
        known |= dict(zip(grams, states.tolist()))
        walked = trie.walk(ids, length).tolist()
        assert walked == [known.get(tuple(ids[i : i + length].tolist()), -1) for i in range(len(ids) - length + 1)]


def test_trie_of_many_children_of_few_states():
    """Common words go on with most others: their states are split, and all find a place in a few rounds."""
    rng = np.random.default_rng(5)
    often = 1 / np.arange(1, 5001)
    pairs = np.unique(rng.choice(5000, (2, 200000), p=often / often.sum()), axis=1)
    trie = phrases.Trie(5000)
    states = trie.add(pairs[0] + 1, pairs[1])
    assert np.bincount(pairs[0]).max() > 2000 and trie.split.max() > 255 and len(trie.base) < 6 * len(states)
    assert len(np.unique(states)) == len(states) and states.min() > 5000
    tried = rng.integers(-1, 5000, (2, 100000))
    known = dict(zip(zip(*pairs.tolist()), states.tolist()))
    assert trie.advance(np.where(tried[0] < 0, -1, tried[0] + 1), tried[1]).tolist() == [known.get(x, -1) for x in zip(*tried.tolist())]


def test_collocations_of_odd_rows(clashing, odd):
    rows = odd + [(i, "to be or\xff not to be", None, None) for i in range(10)]
    df = clashing(rows)
    assert told(phrases.collocations(df, least=5)) == plain_collocations(rows, 5, 5, 2000)
    assert phrases.collocations(df.limit(0)).count() == 0
