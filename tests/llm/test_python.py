"""Language, packing, fingerprints, passages and near-duplicates on small fixtures."""

import hashlib
import random
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import fingerprints, language, near, packing, passages
from auditlake.llm.common import kept
from auditlake.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- language
def tongue(seed, letters):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return lambda r, n: " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tongues():
    return {"aa": tongue(1, "abcdefgh"), "bb": tongue(2, "abcdefgh"), "cc": tongue(3, "efghijklé")}


def phrases(text, learned, block=language.BLOCK):
    """Greedy longest matches against the learned text, block by block."""
    out = 0
    for first in range(0, len(text), block):
        at, end = first, min(len(text), first + block)
        while at < end:
            size = 1
            while at + size < end and text[at : at + size + 1] in learned:
                size += 1
            at, out = at + size, out + 1
    return out


def test_automata_count_phrases_like_plain_search(tongues):
    rng = random.Random(5)
    texts = {k: [t(rng, 25) for _ in range(4)] for k, t in tongues.items()}
    parser = language.Parser(texts)
    inverse = "".join(map(chr, range(32, 32 + parser.width)))
    plain = lambda s: "".join(inverse[x] for x in parser.symbols(s)[0])
    learned = {k: "".join(plain(t)[: language.SAMPLE_SYMBOLS] for t in texts[k]) for k in texts}
    tests = [tongues[k](rng, n) for k in tongues for n in (1, 3, 50, 400)] + ["", "zz 12", "A é ZZ qq", "x" * 3000]
    found, sizes = parser.symbols(*tests)
    got = parser.phrases(found, sizes)
    for i, t in enumerate(tests):
        assert [int(got[j][i]) for j in range(3)] == [phrases(plain(t), learned[k]) for k in parser.languages], t[:40]


def test_held_out_texts_are_recognised(frame, tongues):
    rng = random.Random(9)
    rows = [(i, tongues[k](rng, 3 + i % 60), k if i % 2 else None) for i, k in enumerate(sorted(tongues) * 60)]
    got = language.identify(frame(rows)).select("doc_id", "lang_pred", "score").collect()
    truth = [k for k in sorted(tongues) * 60]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in got)
    assert len(got) == 180 and right >= 175 and all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(frame, clashing, odd):
    df = clashing(odd)
    got = language.identify(df)
    assert got.select("row.*").columns == df.columns
    preds = [(r["row"]["text"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert len(preds) == len(odd)
    assert {p for t, p, _ in preds if not t or not any(c.isalpha() for c in t)} == {"und"}
    assert all((s == 0) == (p == "und") for _, p, s in preds)
    assert language.identify(df.limit(0)).count() == 0
    unlabelled = language.identify(frame([(1, "some text"), (2, None)])).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_workers_keep_the_state_of_one_stage():
    """A worker that packed and then parses holds no word cache beside the automata."""
    words = kept(packing.WordIds, vocabulary(), False)
    assert kept(packing.WordIds, vocabulary(), False) is words
    gone = weakref.ref(words)
    del words
    kept(str, "automata")
    assert gone() is None


class Upper(packing.Found):
    def __init__(self, most):
        super().__init__(most)
        self.made = []

    def make(self, key):
        self.made.append(key)
        return key.upper()


def test_what_comes_often_is_found_once():
    """Rare words don't drive out a common one, and no more are kept than there is room for."""
    found = Upper(20)
    for i in range(100):
        assert found["often"] == "OFTEN" and found[f"rare{i}"] == f"RARE{i}"
        assert len(found) + len(found.older) <= 20
    assert found.made.count("often") == 1
    long = "x" * (packing.CACHED_CHARS + 1)
    assert found[long] == found[long] == long.upper() and found.made.count(long) == 2


def test_plain_text_has_the_ids_of_the_whole_tokenizer():
    """Every character of plain text, in pieces without a look at its words; other texts word by word."""
    words = packing.WordIds(vocabulary())
    plain = [chr(c) for c in range(0x250) if not words.special(chr(c))]
    texts = ["".join(plain)] + [t for c in plain for t in (f"a{c}b", f"1{c}2", f".{c}!", f" {c} {c.upper()}")] + ["Don't we'LL 'S x'", "word, Word. WORD"]

    def whole(text):
        return packing.packed(words.tokenizer.encode(text, add_special_tokens=False).ids)

    assert all(words.encode(t) == whole(t) for t in texts if not words.special(t)) and not words
    others = ["caf\u00e9 \u201cx\u201d word", "J\u030c \u0130 \u023a", "a <|endoftext|> B", "nul \x00 \xa0 \x85 \x1c", "\u4e2d\u6587 word"]
    assert all(words.encode(t) == whole(t) for t in others) and b"word" in words


def test_automata_are_built_once_by_the_driver(frame, tongues, monkeypatch):
    """Workers get finished tables: building takes several times their memory."""
    learned = {lang: [speak(random.Random(i), 60) for i in range(3)] for lang, speak in tongues.items()}
    texts = [tongues["aa"](random.Random(9), 30), tongues["cc"](random.Random(9), 30), ""]
    by_hand = language.Parser(learned).judge(texts)
    built, init = [], language.Parser.__init__
    monkeypatch.setattr(language.Parser, "__init__", lambda self, texts: (built.append(1), init(self, texts))[1])
    got = language.identify(frame(list(enumerate(texts))), learned).orderBy("doc_id").collect()
    assert len(built) == 1
    assert [(r["lang_pred"], r["score"], r["bits"], r["symbols"], r["strange"]) for r in got] == list(zip(*[list(x) for x in by_hand]))


def test_sample_is_bounded(frame, tongues):
    rng = random.Random(3)
    rows = [(i, tongues["aa"](rng, 40), "aa") for i in range(300)] + [(1000 + i, tongues["bb"](rng, 40), "bb") for i in range(5)]
    learned = language.sample(frame(rows))
    assert {k: len(v) for k, v in learned.items()} == {"aa": language.SAMPLE_DOCS, "bb": 5}
    assert learned == language.sample(frame(rows, 1))


def test_languages_of_many_letters(frame):
    """Two of 400 letters in common, in different words, beside one of few letters that are all the most frequent."""
    rng, ideographs = random.Random(6), [chr(0x4E00 + i) for i in range(400)]
    speak = {"ja": tongue(21, ideographs), "zh": tongue(22, ideographs), "la": tongue(23, "abcdefgh")}
    learned = {k: [t(rng, 60) for _ in range(8)] for k, t in speak.items()}
    parser = language.Parser(learned)
    letters = {c for t in learned.values() for c in "".join(t) if c != " "}
    assert len(letters) > 120 and parser.width == len(letters) + 2
    assert all(parser.symbols(c)[0].tolist() != [language.OTHER] for c in letters)
    texts = [(k, t(rng, 12)) for k, t in speak.items() for _ in range(20)]
    assert parser.judge([t for _, t in texts])[0] == [k for k, _ in texts]


# ---------------------------------------------------------------- packing
def best_fit(counts, capacity):
    rooms, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                n += 1
                rooms.append(capacity - length)
            else:
                rooms.remove(fit)
                rooms.append(fit - length)
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    runs = packing.plan(counts, capacity)
    slots, ranks = defaultdict(list), Counter()
    for length, first, last, sequence, each, offset in runs:
        assert ranks[length] == first
        ranks[length] = last + 1
        for k in range(last - first + 1):
            slots[sequence + k // each].append((offset + k % each * length, length))
    assert ranks == Counter(counts) and len(slots) == best_fit(counts, capacity)
    for parts in slots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("spelled", [False, True])
def test_pack_round_trip(frame, prose, odd, spelled):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    if spelled:
        tokenizer.encode_special_tokens = True
    assert len(tokenizer.encode("a <|endoftext|>", add_special_tokens=False).ids) == (7 if spelled else 2)
    strange = "a\x1cb c d\u0085e <|endoftext|> I'll don't 12³ é ̈x İSTANBUL ΟΔΟΣ ΟΔΟΣ. 你好 🙂🙂 ﻿x​y"
    rows = odd + [(100 + i, prose(i, 1 + 7 * i)) for i in range(60)] + [(300, strange)]
    rows += [(301, "x<|endoftext|>y<|endoftext|> <|startoftext|>\n<|END<|endoftext|", None, None), (302, "<|endoftext|> " * 3000, None, None)]
    got = packing.pack(frame(rows), vocabulary(), spelled=spelled).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            want[(i, k, start, np.array(ids[start : start + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= total / 2048 * 1.1 + 1


def test_pack_of_nothing_and_clashing_names(frame, clashing, odd):
    assert packing.pack(frame(odd).limit(0), vocabulary()).count() == 0
    assert packing.pack(clashing(odd), vocabulary()).count() == packing.pack(frame(odd), vocabulary()).count()


def test_crowded_length_has_dense_ranks(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"))
    placed = packing.place(pieces).collect()
    used = Counter()
    for r in placed:
        used[r["sequence_id"]] += r["length"]
    assert len(placed) == 5000 and max(used.values()) <= 2048
    assert len(used) == best_fit(Counter(r["length"] for r in placed), 2048)


# ---------------------------------------------------------------- fingerprints
def closed(text):
    """Anchors by the definition, with the module's own hash of inner runs."""
    k, s = fingerprints.K, fingerprints.S
    hashes = {}
    for i in range(len(text) - s + 1):
        piece = text[i : i + s]
        if piece not in hashes:
            h = 0
            for c in piece:
                h = (h * int(fingerprints.MULTIPLY) + ord(c)) % (1 << 64)
            hashes[piece] = int(fingerprints._mixed(np.array([h], np.uint64))[0])
    out = []
    for i in range(len(text) - k + 1):
        inner = [hashes[text[i + j : i + j + s]] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers(prose):
    for text in (prose(1, 200), "a" * 100, "abcabcabc" * 20, "𝒳é" * 40):
        hashes, at = fingerprints.anchors(text)
        assert at.tolist() == closed(text) and len(hashes) == len(at)
        back = fingerprints.read(fingerprints.written(hashes, at))
        assert back[0].tolist() == hashes.tolist() and back[1].tolist() == at.tolist()
        assert np.diff(at).max(initial=0) <= fingerprints.K - fingerprints.S
    shared = prose(2, 60)
    one, two = (set(fingerprints.anchors(x + shared + y)[0].tolist()) for x, y in ((prose(3, 9), prose(4, 5)), (prose(5, 30), "")))
    assert set(fingerprints.anchors(shared)[0].tolist()) <= one & two


def test_likeness(prose):
    a, b = prose(1, 300), prose(2, 300)
    f = fingerprints.anchors
    assert fingerprints.likeness(f(a), f(a)) == 1.0 and fingerprints.likeness(f(a), f(b)) < 0.05
    assert 0.85 < fingerprints.likeness(f(a), f("extra words in front " + a)) <= 1.0
    assert 0.4 < fingerprints.likeness(f(a), f(a[len(a) // 2 :] + a[: len(a) // 2])) < 0.65  # order counts
    assert fingerprints.likeness(f(""), f("")) == 1.0 and fingerprints.likeness(f(""), f("x")) == 0.0 and fingerprints.likeness(f("x"), f("x")) == 1.0


def test_short_texts_have_anchors():
    rng, f, bare = random.Random(8), fingerprints.anchors, 0
    for n in [*range(1, 60)] * 5:
        one, two = ("".join(rng.choice("abcdefghilmnoprstuvz ") for _ in range(n)) for _ in range(2))
        bare += n >= fingerprints.K and not closed(one)
        marks, edited = f(one), f(one[: n - n // 2] + two[: n // 2])
        assert len(marks[0]) and fingerprints.likeness(marks, f(one)) == 1.0
        back = fingerprints.read(fingerprints.written(*marks))
        assert back[0].tolist() == marks[0].tolist() and back[1].tolist() == marks[1].tolist()
        if n >= 8:  # of fewer, two may be equal
            assert fingerprints.likeness(marks, f(two)) == 0.0 and fingerprints.likeness(marks, f("")) == 0.0
            assert fingerprints.likeness(marks, edited) < 1.0
        if n >= fingerprints.K and closed(one):
            assert marks[1].tolist() == closed(one)
    assert bare > 20


def test_edits_against_brute_force(frame, clashing, prose, odd):
    rows = [(i * 7 - 300, prose(i % 90, 1 + i % 40)) for i in range(120)] + [(10**15 + 1, ""), (10**15 + 2, None), (10**15 + 3, "𝒳é" * 30)]
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(frame(rows, 5)).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for (i, t, *_), (_, n, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        marks = [fingerprints.anchors(x) for x in (t, edited, n)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.written(*marks[0]) and r["edited_fingerprint"] == fingerprints.written(*marks[1])
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(marks[0], marks[1])) and r["near_next"] == pytest.approx(fingerprints.likeness(marks[0], marks[2]))
    df = clashing(odd)
    assert fingerprints.compare_edits(df).count() == len(odd) and fingerprints.compare_edits(df.limit(0)).count() == 0
    assert fingerprints.fingerprint(df).select("row.*").columns == df.columns
    alone = fingerprints.compare_edits(frame([(4, "only one document")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


# ---------------------------------------------------------------- passages
def removed(texts, width=passages.PASSAGE.length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passage_case(prose):
    shared, other = prose(1, 150), prose(2, 70)
    edge = prose(3, 200)
    texts = [
        shared, prose(10, 50) + shared + prose(11, 40), shared[:450] + prose(12, 80), prose(13, 30) + shared[100:520] + prose(14, 9),
        other + " " + other, edge[:399], edge[:400] + "x", "y" + edge[:400], edge[1:401], "z" * 900, "z" * 500 + prose(15, 9), "ab" * 450, None, "", "é" * 260, "aé" * 260 + "x",
        *[prose(20, 40) + prose(30 + i, 60) + edge[300:900] + prose(50 + i, 30) for i in range(12)],
    ]
    return texts + texts[:2]


@pytest.mark.parametrize("crowd", [passages.CROWD, 2])
def test_passages_against_brute_force(frame, prose, crowd):
    texts = passage_case(prose)
    got = passages.remove_repeated(frame(list(enumerate(texts)), 4), crowd).collect()
    found = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got}
    want = removed(texts)
    assert [found[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 5000


def test_segments_do_not_matter(frame, prose, monkeypatch):
    text = (prose(5, 400) + prose(6, 100) + prose(5, 150)).encode()
    whole = passages.anchors(text)
    monkeypatch.setattr(passages, "SEGMENT", 700)
    assert all((a == b).all() for a, b in zip(whole, passages.anchors(text)))


def test_short_passages_of_many_words_are_told(frame, prose):
    words = prose(31, 400).split()
    passage = " ".join(words[:55])
    assert 256 < len(passage) < 400
    short, foot = " ".join(words[100:148]), " ".join(words[200:280])
    assert 256 < len(short) and len(foot) > 400
    rows = [(1, f"{prose(1, 80)} {passage} {prose(2, 30)}"), (2, f"{passage}. {prose(3, 90)}"), (3, f"{prose(4, 60)} {short}"), (4, f"{short} {prose(5, 60)}")]
    rows += [(5, f"{prose(6, 20)}\n{foot}"), (6, f"{foot} {prose(7, 20)} {passage[:200]}"), (7, None), (8, prose(8, 300))]
    got = {r["doc_id"]: (sum(s["end"] - s["start"] for s in r["spans"]), r["n_passages"]) for r in passages.remove_repeated(frame(rows), short=passages.SHORT).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0, 8: 0}
    assert {k for k, v in got.items() if v[0]} == {5, 6}


def test_passages_of_odd_rows(frame, clashing, odd, prose):
    df = clashing(odd + [(None, prose(9, 120)), (90, prose(9, 120)), (90, prose(9, 120))])
    out = passages.remove_repeated(df)
    assert out.select("row.*").columns == df.columns
    rows = out.collect()
    assert len(rows) == len(odd) + 3
    assert [len(r["kept"]) for r in rows if r["row"]["text"] == prose(9, 120)] == [0, 0, 0]
    assert passages.remove_repeated(df.limit(0)).count() == 0


# ---------------------------------------------------------------- near-duplicates
def shingle_set(text):
    words = [w for w in (text or "").translate(LOWER).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted((i, len(a), find(i), find(i) == i) for i, a in sets)


def near_case(prose):
    rng = random.Random(4)
    rows = [(i, prose(i, 60)) for i in range(0, 40)]
    n = 100
    for base in range(6):  # families: edits of one text, and edits of edits, in chains
        words = prose(200 + base, 150 + 20 * base).split()
        for copy in range(14):
            own = list(words)
            for _ in range(copy % 5):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            if copy > 9:
                words = own
            rows.append((n, " ".join(own) if copy % 3 else " ".join(own).upper()))
            n += 1
    shared = prose(999, 40)
    rows += [(n + i, shared + " " + prose(500 + i, 12 + i)) for i in range(30)]
    return rows + [(n + 50, "two words"), (n + 51, "Two\twords"), (n + 52, "two words more"), (n + 53, None), (n + 54, ""), (n + 55, " \n")]


def test_near_duplicates_against_all_pairs(frame, prose):
    rows = near_case(prose)
    got = near.near_duplicates(frame(rows, 5)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == groups(rows)


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)] + [(2000, 1499)]
    links = spark.createDataFrame(chain + star + [(5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in near.components(links).collect()}
    assert set(got.values()) == {0, 1000} and got[300] == 0 and got[2000] == 1000 and len(got) == 301 + 501
    assert near.components(links.limit(0)).count() == 0


def test_a_bucket_is_compared_across_its_components(frame, prose, spark, monkeypatch):
    """Members that are not like the hub of their bucket still find one another."""
    words = prose(77, 200).split()
    left = [words[:150] + prose(800 + i, 4).split() for i in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(left)]
    rows += [(50, prose(78, 200))]
    docs = frame(rows)
    nodes = near.signatures(docs).select(F.col("doc_id").alias("node"), "n_shingles", "signature", F.posexplode("bands").alias("band", "key"))
    crowded, signs = nodes.select("node", "band", "key"), nodes.select("node", "n_shingles", "signature").distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    alone = signs.select("node", F.col("node").alias("component"))
    for block in (near.BLOCK, 1):
        monkeypatch.setattr(near, "BLOCK", block)
        links = [(r["u"], r["v"]) for r in near._across(crowded, signs, texts, alone).collect()]
        joined = near.components(spark.createDataFrame(links, "u long, v long")).collect()
        assert {r["node"]: r["component"] for r in joined} == {i: 0 for i in range(6)}
    together = signs.select("node", F.lit(0).cast("long").alias("component"))
    assert near._across(crowded, signs, texts, together).count() == 0


def test_near_duplicates_of_odd_rows(frame, clashing, odd):
    got = near.near_duplicates(clashing(odd)).collect()
    assert len(got) == len(odd)
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by[(5, 2)] == (5, True) and by[(2, 0)] == (2, True) and by[(None, 0)] == (None, True)
    assert near.near_duplicates(clashing(odd).limit(0)).count() == 0
    same = near.near_duplicates(frame([(None, "one two three four five six"), (9, "one two three four five six")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in same} == {(None, 9, False), (9, 9, True)}
