"""Grouping of spelling variants: pivotal grams against the gram prefixes of other words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from auditlake.lineage import cut, release

#: Letters of a word, least length and count of a word, and how many times its count a form needs.
LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO = "A-Za-zÀ-ÿ", 6, 5, 5
#: Letters of a gram; one edit spoils at most this many, so one gram more is a prefix, and two that share no letter are pivots.
GRAM, PREFIX, PIVOTS = 2, 3, 2
#: Parts that the words with one gram are dealt to.
SALTS = 64

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MARKS = StructType().add("prefix", ArrayType(IntegerType())).add("pivots", ArrayType(IntegerType())).add("weight", LongType())


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Every maximal run of at least ``least`` letters, only A-Z lower-cased: ``doc_id, run``.

    A null text has none.
    """
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    run = F.col("run")
    # lower() may be used where all letters are of one byte
    lowered = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _CAPITALS, _CAPITALS.lower()))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", lowered.alias("run"))


def slipped(run: Column, doc_id: Column, every: int = 199) -> Column:
    """``run``, or in one of ``every`` cases, drawn by document and run, without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, word: str = "word", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """Distinct words of some length and their counts, where these reach ``least``: ``word, n``."""
    return words.filter(F.length(word) >= least_length).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def choose(places: list[tuple[int, int]], many: int = PIVOTS) -> list[int]:
    """Positions of ``many`` grams of least total weight that share no letter, from ``(position, weight)`` by position.

    Dynamic programming: the best choice of k grams among the first i either
    leaves the last one out or adds it to the best k - 1 that end before it.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * many]
    for i, (at, weight) in enumerate(places):
        before = sum(p + GRAM <= at for p, _ in places[:i])
        row: list[tuple[int, list[int]] | None] = [(0, [])]
        for k in range(1, many + 1):
            without, rest = best[i][k], best[before][k - 1]
            added = rest and (rest[0] + weight, [*rest[1], at])
            row.append(min((c for c in (without, added) if c), default=None))
        best.append(row)
    return best[-1][many][1] if best[-1][many] else []


@F.pandas_udf(MARKS)
def _marks(words: pd.Series, weights: pd.Series) -> pd.DataFrame:
    """Positions of the prefix grams and the pivots of each word, and the weight of its prefix's last gram.

    Grams are ordered by weight, then by letters. All places of the prefix's
    last gram belong to it, so that a gram is in a prefix wherever it stands.
    """
    out = []
    for word, own in zip(words, weights):
        grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
        last = sorted(zip(own, grams))[min(PREFIX, len(grams)) - 1]
        prefix = [i for i, gram in enumerate(zip(own, grams)) if gram <= last]
        out.append((prefix, choose([(i, own[i]) for i in prefix]), last[0]))
    return pd.DataFrame(out, columns=["prefix", "pivots", "weight"])


def marked(vocabulary: DataFrame) -> DataFrame:
    """Words with what ``_marks`` finds: ``word, n, prefix, pivots, weight``.

    A gram weighs as many as there are places of it in all words, so rare ones come first.
    """
    length = F.length("word")
    places = vocabulary.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), length - GRAM + 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("at", "own"))
    # a gram may be in most words, so its weight is there once for each salt
    weights = places.groupBy("own").agg(F.count(F.lit(1)).alias("w")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = places.withColumn("salt", F.pmod(F.hash("word"), F.lit(SALTS)))
    known = salted.join(weights, ["own", "salt"]).groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("grams"))
    return known.withColumn("m", _marks("word", F.transform("grams", lambda g: g["w"]))).select("word", "n", "m.*")


def _keys(asked_length: Column, at: Column) -> Column:
    """What a word and one near it have in common if a gram at ``at`` (of the word asked for) is left as it was.

    The edit is on one side of the gram, in one half of that side: the gram, the
    other side and the other half are the same in both.
    """
    word, length = F.col("word"), F.length("word")

    def first(n: Column) -> Column:
        return F.substring(word, F.lit(1), n)

    def last(n: Column) -> Column:
        return F.substring(word, length - n + 1, n)

    after = asked_length - at - GRAM
    half, early = F.floor(after / 2).cast("int"), F.floor(at / 2).cast("int")
    right = [first(at + GRAM + half), F.concat_ws("|", first(at + GRAM), last(after - half))]
    left = [F.concat_ws("|", first(early), last(asked_length - at)), last(asked_length - early)]
    return F.struct(*[F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("part")) for kind, key in enumerate(keys, start)]).alias(side) for side, keys, start in (("right", right, 0), ("left", left, 2))])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """All pairs of words that differ by one letter: ``word, n, near, near_n``, each pair both ways.

    Of two near words the one whose prefix ends earlier in the order of grams
    has a pivot that the edit left alone, and that gram is in the other's
    prefix: pivots ask, prefixes answer. The position limits are exact: a gram
    before the edit keeps its place, one behind it moves with the length. Keys
    hold the half of the word that the edit can't have touched, so a common gram
    at the same place doesn't bring all its words together. What meets is
    verified on whole words within the join, and pairs are made distinct.
    """
    words = marked(vocabulary)
    length = F.length("word")
    asks = words.select("word", "n", "weight", F.explode("pivots").alias("at"))
    asks = asks.withColumn("keys", _keys(length, F.col("at")))
    asks = asks.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("weight").alias("a_last"), length.alias("size"), "at", F.inline(F.concat("keys.right", "keys.left")))

    # the asking word is shorter by one, as long, or longer by one
    offers = words.select("word", "n", "weight", F.explode("prefix").alias("own_at"))
    offers = offers.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("more")).withColumn("size", length + F.col("more"))
    sides = F.array(F.struct(F.col("own_at").alias("at"), F.lit("right").alias("side")), F.struct((F.col("own_at") + F.col("more")).alias("at"), F.lit("left").alias("side")))
    offers = offers.select("word", "n", "weight", "size", F.inline(sides)).filter((F.col("at") >= 0) & (F.col("at") + GRAM <= F.col("size")))
    offers = offers.withColumn("keys", _keys(F.col("size"), F.col("at")))
    offers = offers.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("weight").alias("b_last"), "size", "at", F.inline(F.when(F.col("side") == "right", F.col("keys.right")).otherwise(F.col("keys.left"))))

    # keys travel as hashes: what they bring together wrongly is no near pair
    key = F.xxhash64("size", "at", "kind", "part")
    asks, offers = asks.select("a", "a_n", "a_last", key.alias("asked")), offers.select("b", "b_n", "b_last", key.alias("offered"))
    met = asks.join(offers, (F.col("asked") == F.col("offered")) & (F.col("a") != F.col("b")) & (F.col("a_last") <= F.col("b_last")) & (F.levenshtein("a", "b", 1) == 1))
    once = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()
    both = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in (("a", "b"), ("b", "a"))])
    return once.select(F.inline(both))


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root``: where forms lead in the end, from ``word, form``.

    Each round doubles the steps taken. A form occurs several times as often as
    its word, so there are no circles and few steps; words without a form are
    roots and stay out.
    """
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = cut(reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        release(reached)
        reached = joined
        if joined.filter("moved").isEmpty():
            return reached


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Every word with the commoner word it is a variant of: ``word, form, root, n, n_near, form_n``.

    ``vocabulary`` holds distinct words, of at least ``PREFIX`` + 1 letters, and
    their counts. Of the words near a word (see ``near_pairs``) the one of
    largest count, the smallest of several, is its form if it has ``ratio``
    (above 1) times the word's count; else ``form`` and ``form_n`` are null.
    ``root`` is the end of the chain of forms, the word itself if it has none.
    An empty vocabulary gives an empty result.
    """
    words = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    enough = form_n >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, form_n).alias("form_n")))
    release(words)
    roots = _followed(found.filter("form IS NOT NULL"))
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by deletion neighbourhoods: words are near if they are equal without one letter each, at the same place, or one without one letter is the other.
SQL = r"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) r(i)
), found AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), runs AS (
    SELECT run, count(*) AS n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)] ELSE [192 + ord(s) // 64, 128 + ord(s) % 64] END)) AS bytes
    FROM found GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, xor(list_reduce(bytes::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM runs, bits
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6
), less AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), one AS (
    SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
    UNION SELECT l.word, l.rest FROM less l JOIN words w ON w.word = l.rest
    UNION SELECT l.rest, l.word FROM less l JOIN words w ON w.word = l.rest
), ranked AS (
    SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place FROM one JOIN words w ON w.word = b
), forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.b END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.place = 1
), steps AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.root AND e.form IS NULL
"""
