"""Document fingerprints from closed syncmers, and their likeness."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows

#: Characters of an anchor and of the inner substrings that choose it.
K, S = 32, 8
# fixed values: odd multipliers of the hashes
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the anchors of a text.

    An anchor is a run of ``K`` characters in which the least of its inner runs
    of ``S`` characters, by hash, stands at its start or its end. That depends
    on the run alone, so equal passages have equal anchors wherever they stand,
    and no ``K - S`` neighbouring runs are without one. A text shorter than
    ``K`` is one anchor. A text of up to ``2K - S - 2`` characters may hold no
    such run; its anchor is the run around the least of all inner runs. Only an
    empty text has none.
    """
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(point) < K:
        whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest())
        return np.array([whole][: len(point)], np.uint32), np.zeros(min(1, len(point)), np.int64)
    h, power, size = point, int(MULTIPLY), 1
    while size < S:  # hashes of runs twice as long
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    inner = _mixed(h)
    window, least, size = K - S + 1, inner, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[window - 1 :] == least))
    if not len(at):  # the least inner run is inside of all runs
        at = np.clip(inner.argmin(keepdims=True) - (K - S) // 2, 0, len(point) - K)
    whole = inner[at]
    for i in range(S, K, S):
        whole = whole * MULTIPLY + inner[at + i]
    return (_mixed(whole) >> np.uint64(32)).astype(np.uint32), at


ENTRY = np.dtype([("hash", "<u4"), ("step", "u1")])


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    """Anchors as text: base64 of each hash and the step from the anchor before, which is at most ``K - S``."""
    entries = np.empty(len(at), ENTRY)
    entries["hash"], entries["step"] = hashes, np.diff(at, prepend=0)
    return base64.b64encode(entries.tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    entries = np.frombuffer(base64.b64decode(fingerprint), ENTRY)
    return entries["hash"], np.cumsum(entries["step"], dtype=np.int64)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of hash and occurrence, and the index each comes from."""
    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    occurrence = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
    return (own.astype(np.uint64) << np.uint64(32)) | occurrence.astype(np.uint64), order


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors that two fingerprints have in common in the same order, from 0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (x, of_x), (y, of_y) = _numbered(a[0]), _numbered(b[0])
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[place] == x
    left, right = of_x[same], of_y[place[same]]
    there = right[np.argsort(left)]
    chain = len(there)
    if chain > 1 and not (np.diff(there) > 0).all():
        ends: list[int] = []  # the longest run of anchors that rises in both
        for v in there.tolist():
            i = bisect.bisect_left(ends, v)
            ends[i : i + 1] = [v]
        chain = len(ends)
    return 2.0 * chain / (len(a[0]) + len(b[0]))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Every row with the fingerprint of its whole text: ``row, doc_id, fingerprint``.

    A null text is empty. Rows are taken one by one: repeated rows, ties and
    nulls elsewhere have no effect.
    """
    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: written(*anchors(t or "")))

    d = rows(docs, doc_id="doc_id", text=F.col("text").cast("string"))
    return d.select("row", "doc_id", made(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Texts dealt to ranges of ``doc_id``, so that each row's successor follows it.

    Rows carry ``bucket, turn, doc_id, text``. A range holds its rows (``turn``
    0), then one copy of the first row of the next range (``turn`` 1), so a task
    has every successor while whole texts are shuffled once. Ranges are cut at
    quantiles, one per shuffle partition; their first rows are found by a pass
    that keeps ids and hashes only. Equal ids follow in the order of their
    texts' hashes, null ids after all others, and the first row follows the last.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("text_key", F.xxhash64("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = d.agg(F.percentile_approx("doc_id", shares, 10 * parts).alias("cuts")).first()["cuts"] if shares else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    # nulls travel as flags: as floats, large ids would lose digits
    known, null = F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("doc_id").isNull()

    def bucket(ids: pd.Series, nulls: pd.Series) -> np.ndarray:
        return np.where(nulls, len(cuts) + 1, np.searchsorted(cuts, ids.to_numpy(), side="right"))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, nulls: pd.Series) -> pd.Series:
        return pd.Series(bucket(ids, nulls))

    firsts = d.withColumn("bucket", bucket_of(known, null)).groupBy("bucket").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    # one row per range
    firsts = sorted((r["bucket"], r["first"]["doc_id"], r["first"]["text_key"]) for r in firsts.collect())
    before = {(doc_id, key): firsts[i - 1][0] for i, (_, doc_id, key) in enumerate(firsts)}

    @F.pandas_udf("array<struct<bucket:int,turn:int>>")
    def places(ids: pd.Series, nulls: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for i, no_id, key, b in zip(ids, nulls, keys, bucket(ids, nulls)):
            also = before.get((None if no_id else int(i), int(key)))
            out.append([{"bucket": int(b), "turn": 0}] + ([] if also is None else [{"bucket": also, "turn": 1}]))
        return pd.Series(out)

    dealt = d.select("doc_id", "text", "text_key", F.inline(places(known, null, F.col("text_key"))))
    # a range is a partition
    return dealt.repartitionById(len(cuts) + 2, "bucket").sortWithinPartitions("bucket", "turn", F.col("doc_id").asc_nulls_last(), "text_key").select("bucket", "turn", "doc_id", "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    The edited text has its last half replaced by as many first characters of
    the next document (see ``neighbours``). Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Null texts are empty, two empty ones are alike (1), and the only document of
    a table is its own successor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the row before, whose successor is still to come

        def ended(row, text, marks):
            _, doc_id, own, own_marks = row
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            edited_marks = anchors(edited)
            return (
                doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), written(*own_marks), written(*edited_marks),
                likeness(own_marks, edited_marks), likeness(own_marks, marks),
            )

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            out = []
            for bucket, turn, doc_id, text in zip(batch["bucket"], batch["turn"], batch["doc_id"], batch["text"]):
                if last is None and turn:
                    continue  # further copies of the same first row
                marks = anchors(text)
                if last is not None:
                    out.append(ended(last, text, marks))
                last = None if turn else (bucket, doc_id, text, marks)
            yield pd.DataFrame(out, columns=names)

    near = neighbours(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        compared, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return near.withColumn("doc_id", F.col("doc_id").cast(kind))
