"""Removal of byte passages that occur more than once, by column-wise suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from auditlake.lineage import cut, release

from .common import join_counted, rows



class Sizes(NamedTuple):
    """Bytes of a passage, and of the anchor that each passage holds."""

    length: int
    anchor: int

    @property
    def side(self) -> int:
        """Bytes on either side of an anchor within passages that hold it."""
        return self.length - self.anchor


#: Passages that are removed, and shorter ones of which a run is told if it has over ``WORDS`` words.
PASSAGE, SHORT, WORDS = Sizes(400, 256), Sizes(256, 160), 50
#: Contexts that are sorted together, and how many of one anchor are; beyond, passages are counted by digest.
TOGETHER, CROWD = 1 << 14, 1 << 15
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20

SPAN = StructType().add("start", IntegerType()).add("end", IntegerType())
LESS = StructType().add("kept", BinaryType()).add("spans", ArrayType(SPAN)).add("passages", IntegerType())

_draw = np.random.Generator(np.random.PCG64(7))
VALUES = _draw.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
# fixed values: odd bases and multipliers
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any stretches of some bytes, equal for equal stretches wherever they are."""

    def __init__(self, data: np.ndarray, family: int):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[family][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(31))) * MIX
        return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out = of(out[:-size], out[size:])
        size *= 2
    return of(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def anchors(text: bytes, sizes: Sizes = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, context digests and positions: in every passage, the runs of an anchor's bytes with the least hash.

    The choice depends on the passage's bytes alone, so equal passages have
    equal anchors at equal places. A context is an anchor with ``sizes.side``
    bytes on either side, as far as the text goes.
    """
    length, anchor, side, parts = sizes.length, sizes.anchor, sizes.side, []
    for first in range(0, max(1, len(text) - anchor + 1), SEGMENT):
        low, high = max(0, first - 2 * length), min(len(text), first + SEGMENT + 2 * length)
        data = np.frombuffer(text, np.uint8, high - low, low)
        if len(data) < length:
            continue
        one, two = Hashes(data, 0), Hashes(data, 1)
        start = np.arange(len(data) - anchor + 1)
        h = one.of(start, start + anchor)
        least = _sliding(h, side + 1, np.minimum)
        chosen = np.flatnonzero(h == _sliding(np.pad(least, side), side + 1, np.maximum))
        chosen = chosen[(chosen + low >= first) & (chosen + low < first + SEGMENT)]
        left, right = np.maximum(0, chosen - side), np.minimum(len(data), chosen + anchor + side)
        context = two.of(left, right) + (chosen - left).astype(np.uint64) * BASE
        parts.append((h[chosen], context, chosen + low))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def repeated_starts(contexts: list[bytes], left: np.ndarray, sizes: Sizes = PASSAGE) -> np.ndarray:
    """For each context, which of its ``sizes.side + 1`` passages start like one of another context.

    Contexts stand side by side with their anchors in the same columns. From the
    last column to the first, each round inserts one symbol per context: the
    order of suffixes is sorted stably by it, which moves the transform one
    column on, and the common prefix of neighbours is one more than the least
    between them before. A passage is repeated where a neighbour shares
    ``sizes.length`` symbols. What is outside a text equals nothing.
    """
    n, side, width = len(contexts), sizes.side, sizes.anchor + 2 * sizes.side
    grid = np.full((n, width), 256, np.int16)
    for i, (context, lead) in enumerate(zip(contexts, left)):
        grid[i, side - lead : side - lead + len(context)] = np.frombuffer(context, np.uint8)
    columns = np.ascontiguousarray(grid.T)
    order, common = np.arange(n), np.zeros(n, np.int32)
    flags = np.zeros((side + 1, n), bool)
    for column in range(width - 1, -1, -1):
        symbol = columns[column][order]
        moved = np.argsort(symbol, kind="stable")
        symbol = symbol[moved]
        bounds = np.flatnonzero(np.diff(symbol)) + 1
        after = np.zeros(n, np.int32)
        for first, last in zip(np.concatenate([[0], bounds]), np.append(bounds, n)):
            if last - first > 1 and symbol[first] < 256:
                place = moved[first:last]
                # least common prefix from one suffix of this symbol to the next
                after[first + 1 : last] = np.minimum.reduceat(common[: place[-1] + 1], place[:-1] + 1) + 1
        order, common = order[moved], after
        if column <= side:
            like = common >= sizes.length
            like[:-1] |= like[1:]
            flags[column, order] = like
    return flags.T


def _stretches(flags: np.ndarray, at: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, start and end of the bytes covered by each run of flagged passages."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    of, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return of, at[of] - sizes.side + first, at[of] - sizes.side + last + sizes.length


def _occurrences(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """Every anchor of every text: ``doc_id, text_key, a, c, at``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                marks = [anchors(t.as_py(), sizes) for t in part.column(2)]
                offsets = pa.array(np.cumsum([0] + [len(m[0]) for m in marks]), pa.int32())
                columns = [np.concatenate([m[k] for m in marks]) for k in range(3)]
                entries = pa.StructArray.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), pa.array(columns[2].astype(np.int32))], ["a", "c", "at"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, entries)], names=["doc_id", "text_key", "marks"])

    long = docs.filter(F.octet_length("text") >= sizes.length).select("doc_id", "text_key", F.col("text").cast("binary").alias("text"))
    return long.mapInArrow(found, f"doc_id {kind}, text_key long, marks array<struct<a:long,c:long,at:int>>").select("doc_id", "text_key", F.inline("marks"))


def _sorted_contexts(contexts: DataFrame, kind: str, sizes: Sizes) -> DataFrame:
    """Stretches ``doc_id, text_key, lo, hi`` that other contexts of the same anchor repeat."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def result(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.reset_index(drop=True)
            flags = repeated_starts(list(frame["context"]), frame["lead"].to_numpy(), sizes)
            of, lo, hi = _stretches(flags, frame["at"].to_numpy(), sizes)
            return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[of], "text_key": frame["text_key"].to_numpy()[of], "lo": lo, "hi": hi})

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                # contexts come by anchor: the last anchor may go on in the next batch
                frame = pd.concat(held)
                done = frame["a"] != frame["a"].iloc[-1]
                if done.any():
                    yield result(frame[done])
                held = [frame[~done]]
        if held and sum(map(len, held)):
            yield result(pd.concat(held))

    return contexts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(compared, "doc_id string, text_key long, lo int, hi int").withColumn("doc_id", F.col("doc_id").cast(kind))


def _counted_contexts(contexts: DataFrame, kind: str, sizes: Sizes) -> DataFrame:
    """The same for anchors with very many contexts: passages counted by 128-bit digest, with partial sums."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                data = np.frombuffer(r.context, np.uint8)
                start = np.arange(len(data) - sizes.length + 1)
                one, two = Hashes(data, 0).of(start, start + sizes.length), Hashes(data, 1).of(start, start + sizes.length)
                lo = start + r.at - r.lead
                yield pd.DataFrame({"doc_id": r.doc_id, "text_key": r.text_key, "a": r.a, "off": start - r.lead, "one": one.view(np.int64), "two": two.view(np.int64), "lo": lo})

    each = contexts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(digests, "doc_id string, text_key long, a long, off int, one long, two long, lo int")
    keys = ["a", "off", "one", "two"]
    twice = each.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return each.join(twice, keys).select(F.col("doc_id").cast(kind).alias("doc_id"), "text_key", "lo", (F.col("lo") + sizes.length).alias("hi"))


def repeated(docs: DataFrame, crowd: int = CROWD, sizes: Sizes = PASSAGE) -> DataFrame:
    """Stretches of bytes that repeated passages cover: ``doc_id, text_key, lo, hi``.

    Only anchors that occur twice go on; the places of a very common one never
    meet in a task (``join_counted``). Contexts with equal digests are
    repeated as a whole; where an anchor has differing contexts, one of each
    kind is fetched and sorted column by column with the others. Anchors with
    more than ``crowd`` differing contexts are counted by passage instead, so
    that no task has to hold them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = cut(_occurrences(docs, sizes))
    twice = cut(every.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = cut(join_counted(every, twice, ["a"]).drop("n"))
    release(every, twice)
    kinds = cut(found.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "at")).alias("first")))

    # a repeated context is covered from end to end, as every byte of it is in a passage with the anchor
    repeats = cut(kinds.filter("n > 1").select("a", "c", "n"))
    whole = join_counted(found, repeats, ["a", "c"])
    whole = whole.select("doc_id", "text_key", F.greatest(F.lit(0), F.col("at") - sizes.side).alias("lo"), (F.col("at") + sizes.anchor + sizes.side).alias("hi"))

    mixed = cut(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    wanted = join_counted(kinds.drop("n"), mixed, ["a"]).select("first.doc_id", "first.text_key", F.struct("a", F.col("n").alias("kinds"), "first.at").alias("mark"))
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.collect_list("mark").alias("marks")).withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    near = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    near = near.select("doc_id", "text_key", F.col("text").cast("binary").alias("data"), F.inline("marks"))
    near = near.withColumn("lead", F.least("at", F.lit(sizes.side)))
    near = near.select("doc_id", "text_key", "a", "kinds", "at", "lead", F.substring(F.col("data"), F.col("at") - F.col("lead") + 1, F.col("lead") + sizes.anchor + sizes.side).alias("context"))
    contexts = cut(near)
    few = contexts.filter(F.col("kinds") <= crowd).drop("kinds").repartition("a").sortWithinPartitions("a")
    many = contexts.filter(F.col("kinds") > crowd).drop("kinds")
    parts = _sorted_contexts(few, kind, sizes)
    if not many.isEmpty():
        parts = parts.unionByName(_counted_contexts(many, kind, sizes))
    stored = cut(whole.unionByName(parts))
    release(found, kinds, repeats, mixed, contexts)
    return stored


def _runs(stretches: list[dict], size: int) -> list[dict]:
    """Maximal runs of bytes that stretches make together."""
    runs: list[dict] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], size)) for s in stretches):
        if runs and lo <= runs[-1]["end"]:
            runs[-1]["end"] = max(hi, runs[-1]["end"])
        else:
            runs.append({"start": int(lo), "end": int(hi)})
    return runs


def _words(text: bytes, start: int, end: int) -> int:
    """Whole words of a text within a run of its bytes."""
    words = len(text[start:end].split())
    cut_off = [at for at in (start, end) if 0 < at < len(text) and not text[at - 1 : at].isspace() and not text[at : at + 1].isspace()]
    return words - len(cut_off)


@F.pandas_udf(LESS)
def _without(texts: pd.Series, stretches: pd.Series) -> pd.DataFrame:
    """Texts less their stretches, the runs these make together, and the runs of short ones of many words; nulls where there are none."""
    kept, spans, passages = [], [], []
    for text, own in zip(texts, stretches):
        if text is None or own is None:
            kept.append(None), spans.append(None), passages.append(None)
            continue
        runs = _runs([s for s in own if not s["short"]], len(text))
        edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans.append(runs)
        passages.append(sum(_words(text, r["start"], r["end"]) > WORDS for r in _runs([s for s in own if s["short"]], len(text))))
    return pd.DataFrame({"kept": kept, "spans": spans, "passages": passages})


def remove_repeated(docs: DataFrame, crowd: int = CROWD, sizes: Sizes = PASSAGE, short: Sizes | None = None) -> DataFrame:
    """Every row with its text less all passages of ``sizes.length`` bytes that start anywhere else too.

    Returns ``row`` (the whole input row), ``doc_id, n_bytes, kept`` (binary: a
    passage may end within a character), ``spans``, the maximal removed runs of
    bytes, and ``n_passages``: with ``short``, a smaller size, how many runs of
    repeated passages of that size have over ``WORDS`` words (0 without). These
    are told, not removed. Passages never cross documents; a passage that
    occurs twice in one text, overlaps included, counts as well. A null text is
    empty. Rows that repeat an id and a text repeat each other's passages. An
    empty table gives an empty result.
    """
    base = rows(docs, doc_id="doc_id", text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = base.withColumn("text_key", F.xxhash64("text"))
    found = repeated(base.drop("row"), crowd, sizes).withColumn("short", F.lit(False))
    if short is not None:
        found = found.unionByName(repeated(base.drop("row"), crowd, short).withColumn("short", F.lit(True)))
    found = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi", "short")).alias("stretches")).withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    data = F.col("text").cast("binary")
    joined = joined.withColumn("less", _without(F.when(F.col("stretches").isNotNull(), data), F.col("stretches")))
    spans = F.coalesce("less.spans", F.array().cast("array<struct<start:int,end:int>>"))
    return joined.select(
        "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("less.kept", data).alias("kept"), spans.alias("spans"),
        F.coalesce("less.passages", F.lit(0)).cast("long").alias("n_passages"),
    )
