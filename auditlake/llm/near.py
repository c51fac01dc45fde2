"""Near-duplicates: universal minima, bands, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from auditlake.lineage import cut, release

#: Words of a shingle, and the similarity that links, in hundredths.
WORDS, SIMILAR = 5, 75
#: Minima of a band and bands: a pair at 0.75 shares no band once in 13,000 times.
BAND, BANDS = 4, 25
HASHES = BAND * BANDS
#: Share of equal minima that sends a pair on to the full sets, 4.4 deviations below 0.75.
PROMISING = 0.56
#: Members of a bucket that meet in one task when components of it are compared.
BLOCK = 4096
#: Rounds after which the star contraction gives up with an error; it needs the logarithm of a component's size.
ROUNDS = 60

_draw = np.random.Generator(np.random.PCG64(20))
FACTORS = _draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2)
# fixed values: odd multipliers
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode().translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    if not n:
        return h
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * STEP + h[i : len(words) - n + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (multiply, add, keep the high half) over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        block = np.multiply.outer(FACTORS, hashes[at : at + 4096])
        block += SHIFTS[:, None]
        np.minimum(least, block.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILAR * (len(a) + len(b) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, set_a, set_b, n_shingles, signature, bands`` of each row.

    ``set_a`` and ``set_b`` are a 128-bit digest of the set; ``signature`` holds
    the minima, ``bands`` a hash of each band. Empty sets have neither.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, signs, bands = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                sign = minima(own)
                signs.append(sign.tobytes() if len(own) else None)
                bands.append([xxhash.xxh3_64_intdigest(sign[i : i + BAND].tobytes(), i) - (1 << 63) for i in range(0, HASHES, BAND)] if len(own) else [])
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "set_a", "set_b", "n_shingles", "signature", "bands"],
            )

    schema = f"doc_id {kind}, set_a long, set_b long, n_shingles long, signature binary, bands array<long>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(signed, schema)


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal minima of two signatures."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, HASHES) for s in (a, b))
    return pd.Series((x == y).mean(1))


@F.pandas_udf(BooleanType())
def linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the full sets of two texts are similar."""
    known = lru_cache(64)(shingles)
    return pd.Series([similar(known(x), known(y)) for x, y in zip(a, b)], dtype=bool)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of all nodes in ``links`` (``u, v``).

    Large and small stars alternate: each node hands its larger neighbours, then
    all that are not larger, to the least node around it, until nothing moves.
    Every round is stored and the one before it deleted.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))))
        after = cut(small.filter("u <> v").distinct())
        release(edges)
        edges = after
        new = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if new == state:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = new
    raise RuntimeError(f"components did not settle within {ROUNDS} rounds")


def _confirmed(pairs: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``u, v``) that are similar, first by size and signature, then on full sets.

    The text of ``u`` travels with its pairs to ``v``: a node that many others
    are compared with sends its own text once.
    """
    def of(table: DataFrame, node: str) -> DataFrame:
        return table.withColumnsRenamed({c: f"{c}_{node}" if c != "node" else node for c in table.columns})

    near = pairs.join(of(signs, "u"), "u").join(of(signs, "v"), "v")
    near = near.filter(F.lit(100) * F.least("n_shingles_u", "n_shingles_v") >= F.lit(SIMILAR) * F.greatest("n_shingles_u", "n_shingles_v"))
    near = near.filter(agreement("signature_u", "signature_v") >= PROMISING).select("u", "v").distinct()
    full = near.join(of(texts, "u"), "u").join(of(texts, "v"), "v")
    return full.filter(linked("text_u", "text_v")).select("u", "v")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links across components, from rows ordered by ``key, block, asks``.

    Members of a block are held, rows that ask pass by one at a time. A pair is
    looked at in the first band it shares only, and no further for a component
    once a link to it is found.
    """
    place, held, signs = None, [], None
    parent: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}

    def root(part: int) -> int:
        while parent.get(part, part) != part:
            part = parent[part]
        return part

    for batch in batches:
        out = []
        places = list(zip(batch["key"], batch["block"]))
        for at, asks, band, node, part, size, sign, text in zip(places, *(batch[c] for c in ("asks", "band", "node", "component", "n_shingles", "signature", "text"))):
            if at != place:
                place, held, signs, parent, sets = at, [], None, {}, {}
            if not asks:
                held.append((node, part, size, sign, text))
                continue
            if signs is None and held:
                signs = np.frombuffer(b"".join(h[3] for h in held), np.uint32).reshape(-1, HASHES)
                parts, sizes = np.array([h[1] for h in held]), np.array([h[2] for h in held])
            if signs is None:
                continue
            same = signs == np.frombuffer(sign, np.uint32)
            like = same.mean(1)
            good = np.flatnonzero((parts != part) & (like >= PROMISING) & (100 * np.minimum(sizes, size) >= SIMILAR * np.maximum(sizes, size)))
            good = good[same[good].reshape(-1, BANDS, BAND).all(2).argmax(1) == band] if len(good) else good
            own = None
            for i in good[np.argsort(-like[good], kind="stable")]:
                if root(part) == root(int(parts[i])):
                    continue
                own = shingles(text) if own is None else own
                if i not in sets:
                    sets[i] = shingles(held[i][4])
                if similar(own, sets[i]):
                    parent[root(part)] = root(int(parts[i]))
                    out.append((node, held[i][0]))
        yield pd.DataFrame(out, columns=["u", "v"])


def _across(crowded: DataFrame, signs: DataFrame, texts: DataFrame, component: DataFrame) -> DataFrame:
    """Links ``u, v`` within buckets whose nodes are still in different components.

    Members of the component that owns most of a bucket are dealt to blocks of
    bounded size; all other members are dealt too, and meet each block as they
    pass by. No pair is a row, and no task holds more than a block.
    """
    placed = crowded.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    share = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    per_key = share.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_rows = placed.join(per_key.select("key", F.col("main.component").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = F.array(F.struct(own.alias("block"), F.lit(False).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("asks")))
    places = F.when(F.col("component") != F.col("main"), F.concat(met, asked)).otherwise(met)
    rows = open_rows.select("key", "band", "node", "component", F.inline(places)).join(signs, "node").join(texts, "node")
    ordered = rows.repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    found = ordered.select("key", "block", "asks", "band", "node", "component", "n_shingles", "signature", "text").mapInPandas(_compared, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The near-duplicate group of every row: ``doc_id, n_shingles, component_id, kept``.

    Equal sets of shingles are one class, of which one member goes on, so copies
    of any number cost one row per task. Classes that share a band are linked
    to the member of the bucket that meets most others (a star, not all pairs);
    links are checked by signature, then on the full sets. Buckets whose members
    are still in several components are compared across them, so a link between
    two members is only left out where they are connected anyway. Components
    come from alternating large and small stars.

    Rows that repeat a ``doc_id`` are one document: their sets are in one
    component. A null id can't name one: such rows join only rows of an equal
    set, have that set's ``component_id`` (null if no row of it has an id), and
    are ``kept`` only then. A null or empty text has no shingles and is linked
    with nothing. An empty table gives an empty result.
    """
    signed = cut(signatures(docs))
    words = signed.filter("n_shingles > 0")
    classes = words.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = cut(classes)
    nodes = classes.filter("node IS NOT NULL")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = cut(banded.join(sizes, "key"))
    candidates = crowded.select("node").distinct()
    signs = cut(nodes.join(candidates, "node", "left_semi").select("node", "n_shingles", "signature"))
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text")).join(candidates, "node", "left_semi")
    texts = cut(texts)

    mass = crowded.groupBy("node").agg(F.sum("n").alias("mass"))
    hubs = crowded.join(mass, "node").groupBy("key").agg(F.max(F.struct("mass", (-F.col("node")).alias("minus"))).alias("hub"))
    stars = crowded.join(hubs.select("key", (-F.col("hub.minus")).alias("v")), "key").select(F.col("node").alias("u"), "v").filter("u <> v").distinct()
    links = cut(_confirmed(stars, signs, texts))
    component = cut(components(links))
    more = cut(_across(crowded, signs, texts, component))
    if not more.isEmpty():
        known = component.select(F.col("node").alias("u"), F.col("component").alias("v"))
        merged = cut(components(known.unionByName(more)))
        release(component)
        component = merged
    release(more)
    release(crowded, signs, texts, links)

    of_set = classes.select("set_a", "set_b", "node").join(component, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    joined = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
