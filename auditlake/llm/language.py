"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, rows, shuffled

#: Bounds of the learning sample: documents per language, and symbols of each.
SAMPLE_DOCS, SAMPLE_SYMBOLS = 64, 700
#: A text is parsed in blocks of that many symbols, all of them side by side.
BLOCK = 1024
#: Symbols that are parsed at once, a bound on a task's memory.
AT_ONCE = 1 << 21
#: Lengths in symbols at which the rate of clean texts is measured.
LENGTHS = (16, 32, 64, 128, 256, 512, 1024)
#: Values that a measured rate needs at least.
LEAST = 4
GAP, OTHER = 0, 1
UNKNOWN = "und"
# fixed value: odd multiplier of the hash
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

RESULT = "lang_pred string, score double, bits double, symbols long, strange double"


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each non-null ``lang``, first by digest.

    Ids are ranked without their texts, each task sending on no more than it may
    keep; a text is cut at eight times what is learned from it.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("order", "doc_id")
    first = labelled.select("lang", "doc_id", shuffled("lang", F.col("doc_id")).alias("order"))
    first = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    ids = [r["doc_id"] for r in first.select("doc_id").collect()]
    found = labelled.filter(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, 8 * SAMPLE_SYMBOLS)).alias("text")) if ids else None
    texts: dict[str, list[str]] = {}
    for r in sorted(found.collect() if ids else [], key=lambda r: (r["lang"], str(r["doc_id"]))):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {lang: sorted(set(t)) for lang, t in texts.items()}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Parser:
    """Suffix automata of all languages, their edges in one hash table.

    States are numbered through all automata. An edge's key is its state and
    symbol (``state * width + symbol``). A match that cannot go on ends its
    phrase; the next state is then the one after the symbol from the root
    (``starts``). A symbol that the root doesn't know leads to state 0, which has
    no edges, so every way ends a phrase.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        letters = sorted({c for t in texts.values() for c in "".join(x.lower() for x in t) if c.isalpha()})
        self.symbol = np.where(_letters(), OTHER, GAP).astype(np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        self.width = len(letters) + 2
        self.starts = np.zeros((len(self.languages), self.width), np.int64)
        keys, ends, self.roots, self.sizes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], 1
        for i, lang in enumerate(self.languages):
            learned = np.concatenate([self.symbols(t)[0][:SAMPLE_SYMBOLS] for t in texts[lang]] or [np.zeros(0, np.int32)])
            moves = self._automaton(learned.tolist())
            self.roots.append(at)
            self.sizes.append(max(2, len(learned)))
            states = np.repeat(np.arange(len(moves)) + at, [len(m) for m in moves])
            keys.append(states * self.width + np.fromiter((c for m in moves for c in m), np.int64, len(states)))
            ends.append(np.fromiter((q for m in moves for q in m.values()), np.int64, len(states)) + at)
            self.starts[i, list(moves[0])] = np.array(list(moves[0].values()), np.int64) + at
            at += len(moves)
        self._store(np.concatenate(keys), np.concatenate(ends))

    @staticmethod
    def _automaton(text: list[int]) -> list[dict[int, int]]:
        """Transitions of each state of the suffix automaton of ``text``."""
        moves, link, longest, last = [{}], [-1], [0], 0
        for c in text:
            new = len(moves)
            moves.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:
                    clone = len(moves)
                    moves.append(moves[q].copy())
                    link.append(link[q])
                    longest.append(longest[p] + 1)
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        return moves

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MULTIPLY) >> self.shift).view(np.int64)

    def _store(self, keys: np.ndarray, ends: np.ndarray) -> None:
        """The edges in a table at most half full; one whose place is taken goes to the next free place."""
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ends = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.flatnonzero(self.keys[place] < 0)
            taken, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[taken], self.ends[taken] = keys[left[won]], ends[left[won]]
            left, place = np.delete(left, won), (np.delete(place, won) + 1) & self.mask

    def _ends(self, keys: np.ndarray) -> np.ndarray:
        """The states that edges lead to, 0 where there is no such edge."""
        place = self._home(keys)
        there = self.keys.take(place)
        same = there == keys
        out = self.ends.take(place) * same
        look = np.flatnonzero(~same & (there >= 0))
        flat, keys, place = out.ravel(), keys.ravel(), place.ravel()
        while len(look):
            at = (place[look] + 1) & self.mask
            place[look] = at
            there = self.keys[at]
            hit = there == keys[look]
            flat[look[hit]] = self.ends[at[hit]]
            look = look[~hit & (there >= 0)]
        return flat.reshape(out.shape)

    def symbols(self, *texts: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in turn, runs of what is no letter as one gap; and how many each has."""
        lowered = [t.lower() for t in texts]
        found = self.symbol[code_points("".join(lowered))]
        ends = np.cumsum([len(t) for t in lowered])
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != GAP) | (found[:-1] != GAP)
        starts = ends - [len(t) for t in lowered]
        keep[starts[starts < len(found)]] = True
        before = np.zeros(len(found) + 1, np.int32)
        np.cumsum(keep, out=before[1:])
        return found[keep], (before[ends] - before[starts]).astype(np.int64)

    def phrases(self, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases per language and text, from the symbols of texts that follow one another."""
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(sizes)), blocks)
        starts = np.cumsum(sizes) - sizes
        within = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = starts[of] + within * BLOCK
        length = np.minimum(BLOCK, sizes[of] - within * BLOCK)
        order = np.argsort(-length, kind="stable")
        first, length, of = first[order], length[order], of[order]
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(of), 1)
        count = np.ones((len(self.languages), len(of)), np.int32)
        live = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        for step in range(int(length[0]) if len(length) else 0):
            n = live[step]
            symbol = found[first[:n] + step]
            after = self._ends(state[:, :n] * self.width + symbol)
            ended = after == 0
            if step:  # each block begins a phrase, which is counted already
                count[:, :n] += ended
            state[:, :n] = np.where(ended, self.starts[:, symbol], after)
        return np.stack([np.bincount(of, c, len(sizes)) for c in count])

    def strange(self, found: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Share of each text's letters that the learned text of its language (``of``) doesn't hold."""
        ends = np.cumsum(sizes)
        letter = found != GAP
        unknown = letter & (self.starts[np.repeat(of, sizes), found] == 0)
        of_letters, of_unknown = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (letter, unknown))
        return of_unknown / np.maximum(of_letters, 1)

    def judge(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per symbol, number of symbols and share of unknown letters of each text."""
        found, sizes = self.symbols(*texts)
        has = np.add.reduceat(np.append(found != GAP, False), np.minimum(np.cumsum(sizes) - sizes, len(found))) * (sizes > 0) > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), sizes, has.astype(float)
        # a phrase is a place in the learned text
        bits = self.phrases(found, sizes) * np.log2(self.sizes)[:, None] / np.maximum(sizes, 1)
        best = bits.argmin(0)
        low = bits.min(0)
        second = np.partition(bits, 1, 0)[1] if len(bits) > 1 else np.full(len(texts), np.inf)
        score = np.where(has, 1 / (1 + low / np.maximum(second, 1e-9)), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], score, low, sizes, self.strange(found, sizes, best)


def _held_in(learned: list[str], held: list[str], rng: np.random.Generator) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of unknown letters in ``held``, and by length the bits per symbol of its windows, as they are and shuffled."""
    parser = Parser({"": learned})
    texts = [parser.symbols(t)[0] for t in held]
    sizes = np.array([len(t) for t in texts])
    all_of_them = np.concatenate(texts)
    strange = float(parser.strange(all_of_them, np.array([len(all_of_them)]), np.array([0]))[0])
    rates = []
    for mixed in (False, True):
        source = [rng.permutation(t) for t in texts] if mixed else texts
        of_lengths = []
        for n in LENGTHS:
            windows = [t[i : i + n] for t in source for i in range(0, len(t) - n + 1, n)]
            counts = parser.phrases(np.concatenate(windows), np.full(len(windows), n))[0] if windows else np.zeros(0)
            of_lengths.append(counts * np.log2(parser.sizes[0]) / n)
        rates.append(of_lengths)
    return strange, *rates


def references(texts: dict[str, list[str]]) -> dict[str, tuple[float, list[float | None]]]:
    """What clean texts of each language reach: share of unknown letters, and bits per symbol at each of ``LENGTHS``.

    Each half of a language's sample (of its only text, if there is one) is
    parsed by the automaton of the other half, in windows. The limit at a length
    is the median and five times the spread of what lies above it, and at least a
    third of the way from the median to the same text with its symbols shuffled.
    Lengths with fewer than ``LEAST`` windows have the limit of the next shorter
    one, or None. Of letters, half of those that clean text knows may be unknown.
    """
    rng, out = np.random.default_rng(7), {}
    for lang, sample_texts in sorted(texts.items()):
        t = sample_texts
        if len(t) == 1:
            t = [t[0][: len(t[0]) // 2], t[0][len(t[0]) // 2 :]]
        half = len(t) // 2
        folds = [_held_in(a, b, rng) for a, b in ((t[:half], t[half:]), (t[half:], t[:half])) if a and b]
        limits: list[float | None] = []
        for i in range(len(LENGTHS)):
            clean, mixed = (np.concatenate([f[k][i] for f in folds] or [np.zeros(0)]) for k in (1, 2))
            if len(clean) < LEAST:
                limits.append(limits[-1] if limits else None)
                continue
            middle = float(np.median(clean))
            above = clean[clean > middle] - middle
            spread = float(np.sqrt(np.mean(above**2))) if len(above) else 0.0
            limits.append(middle + max(5 * spread, (float(np.median(mixed)) - middle) / 3))
        out[lang] = ((1 + max([f[0] for f in folds], default=0.0)) / 2, limits)
    return out


def predict(text: Column, learned: dict[str, list[str]]) -> Column:
    """Struct ``lang_pred, score, bits, symbols, strange`` of a text, by the samples in ``learned``.

    The language whose automaton parses the text into the fewest phrases, each
    weighed by the logarithm of the learned text's size, wins; equal counts go
    to the smaller code. ``score`` is the second best count's share of the two
    best (0.5: no difference), and 0 for null texts and those without letters,
    which are ``und``. All of a text is parsed, in blocks of ``BLOCK`` symbols.
    The automata are built here once and broadcast: workers hold their finished
    tables, not what building them takes.
    """
    shared = SparkSession.active().sparkContext.broadcast(Parser(learned))

    @F.pandas_udf(RESULT)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = kept(getattr, shared, "value")
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            results, first = [], 0
            while first < len(texts):
                last, n = first, 0
                while last < len(texts) and (n == 0 or n + len(texts[last]) <= AT_ONCE):
                    n, last = n + len(texts[last]) + 1, last + 1
                lang, score, bits, symbols, strange = parser.judge(texts[first:last])
                results.append(pd.DataFrame({"lang_pred": lang, "score": score, "bits": bits, "symbols": symbols, "strange": strange}))
                first = last
            yield pd.concat(results) if results else pd.DataFrame({"lang_pred": [], "score": [], "bits": [], "symbols": [], "strange": []})

    return parsed.asNondeterministic()(text)


def identify(docs: DataFrame, learned: dict[str, list[str]] | None = None) -> DataFrame:
    """Every row with the language of its text.

    Returns ``row`` (the whole input row), ``doc_id, lang_pred, score, bits,
    symbols, strange`` (the share of letters that the language's sample lacks). Without ``learned``, a sample of ``docs`` itself is learned; an
    empty one leaves every text ``und``. Rows are judged one by one: ties and
    repeated rows have equal results, and other columns have no effect.
    """
    learned = sample(docs) if learned is None else learned
    d = rows(docs, doc_id="doc_id", text=F.col("text").cast("string"))
    return d.withColumn("found", predict(F.col("text"), learned)).select("row", "doc_id", "found.*")


def accepted(bits: Column, symbols: Column, lang_pred: Column, limit: float = 6.0, strange: Column | None = None, reference: dict | None = None) -> Column:
    """Whether a text is in one of the learned languages.

    With ``strange`` and the sample's ``references``, a text goes when more of
    its letters are unknown to the language than the reference allows, whatever
    its length, or when it takes more bits per symbol than the reference of the
    longest length it reaches. Where there is no reference, texts of 200 symbols
    and more go at ``limit`` bits. Texts without letters always go.
    """
    known = lang_pred != UNKNOWN
    fixed = (symbols < 200) | (bits < limit)
    if not reference or strange is None:
        return known & fixed
    reach = sum((symbols >= n).cast("int") for n in LENGTHS)
    # one entry per learned language
    shares = F.create_map(*[F.lit(x) for lang, (share, _) in reference.items() for x in (lang, share)])
    rates = F.create_map(*[x for lang, (_, limits) in reference.items() for x in (F.lit(lang), F.array(*[F.lit(v).cast("double") for v in limits]))])
    measured = F.when(reach > 0, F.get(rates[lang_pred], reach - 1))
    fits = F.when(reach == 0, F.lit(True)).when(measured.isNull(), fixed).otherwise(bits <= measured)
    return known & (strange <= F.coalesce(shares[lang_pred], F.lit(0.5))) & fits
