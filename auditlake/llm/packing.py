"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.lineage import cut

from .common import kept, ranked, shuffled

CAPACITY = 2048
#: Id that ends each document.
END = 0
#: Pieces of words, and words of texts that aren't plain, whose ids a worker keeps at most, and the longest of them in characters.
CACHED, CACHED_WORDS, CACHED_CHARS = 400_000, 100_000, 64
# fixed values, as class bodies: what plain text may hold, which a normaliser leaves as it is but for case, and its letters and numbers, lower-cased ones too
PLAIN = r"\x20-\x7E\x09-\x0D\xA1-\xAC\xAE-\u012F\u0131-\u0239\u023B-\u023D\u023F-\u024F"
LETTER, NUMBER = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u02AF", r"0-9\xB2\xB3\xB9\xBC-\xBE"
MARK = rf"^\x20\x09-\x0D{LETTER}{NUMBER}"
# the vocabulary's pieces in lower-cased plain text
ENDING = "'(?:[stmd]|re|ve|ll)"
PIECE = rf"{ENDING}|[{LETTER}]+|[{NUMBER}]|[{MARK}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: its own where it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Found(dict):
    """``make(key)``, found once and kept while there is room, for ``most`` keys at most.

    When half of them are new the other half goes but for what is asked for
    again, so that what comes often isn't lost.
    """

    def __init__(self, most: int):
        self.half, self.older = most // 2, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class PieceIds(Found):
    """Ids of a vocabulary's pieces as bytes, ``width`` for each id, from the tokenizer's model."""

    def __init__(self, tokenizer, most: int, width: int = 4):
        super().__init__(most)
        self.model, self.letters = tokenizer.model, byte_letters()
        self.numbers = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def make(self, piece: str) -> bytes:
        numbers = self.numbers
        plain = piece.isascii() and piece.isprintable()
        spelled = piece.replace(" ", self.letters[32]) if plain else "".join([self.letters[b] for b in piece.encode()])
        return b"".join([numbers[t.id] for t in self.model.tokenize(spelled)])


class WordIds(Found):
    """Ids of texts as bytes, of words where a text isn't plain.

    The tokenizer drops white space and never joins across it. Plain text, which
    its normaliser only lower-cases, is taken to pieces here and each piece goes
    to the tokenizer's model. In other texts, and those that hold the content of
    an added token, this is done with the words that are plain; all others go to
    the whole tokenizer. With ``spelled`` such contents are ordinary characters,
    as the tokenizer's flag ``encode_special_tokens`` has it.
    """

    def __init__(self, path: str, spelled: bool = False):
        from tokenizers import Tokenizer

        super().__init__(CACHED_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelled
        added = [] if spelled else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special, self.cut = re.compile("|".join([f"[^{PLAIN}]", *added])).search, re.compile(PIECE).findall
        self.pieces = PieceIds(self.tokenizer, CACHED)

    def plain(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.cut(text.lower())])

    def make(self, word: bytes) -> bytes:
        text = word.decode()
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids) if self.special(text) else self.plain(text)

    def encode(self, text: str) -> bytes:
        return b"".join([self[w] for w in text.encode().split()]) if self.special(text) else self.plain(text)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, spelled: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids``.

    ``ids`` holds little-endian unsigned 32-bit ids. Every document ends with id
    ``END``; a null text is empty and has that id alone. Only documents longer
    than ``capacity`` have more than one piece. The content of an added token in
    a text (``<|endoftext|>``) has that token's id, as by the tokenizer's
    defaults; with ``spelled`` it is spelled out, so that no text can hold one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(WordIds, tokenizer, spelled)
        end = packed([END])
        for batch in batches:
            of, piece, start, length, ids = [], [], [], [], []

            def made():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

            held = 0
            for i, text in enumerate(batch.column(1)):
                all_ids = words.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    own = all_ids[at : at + 4 * capacity]
                    of.append(i), piece.append(k), start.append(at // 4), length.append(len(own) // 4), ids.append(own)
                held += len(all_ids)
                if held > 1 << 24:
                    yield made()
                    of, piece, start, length, ids, held = [], [], [], [], [], 0
            yield made()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths, without any document.

    Returns runs ``(length, first_rank, last_rank, first_sequence,
    per_sequence, offset)``: the pieces of that length with those ranks fill the
    sequences from ``first_sequence`` on, ``per_sequence`` in each, from
    ``offset`` on. Sequences with equal room are one group, so the work and the
    plan grow with the number of lengths, not of pieces: a length opens two
    groups, splits one and uses others up.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if rooms.get(r)), None)
            if room is None:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = rooms[room].pop()
            # the best fit stays with a sequence until the length no longer fits
            each = room // length
            full = min(n, left // each)
            used, each = (full, each) if full else (1, left)
            runs.append((length, rank, rank + used * each - 1, first, each, capacity - room))
            rank, left = rank + used * each, left - used * each
            if used < n:
                rooms.setdefault(room, []).append((first + used, n - used))
            if room > each * length:
                rooms.setdefault(room - each * length, []).append((first, used))
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY, seed: str = "pack") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, from ``doc_id, piece, length``.

    Only the histogram of lengths (``capacity`` rows at most) reaches the
    driver, where slots are planned. Pieces are then ranked within their length,
    in shuffled order and dealt to buckets, as one length may own a third of
    them, and take the slot of their rank. The plan is broadcast: it has a few
    rows per length, at most ``capacity`` lengths. Pieces of equal id, number
    and length may be exchanged for one another.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = "run_length long, first_rank long, last_rank long, first_sequence long, per_sequence long, first_offset long"
    runs = pieces.sparkSession.createDataFrame(plan(counts, capacity), columns)
    order = pieces.withColumn("_order", shuffled(seed, F.concat_ws(":", "doc_id", "piece")))
    numbered = ranked(order, "length", ["_order", "doc_id", "piece", "start"], "_rank")
    slot = (F.col("length") == F.col("run_length")) & F.col("_rank").between(F.col("first_rank"), F.col("last_rank"))
    taken = F.col("_rank") - F.col("first_rank")
    return numbered.join(F.broadcast(runs), slot).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor((taken - taken % F.col("per_sequence")) / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + taken % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, spelled: bool = False) -> DataFrame:
    """Documents as packed sequences: pieces with their ids and places.

    Returns ``doc_id, piece, start, length, ids, sequence_id, offset``. Texts
    are tokenised once; the pieces are stored, as the plan must know all
    lengths before any piece has its place. Rows that repeat an id are packed
    each for itself. An empty table gives an empty result.
    """
    return place(cut(tokenise(docs, tokenizer, capacity, spelled)), capacity)
