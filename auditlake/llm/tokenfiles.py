"""Token ids as binary files: one array of ids, document boundaries in Elias-Fano code.

A file, all numbers little-endian:

=========  =====================================================================
bytes      what
=========  =====================================================================
8          ``MAGIC``
36         ``HEADER``: range and turn (files are in that order), bytes of an id,
           documents, of them those without id, ids, least document id
...        the ids of all documents one after another
...        Elias-Fano code of the documents' ends in that array
...        Elias-Fano code of the document ids less the least one
1          a line feed
=========  =====================================================================

Elias-Fano code holds n values up to u in about 2 + log2(u / n) bits each: the
low bits as they are, the high bits in unary, one set bit per value. Every
``EVERY``-th set bit's place is kept in 32 bits, so that a value is found by
looking through the bits between two of these places.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.lineage import cut

from .packing import END, ENDING, LETTER, MARK, NUMBER, PLAIN, Found, PieceIds

MAGIC, HEADER, CODE = b"TOKIDS01", struct.Struct("<iiiiiqq"), struct.Struct("<qiiii")
#: Set bits from one kept place to the next.
EVERY = 256
#: Ids of a file at most, but for a document that alone has more; bytes of text that one task encodes, where shuffle partitions don't make them fewer.
FILE_IDS, RANGE_BYTES = 1 << 24, 1 << 27
#: Chunks, and pieces, whose ids a worker keeps at most.
CACHED = 1 << 19
# fixed values: white space, and the pieces of the byte-level vocabulary
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same in plain text
PLAIN_PIECE = rf"{ENDING}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[{MARK}]+|\s+(?!\S)|\s+"


class EliasFano:
    """A rising sequence of numbers (equal ones allowed) in near-minimal space."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.size, self.width, self.low, self.high, self.places = size, width, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        at = (values >> width) + np.arange(n)
        bits = np.zeros((most >> width) + n + 1, np.uint8)
        bits[at] = 1
        low = (values[:, None] >> np.arange(width)) & 1
        return cls(n, width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), at[::EVERY].astype(np.uint32))

    def written(self) -> bytes:
        return CODE.pack(self.size, self.width, len(self.low), len(self.high), len(self.places)) + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The code that starts at ``at``, and where it ends."""
        size, width, low, high, places = CODE.unpack_from(data, at)
        at += CODE.size
        parts = []
        for kind, count in ((np.uint8, low), (np.uint8, high), ("<u4", places)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(size, width, *parts), at

    def __len__(self) -> int:
        return self.size

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.width:
            return np.zeros(last - first, np.int64)
        start, end = first * self.width, last * self.width
        bits = np.unpackbits(self.low[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start]
        return bits.reshape(-1, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def block(self, k: int) -> np.ndarray:
        """Values ``k * EVERY`` to the next block's first, found between two kept places."""
        first, last = k * EVERY, min(self.size, (k + 1) * EVERY)
        start = int(self.places[k])
        end = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start]
        at = np.flatnonzero(bits)[: last - first] + start
        return ((at - np.arange(first, last)) << self.width) | self._lows(first, last)

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        return int(self.block(i // EVERY)[i % EVERY])

    def values(self) -> np.ndarray:
        """All values in turn."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((at - np.arange(self.size)) << self.width) | self._lows(0, self.size)

    def first_at_least(self, value: int) -> int:
        """Index of the first value of at least ``value``; ``len(self)`` if there is none."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.select(middle) < value else (low, middle)
        return low


class TokenFile:
    """One file: documents by index or id, without a table of offsets."""

    def __init__(self, content: bytes):
        data = memoryview(content)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        self.range, self.turn, self.width, self.documents, self.unnamed, self.size, self.least = HEADER.unpack_from(data, 8)
        at = 8 + HEADER.size
        self.array = np.frombuffer(data, f"<u{self.width}", self.size, at)
        self.ends, at = EliasFano.read(data, at + self.array.nbytes)
        self.keys, _ = EliasFano.read(data, at)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends in the file's ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        first, last = self.bounds(i)
        return self.array[first:last]

    def find(self, doc_id: int) -> list[int]:
        """Indexes of the documents of that id."""
        i = self.keys.first_at_least(doc_id - self.least)
        last = self.keys.first_at_least(doc_id - self.least + 1)
        return [self.unnamed + k for k in range(i, last)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self.keys.values() + self.least).tolist()


def file_bytes(of_range: int, turn: int, width: int, doc_ids: list[int | None], sizes: list[int], ids: list[bytes]) -> bytes:
    """A file of these documents, in ascending order of ids, those without one first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(sizes, np.int64))
    head = HEADER.pack(of_range, turn, width, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]) if len(ends) else 0, least)
    return b"".join([MAGIC, head, *ids, EliasFano.of(ends).written(), EliasFano.of(known - least).written()])


class Encoder(Found):
    """Ids of whole texts as little-endian bytes, of chunks where a text isn't plain.

    Plain text is taken to pieces at once, and the ids of a piece are found once
    and kept while there is room. In other texts a space before anything but
    white space always starts a new piece of the vocabulary, so these are split
    there and the ids of a chunk are kept likewise. Texts that hold the content
    of an added token go to the tokenizer whole, which alone knows where that
    counts.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__(CACHED)
        self.tokenizer = Tokenizer.from_file(path)
        self.code, self.width = ("H", 2) if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else ("I", 4)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.cut = re.compile(f" (?=[^{WHITE}])").split, regex.compile(PIECE).findall
        self.odd, self.cut_plain = re.compile(f"[^{PLAIN}]").search, re.compile(PLAIN_PIECE).findall
        self.pieces = PieceIds(self.tokenizer, CACHED, self.width)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def make(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``."""
        return b"".join([self.pieces[p] for p in self.cut(" " + chunk)])

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = self.pieces
        if not self.odd(text):
            return b"".join([pieces[p] for p in self.cut_plain(text)])
        first, *rest = self.split(text)
        return b"".join([pieces[p] for p in self.cut(first)] + [self[c] for c in rest])


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker, for all its tasks."""
    return Encoder(path)


def files(docs: DataFrame, tokenizer: str, file_ids: int = FILE_IDS, end: int = END) -> DataFrame:
    """The files of ``docs``, one row ``content`` each.

    Documents are dealt to ranges of ``doc_id`` (an integer), sorted within, and
    encoded as they come; a task holds one file at a time.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key")]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of_range, turn = encoder(tokenizer), TaskContext.get().partitionId(), 0
        last = words.packed([end])
        doc_ids, sizes, ids, held = [], [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(of_range, turn, words.width, doc_ids, sizes, ids)], pa.binary())], names=["content"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = words.encode(text.as_py()) + last
                if doc_ids and held + len(own) > file_ids * words.width:
                    yield made()
                    turn, held = turn + 1, 0
                    doc_ids, sizes, ids = [], [], []
                doc_ids.append(doc_id.as_py()), sizes.append(len(own) // words.width), ids.append(own)
                held += len(own)
        if doc_ids:
            yield made()

    dealt = d.withColumn("text_key", F.xxhash64("text")).repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(encoded, "content binary")


def write(docs: DataFrame, tokenizer: str, folder: str, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all documents to files in ``folder``, in ascending order of ``doc_id``.

    Each document's ids end with id ``END``; a null text has that id alone.
    Documents without id come first, rows of equal id follow in the order of
    their texts' hashes and repeated rows are all written. An empty table makes
    files without content. Bytes go through Spark's text writer, one row a file,
    so any file system will do and a lost task leaves nothing behind.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer")
    files(docs, tokenizer, file_ids).select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).mode("errorifexists").text(folder)


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Every document of the files in ``folder``: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it; ``ids`` and the
    checksum are of little-endian unsigned 32-bit numbers. Files are read once;
    what is before a file is summed up from the documents' sizes.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_py())
                ends = file.ends.values()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                doc_ids = pa.array(file.doc_ids(), pa.int64())
                for first in range(0, file.documents, 1000):
                    some = slice(first, first + 1000)
                    own = [file.array[a:b].astype("<u4").tobytes() for a, b in zip(starts[some], ends[some])]
                    n = len(own)
                    columns = [doc_ids[some], pa.array([file.range] * n, pa.int32()), pa.array([file.turn] * n, pa.int32()), pa.array(starts[some]), pa.array(ends[some] - starts[some]), pa.array([zlib.crc32(o) for o in own], pa.int64())]
                    names = ["doc_id", "range", "turn", "before", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.array(own, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, range int, turn int, before long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    content = spark.read.format("binaryFile").load(folder).filter(F.col("length") > len(MAGIC)).select("content")
    found = cut(content.mapInArrow(parsed, kind))

    # files before a file: in its block of ranges, and in the blocks before
    sums = found.groupBy("range", "turn").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("range") / 1024))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier.orderBy("block")), F.lit(0)).alias("blocks_before"))
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy("block").orderBy("range", "turn")), F.lit(0))
    bases = sums.withColumn("inside", inside).join(blocks, "block").select("range", "turn", (F.col("inside") + F.col("blocks_before")).alias("base"))
    return found.join(bases, ["range", "turn"]).select("doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
