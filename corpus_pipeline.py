"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns pieces with their places in sequences. Stages
carry whole rows, so columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.lineage import cut
from auditlake.llm import language, lines, mixing, near, packing
from auditlake.llm.common import small_batches
from auditlake.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table.

    Texts without letters (nulls too) go, those mostly in letters that their
    language's sample lacks, and those that take more bits per symbol than clean
    texts of that length (``language.references``). All labelled languages are
    learned. Repeated rows are judged alike; an empty table stays empty.
    """
    small_batches(spark)
    learned = language.sample(docs)
    found = language.identify(docs, learned)
    return found.filter(language.accepted(F.col("bits"), F.col("symbols"), F.col("lang_pred"), strange=F.col("strange"), reference=language.references(learned))).select("row.*")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that an earlier document holds.

    ``n_chars`` is counted anew. A text may become empty; its document stays.
    A null text becomes an empty one.
    """
    less = lines.drop_shared_lines(docs).select(F.col("row").withField("text", F.col("kept_text")).withField("n_chars", F.length("kept_text").cast("long")).alias("row"))
    return less.select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id.

    Of rows that repeat that id, the one with the smallest text hash stays; rows
    without id stay unless a row with an id has their set of shingles.
    """
    small_batches(spark)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    kept = near.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    stays = keyed.select("doc_id", "text_key").join(kept, keyed["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    named = stays.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    unnamed = stays.filter("doc_id IS NULL").distinct()
    wanted = cut(named.unionByName(unnamed)).withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    left = keyed.join(wanted, same, "left_semi")
    # only rows that are the same in id and text are left to meet
    return left.dropDuplicates(["doc_id", "text_key"]).select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, or not at all."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with checksums of their ids and places in sequences."""
    small_batches(spark)
    pieces = packing.tokenise(docs, vocabulary())
    digests = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.place(digests)


STAGES = [
    ("language", known_language),
    ("lines", without_shared_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("mix", mixed_sources),
    ("pack", packed),
]

#: Automata, shingle sets and tokenizers are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
