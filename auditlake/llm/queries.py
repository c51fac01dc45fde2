"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.lineage import cut, folder

from . import exact, fingerprints, language, lines, mixing, near, packing, passages, phrases, pii, spelling, tokenfiles, urls
from .common import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op1_mix_sources", mixing.SQL)
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf), carry=False).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_exact_dedup", exact.SQL)
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.deduplicate(documents(spark, sf)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_line_dedup", lines.SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.drop_shared_lines(documents(spark, sf))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(documents(spark, sf))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in pii.BASE], F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf}/pages.parquet")).drop("row")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.tokenise(documents(spark, sf), vocabulary())
    # the ids themselves are not asked for, so only their checksums travel on
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(cut(digests))


@query("op2_language")
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learned = language.sample(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_syncmer_fingerprints")
def op5_syncmer_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_edits(documents(spark, sf))


@query("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf))


@query("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    less = passages.remove_repeated(documents(spark, sf), short=passages.SHORT)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return less.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


@query("op11_spelling_variants", spelling.SQL)
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    word = spelling.slipped(F.col("run"), F.col("doc_id"))
    return spelling.variants(spelling.counted(spelling.runs(documents(spark, sf)).select(word.alias("word"))))


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    place = folder(spark)
    tokenfiles.write(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), place)
    return tokenfiles.read(spark, place, ids=False)


@query("op13_collocations", phrases.SQL)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf))
