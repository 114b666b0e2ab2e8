"""The operators as registered queries with production parameters: name -> (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as TOKENIZERS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, codes, language, licenses, linededup, mixing, neighbours, orderhash, pieces, pii, quality, resemblance, simhash, tokenfile
from .common import free, prepare, store, table

MIN_LANGUAGE_SCORE = 0.3
REPETITION = 1.25
N_BEST = 4


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return pii.report(docs, pii.learn(docs))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    return mixing.mix(docs, repetition=REPETITION)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_bad_lines", F.length("clean_text").cast("bigint").alias("clean_chars"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return tokenfile.write_and_read(docs, TOKENIZERS.path("word_bpe_49k.json"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(table(spark, folder, "documents", "doc_id", "text"))


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings", "vec_id", "embedding"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return pieces.encode(docs, TOKENIZERS.path("piece_bpe_32k.model"), N_BEST)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return language.identify(docs, language.learn(docs))


def op11_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.report(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    return alignment.report(docs, *map(TOKENIZERS.path, names))


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return orderhash.compare_neighbours(table(spark, folder, "documents", "doc_id", "text"))


# Pipeline stages: (spark, docs, folder) -> docs for the next stage.


def stage_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or language go."""
    prepare(spark)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = language.identify(whole, language.learn(docs), "row")
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).select("row.*")


def stage_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without repeated blocks of lines; documents of which nothing is left go."""
    prepare(spark)
    done = linededup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return done.where(left).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8): that of
    smallest id, null ids last, and one row of those that repeat both id and text."""
    prepare(spark)
    return resemblance.one_of_each(docs).select(*docs.columns)


def stage_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixture's copies of documents; a document taken twice has two rows.

    A document is a doc_id, null or not, with its text; rows that repeat both are one
    document, of which any row stands for all. Documents without words take no part.
    """
    prepare(spark)
    key, copies, copy = (free(docs, name) for name in ("_key", "_copies", "_copy"))
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("text")))
    keyed = docs.withColumn(key, own)
    repeated = store(keyed.groupBy(key).count().where("count > 1").select(key))
    if not repeated.isEmpty():
        twice = keyed.join(repeated, key, "left_semi").dropDuplicates([key])
        keyed = keyed.join(repeated, key, "left_anti").unionByName(twice)
    mixed = mixing.mix(keyed.select(F.col(key).alias("doc_id"), "source", "text"), repetition=REPETITION)
    taken = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").cast("int").alias(copies))
    return (
        keyed.join(taken, key)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*docs.columns)
    )


def stage_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, piece ids of the best segmentation, and the scores of the n best."""
    prepare(spark)
    return pieces.encode(docs, TOKENIZERS.path("piece_bpe_32k.model"), N_BEST)


STAGES = [
    ("language ID", stage_language),
    ("line dedup", stage_lines),
    ("simhash near-dedup", stage_near_duplicates),
    ("source mixing", stage_mix),
    ("sentencepiece", stage_pieces),
]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_licenses": op6_licenses,
    "op7_neighbours": op7_neighbours,
    "op8_pieces": op8_pieces,
    "op9_simhash": op9_simhash,
    "op10_language": op10_language,
    "op11_codes": op11_codes,
    "op12_alignment": op12_alignment,
    "op13_fingerprints": op13_fingerprints,
}
