"""Ranked search over an inverted index of a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words

_POSTING = "bucket int, term string, doc_id long, n long, length long"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """Array of struct(term, n): every distinct word of an array and how often it occurs.

    The words are sorted and runs of equal ones measured, so a document is counted where it
    was read, in n log n steps, and nothing is shuffled for it.
    """

    def runs(ordered: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return _let(first, lambda starts: F.transform(
            starts,
            lambda at, i: F.struct(
                F.get(ordered, at).alias("term"),
                (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - at).cast("long").alias("n"),
            ),
        ))

    return F.when(F.size(tokens) > 0, _let(F.array_sort(tokens), runs)).otherwise(
        F.array().cast("array<struct<term:string,n:bigint>>")
    )


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index_documents(
    documents: DataFrame, folder: str, batch: int = 0, buckets: int = 64, fan: int = 16
) -> None:
    """Add documents (doc_id, text) to the index below `folder`.

    Postings (term, doc_id, n, length of the document in words) lie in folders by bucket of
    their term, sorted by term, so a query opens the buckets of its words only and skips row
    groups of others. A bucket is written by up to `fan` tasks, since one frequent word may
    hold a large part of all postings. An index is added to in numbered batches, which must
    not share documents; a batch that is repeated replaces itself. Documents without words
    have no postings, and count.
    """
    spark = documents.sparkSession
    tokens = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    postings = (
        documents.select("doc_id", tokens.alias("tokens"))
        .select("doc_id", F.size("tokens").cast("long").alias("length"), F.explode(term_counts(F.col("tokens"))).alias("t"))
        .select(_bucket(F.col("t.term"), buckets).alias("bucket"), "t.term", "doc_id", "t.n", "length")
        .repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(fan)))
        .sortWithinPartitions("bucket", "term", "doc_id")
    )
    path = f"{folder}/postings/batch={batch}"
    postings.write.mode("overwrite").partitionBy("bucket").parquet(path)
    n_words = spark.read.schema(_POSTING).parquet(path).select(F.lit(0).alias("n_docs"), F.col("n").alias("n_words"))
    n_docs = documents.agg(F.count("*").alias("n_docs")).select("n_docs", F.lit(0).alias("n_words"))
    sizes = n_words.unionByName(n_docs).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))
    sizes.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/sizes/batch={batch}")


def postings_of(spark: SparkSession, folder: str, terms: list[str], buckets: int) -> DataFrame:
    """Postings of the terms; other buckets are not read."""
    stored = spark.read.schema(f"batch int, {_POSTING}").parquet(f"{folder}/postings")
    return stored.filter(
        F.col("bucket").isin(*[_bucket(F.lit(t), buckets) for t in terms]) & F.col("term").isin(*terms)
    )


def ranked_search(
    spark: SparkSession, folder: str, keywords: list[str], k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """doc_id, keywords, score: the k documents with the highest BM25 score, best first.

    Each keyword counts once, in lower case. A term's share of the score is rounded to nine
    places before it is added, so the sum does not depend on the order of rows; ties go to
    the lower doc_id. No keyword or an empty corpus gives no rows.
    """
    sizes = spark.read.parquet(f"{folder}/sizes").agg(
        F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words"),
        F.min("buckets").alias("low"), F.max("buckets").alias("high"),
    ).first()
    if sizes.low != sizes.high:
        raise ValueError(f"batches of {sizes.low} and of {sizes.high} buckets in {folder}")
    terms = sorted({key.lower() for key in keywords})
    found = postings_of(spark, folder, terms, sizes.high)
    # One row for each keyword, so it is safe to broadcast.
    holders = F.broadcast(found.groupBy("term").agg(F.count("*").alias("holders")))
    idf = F.log(1 + (F.lit(float(sizes.docs)) - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
    mean_length = max(1.0, float(sizes.words)) / max(1, sizes.docs)
    weight = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / mean_length))
    return (
        found.join(holders, "term")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("keywords"),
            F.sum(F.round(idf * weight, 9).cast("decimal(20,9)")).cast("double").alias("score"),
        )
        .orderBy(F.desc("score"), "doc_id")
        .limit(k)
    )
