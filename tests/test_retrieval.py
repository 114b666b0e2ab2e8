import math
import re

import pytest
from pyspark.sql import functions as F

from assaylake.operators import retrieval


def ranks(local, keywords, k, k1=1.2, b=0.75):
    """BM25 over (doc_id, words), one document after the other."""
    mean = sum(len(t) for _, t in local) / len(local)
    scored = []
    for doc, tokens in local:
        score, hit = 0.0, 0
        for word in sorted(set(keywords)):
            n = tokens.count(word)
            holders = sum(word in t for _, t in local)
            if n:
                idf = math.log(1 + (len(local) - holders + 0.5) / (holders + 0.5))
                score += idf * n * (k1 + 1) / (n + k1 * (1 - b + b * len(tokens) / mean))
                hit += 1
        if hit:
            scored.append((doc, hit, round(score, 6)))
    return sorted(scored, key=lambda r: (-r[2], r[0]))[:k]


def test_term_counts(spark):
    arrays = spark.createDataFrame([(["b", "a", "b"],), ([],), (["a"],)], "t array<string>")
    got = [sorted(map(tuple, r[0])) for r in arrays.select(retrieval.term_counts(F.col("t"))).collect()]
    assert sorted(got) == [[], [("a", 1)], [("a", 1), ("b", 2)]]


def test_ranks_like_a_loop(spark, data, tmp_path):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    local = [(r["doc_id"], re.findall(r"[^\W_]+", r["text"].lower())) for r in texts.collect()]
    words = sorted({w for _, tokens in local[:10] for w in tokens[:8]})
    index = str(tmp_path / "index")
    # Two batches, one of them written twice.
    for batch, part in ((0, texts.filter("doc_id % 3 = 0")), (1, texts.filter("doc_id % 3 <> 0")), (1, texts.filter("doc_id % 3 <> 0"))):
        retrieval.index_documents(part, index, batch, buckets=8)
    for wanted in (words[:1], words[:5], [w.upper() for w in words[5:25]]):
        got = [(r.doc_id, r.keywords, round(r.score, 6)) for r in retrieval.ranked_search(spark, index, wanted, 10**6).collect()]
        expected = ranks(local, [w.lower() for w in wanted], 10**6)
        assert {g[:2] for g in got} == {e[:2] for e in expected}
        scores = {e[0]: e[2] for e in expected}
        assert all(abs(score - scores[doc]) < 2e-6 for doc, _, score in got)
        assert got == sorted(got, key=lambda r: (-r[2], r[0])) or len({g[2] for g in got}) < len(got)
        assert [g[0] for g in got[:5]] == [r.doc_id for r in retrieval.ranked_search(spark, index, wanted, 5).collect()]
    assert retrieval.ranked_search(spark, index, [], 5).count() == 0
    assert retrieval.ranked_search(spark, index, ["nosuchword"], 5).count() == 0


def test_a_query_reads_its_buckets_only(spark, tmp_path):
    index = str(tmp_path / "index")
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.col("id").cast("string")).alias("text"))
    retrieval.index_documents(texts, index, buckets=32)
    found = retrieval.postings_of(spark, index, ["common"], 32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    number = spark.range(1).select(retrieval._bucket(F.lit("common"), 32)).first()[0]
    assert f"(bucket#" in plan and re.search(rf"PartitionFilters: \[[^\]]*= {number}\)", plan)
    assert re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert found.count() == 500
    files = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert len(files) <= 16 and all(f"/bucket={number}/" in f for f in files)


def test_empty_texts_and_unequal_batches(spark, rows, tmp_path):
    index = str(tmp_path / "index")
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a a b"), (4, "a")], "doc_id long, text string")
    retrieval.index_documents(texts, index, buckets=4)
    local = [(1, []), (2, []), (3, ["a", "a", "b"]), (4, ["a"])]
    got = [(r.doc_id, r.keywords, round(r.score, 6)) for r in retrieval.ranked_search(spark, index, ["a", "b"], 9).collect()]
    assert got == ranks(local, ["a", "b"], 9)
    retrieval.index_documents(texts.limit(0), index, 1, buckets=4)
    assert rows(retrieval.ranked_search(spark, index, ["b"], 9), "doc_id") == [(3,)]
    retrieval.index_documents(texts.limit(0), index, 2, buckets=8)
    with pytest.raises(ValueError):
        retrieval.ranked_search(spark, index, ["b"], 9)
