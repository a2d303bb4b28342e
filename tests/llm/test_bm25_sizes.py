"""BM25 over many shards and groups of queries."""

import numpy as np
from pyspark.sql import functions as F

from prismframe.llm import bm25


def test_bm25_builds_a_shard_once_for_several_groups_and_starts_from_known_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 300) for _ in range(330)]
    texts += texts[:20]
    docs = spark.createDataFrame([*enumerate(texts), (400, None)], "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    calls, search = [], bm25._search
    monkeypatch.setattr(bm25, "_search", lambda *args: calls.append(args) or search(*args))
    one = bm25.search(docs, queries, k=5, shard_docs=1000).collect()
    assert len(calls) == 1
    several = bm25.search(docs, queries, k=5, shard_docs=1000, group_terms=100).collect()  # some 8 groups
    assert len(calls) == 2
    many = bm25.search(docs, queries, k=5, shard_docs=8).collect()  # 44 shards, of which every 16th goes first
    assert len(calls) == 4
    assert len(one) == len({(r["query_id"], r["rank"]) for r in one}) > 100
    assert sorted(one) == sorted(several) == sorted(many)


def test_bm25_leaves_only_scores_below_the_least():
    rng = np.random.default_rng(9)
    bags = [np.unique(rng.zipf(1.3, int(rng.integers(1, 200))) % 5000, return_counts=True) for _ in range(1500)]
    sizes, lengths = np.array([c.sum() for _, c in bags]), np.array([len(t) for t, _ in bags])
    index = bm25.ShardIndex(np.arange(len(bags)), sizes, lengths, np.concatenate([t for t, _ in bags]).astype(np.uint64), np.concatenate([c for _, c in bags]), float(sizes.mean()))
    assert 0 < len(index.dense) < len(index.terms)
    known, term = np.unique(np.concatenate([t for t, _ in bags[:300]]).astype(np.uint64), return_inverse=True)
    asked = bm25.Queries(np.arange(300), np.append(0, np.cumsum(lengths[:300])), known, term, np.concatenate([c * rng.random(len(c)) for _, c in bags[:300]]))
    whole = list(index.search_all(asked, 10))
    for place in (0, 4, 9):
        least = np.array([scores[min(place, len(scores) - 1)] for _, _, scores in whole])
        for (_, ids, scores), (_, some, values), low in zip(whole, index.search_all(asked, 10, least), least, strict=True):
            assert some.tolist() == ids[scores >= low].tolist() and values.tolist() == scores[scores >= low].tolist()
