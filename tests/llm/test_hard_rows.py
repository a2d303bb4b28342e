"""Null ids, repeated rows, very long texts and clashing columns for searches, repeated passages and URLs."""

import math
from collections import Counter

import numpy as np

from prismframe.llm import bm25, substring_dedup, urls


def test_search_counts_repeated_rows_and_leaves_null_ids_out(spark):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(11)
    docs = [(i, " ".join(rng.choice(words, 12))) for i in range(40)]
    docs += [docs[3], docs[3], (None, docs[3][1]), (50, None), (51, ""), (52, "W1 w2 " * 30_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    asked = spark.createDataFrame([(1, docs[3][1], 2), (2, None, 2), (3, "w1 W2", 2), (None, "w1", 2)], "query_id long, text string, rank int")
    got = bm25.search(df, asked, k=6, shard_docs=16).orderBy("query_id", "rank").collect()
    counts = [(i, Counter((t or "").lower().split())) for i, t in docs if i is not None]
    n, mean = len(counts), sum(sum(c.values()) for _, c in counts) / len(counts)
    df_of = Counter(w for _, c in counts for w in c)
    for q, text in ((1, docs[3][1]), (3, "w1 w2")):
        scores = []
        for i, c in counts:
            size = sum(c.values())
            s = sum(m * math.log(1 + (n - df_of[w] + 0.5) / (df_of[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, m in Counter(text.split()).items() if c[w])
            if s:
                scores.append((-round(s, 9), i))
        assert [(-round(r["score"], 9), r["doc_id"]) for r in got if r["query_id"] == q] == sorted(scores)[:6]
    assert {r["query_id"] for r in got} == {1, 3}


def test_passages_of_repeated_rows_and_long_texts(spark):
    rng = np.random.default_rng(12)
    words = [f"v{i}" for i in range(3000)]
    say = lambda k: " ".join(rng.choice(words, k))
    passage = say(70)
    docs = [(1, f"{say(30)} {passage} {say(20)}"), (2, f"{say(5)} {passage}"), (3, say(90)), (3, say(90)), (None, passage), (4, None), (5, f"{say(20_000)} {passage} {say(20_000)}")]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs] + [(1, docs[0][1], 8)], "doc_id long, text string, start_word long")
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring_dedup.repeated_passages(df).collect()}
    for i, start in ((1, 30), (2, 5), (5, 20_000)):
        assert any(d == i and a <= start and e >= start + 70 for d, a, e in got)
    assert {d for d, _, _ in got} == {1, 2, 5}
    assert substring_dedup.repeated_passages(df.where("doc_id > 100")).collect() == []


def test_urls_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "http://a.org/x", 1), (1, "http://a.org/x", 1), (None, "http://b.com/de/y", 2), (2, None, 3), (3, "http://c.net/" + "q/" * 40_000, 4), (4, "://", 5)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host long")).collect()
    assert len(got) == len(rows)
    assert sorted(((r["page_id"] or 0), r["verdict"]) for r in got if r["page_id"] in (None, 1)) == [(0, "block"), (1, "allow"), (1, "allow")]
    long = next(r for r in got if r["page_id"] == 3)
    assert long["host"] == "c.net" and len(long["path"]) == 80_001


def test_passages_between_swapped_lines_are_like(spark):
    """Shingles around a passage that stand on its other side in the other text do not hide the passage."""
    rng = np.random.default_rng(21)
    some = lambda n: [f"{a}x{b}" for a, b in rng.integers(0, 10**6, (n, 2))]
    passage, one, two = some(55), some(12), some(12)
    texts = {1: some(40) + one + passage + two + some(40), 2: some(40) + two + passage + one + some(40)}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {1, 2} and all(a <= 52 and b >= 107 for a, b in got.values())


def test_classes_of_passages_are_all_that_links_reach(spark):
    rng = np.random.default_rng(22)
    some = lambda n: [f"{a}x{b}" for a, b in rng.integers(0, 10**6, (n, 2))]
    chain = some(130)
    # copies that differ by a word between copies that are equal; overlapping passages of one chain, each linked with the next
    texts = {4: chain[:60], 3: chain[:60], 2: chain[:55] + some(1) + chain[56:60], 1: chain[:55] + some(1) + chain[56:60]}
    texts |= {7: chain[:60], 6: chain[:100], 5: chain[35:130], 9: chain[75:130]}
    texts[2] = texts[1]
    other = some(60)
    texts |= {20: other, 21: other}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["class_doc_id"] for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {k: 20 if k >= 20 else 1 for k in texts}


def test_compared_contexts_cover_what_brute_force_does():
    """Small alphabets give repeated tokens, shifts and swaps: every pair of passages is counted as a multiset."""
    from collections import Counter

    rng = np.random.default_rng(23)
    cover = substring_dedup._Cover(8, 0.8)
    for k in range(300):
        size = int(rng.choice([3, 6, 200]))
        x = rng.integers(0, size, 15).astype(np.uint32)
        y = np.roll(x, int(rng.integers(-2, 3))).copy()
        y[rng.integers(0, 15, int(rng.integers(0, 3)))] = 999
        b, a, b2, a2 = (int(v) for v in rng.integers(3, 8, 4))
        want = [8, -8, 8, -8]
        for n, m in [(8, m) for m in range(8, 11)] + [(n, 8) for n in range(8, 11)]:
            for i in range(7 - b, 9 + a - n):
                for j in range(7 - b2, 9 + a2 - m):
                    both = sum((Counter(x[i : i + n].tolist()) & Counter(y[j : j + m].tolist())).values())
                    if 9 * both >= 4 * (n + m):
                        want = [min(want[0], i - 7), max(want[1], i + n - 8), min(want[2], j - 7), max(want[3], j + m - 8)]
        one = lambda v: np.array([v])
        got = cover.pairs(x[None], one(b), one(a), y[None], one(b2), one(a2))
        assert [int(v[0]) for v in got] == want


def test_leaders_of_a_large_group_find_what_all_pairs_do(spark, monkeypatch):
    """Near copies of a few sides around one pivot, in one group: leaders in turn against all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(24)
    side = lambda: rng.integers(1, 2**31, 45).astype(np.uint32)
    left, right = [side() for _ in range(4)], [side() for _ in range(4)]
    near = []
    for _ in range(120):
        one = np.concatenate([left[rng.integers(0, 4)] if rng.random() < 0.7 else side(), [0], right[rng.integers(0, 4)] if rng.random() < 0.7 else side()]).astype(np.uint32)
        for at in rng.integers(0, 90, int(rng.integers(0, 4))):
            one[at] = rng.integers(1, 2**31)
        near.append(one.tobytes())
    n = len(near)
    columns = [pa.array([64] * n), pa.array([0] * n), pa.array(range(n)), pa.array(np.arange(n) // 2), pa.array([100] * n, pa.int32()), pa.array([45] * n, pa.int32()), pa.array(near, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["value", "part", "like", "doc_id", "c", "after", "near"])

    def told(few, some):
        monkeypatch.setattr(substring_dedup, "FEW", few)
        monkeypatch.setattr(substring_dedup, "SOME", some)
        return [r for b in substring_dedup._verified(46, 0.8)([batch]) for r in b.to_pylist()]

    every, leaders, product = told(1000, 1000), told(2, 2), told(2, 1000)
    assert every == product and len(every) > 50
    assert every == leaders


def test_edited_copies_and_repeated_words_need_no_comparison_of_all_passages(monkeypatch):
    """Inserted, deleted and changed words keep the order of tokens, and runs of one word share the pivot only: both are told without
    comparing passages one by one, with the same result."""
    rng = np.random.default_rng(25)
    cover, place = substring_dedup._Cover(46, 0.8), np.arange(91)
    base, x, y = rng.integers(1, 2**31, 120).astype(np.uint32), [], []
    for _ in range(60):
        for side in (x, y):
            one = np.delete(base, rng.integers(0, 50, int(rng.integers(0, 4))))
            one = np.insert(one, rng.integers(0, 90, int(rng.integers(0, 4))), rng.integers(1, 2**31, 1))
            side.append(one[:91])
    for k in range(60):
        a, b = (rng.integers(1, 2**31, 91).astype(np.uint32) for _ in range(2))
        for one in (a, b):
            one[(place >= rng.integers(0, 46)) & (place <= rng.integers(45, 91))] = 7
        x, y = [*x, a], [*y, b]
    x, y = np.stack(x), np.stack(y)
    b, a, b2, a2 = rng.integers(20, 46, (4, len(x)))
    compared = np.zeros(1, int)
    slow = substring_dedup._Cover._one_way
    with monkeypatch.context() as m:
        m.setattr(substring_dedup._Cover, "_one_way", lambda self, same, *rest: compared.__iadd__(len(same)) is None or slow(self, same, *rest))
        got = np.stack(cover.pairs(x, b, a, y, b2, a2))
    assert compared[0] <= 12
    with monkeypatch.context() as m:
        m.setattr(substring_dedup._Cover, "_pivots", lambda self, x, *_: np.array([[46], [-46]] * 2) * np.ones(len(x), int), raising=False)
        want = np.stack(getattr(cover, "in_any_order", cover.pairs)(x, b, a, y, b2, a2))
    assert (got == want).all() and (got[0] <= got[1]).sum() > 40
