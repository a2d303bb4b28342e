"""Operators 11 to 13 against brute force, on hard rows too."""

import os
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismframe.llm import dual_tree, simhash, whitening

SF = "/root/testdata/sf0.001"


# Operator 11.


def whole(v):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in v]


def by_hand(vectors, k=16):
    """n, S and the eigenvectors of numpy's own solver."""
    fit = sorted({tuple(whole(v)) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    e, u = np.linalg.eigh(v)
    return n, sums, v, e[::-1][:k], u[:, ::-1][:, :k]


def check_whitened(rows, vectors, k):
    n, sums, v, e, u = by_hand([x for x in vectors.values()], k)
    seen = Counter()
    signs = {}
    for r in rows:
        x = whole(vectors[r.vec_id])
        seen[r.vec_id] += 1
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        j = r.component - 1
        wanted = (np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) @ u[:, j]) / np.sqrt(e[j])
        if abs(wanted) > 1e-6:
            signs.setdefault(j, np.sign(wanted) == np.sign(r.whitened))
            wanted *= 1 if signs[j] else -1
            assert r.whitened == pytest.approx(wanted, rel=1e-6, abs=1e-7)
        assert r.explained == pytest.approx(e[j] / v.trace(), rel=1e-9)
        assert r.identity_error < 1e-9
    assert set(seen.values()) == {min(k, len(e))} and set(seen) == set(vectors)


def test_whitening_of_the_table(spark):
    found = whitening.op11_whiten(spark, SF).collect()
    held = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(found, {r.vec_id: r.embedding for r in held if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}, 16)


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(5)
    good = {i: (rng.normal(size=5) * [3, 2, 1, 0.5, 0]).tolist() for i in range(60)}  # one constant dimension
    rows = [(i, v, "x") for i, v in good.items()] + [(0, good[0], "y"), (90, None, ""), (91, [1.0, None, 1.0, 1.0, 1.0], ""), (92, [float("nan")] * 5, ""), (93, [float("inf")] + [0.0] * 4, ""), (94, [1.0, 2.0], ""), (95, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    found = whitening.whiten(df).collect()
    assert {r.component for r in found} == {1, 2, 3, 4} and Counter(r.vec_id for r in found)[0] == 8  # a repeated row, rank four
    once, rest = [], set()
    for r in found:
        if (r.vec_id, r.component) not in rest:
            rest.add((r.vec_id, r.component))
            once.append(r)
    check_whitened(once, good, 4)
    null = df.where("vec_id < 60").withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))
    assert sum(r.vec_id is None for r in whitening.whiten(null).collect()) == 8
    assert whitening.whiten(df.where("vec_id in (0, 90)")).collect() == []  # equal vectors have no spread
    assert whitening.whiten(df.where("vec_id > 1000")).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) in (3, 6)


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12)) @ np.diag(10.0 ** -np.arange(12)) @ rng.normal(size=(12, 12))
    v = a.T @ a
    factor = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, atol=1e-12 * v.max())
    order = [int(np.flatnonzero(np.abs(np.delete(factor, range(j), 1)).sum(1) > 0)[0]) for j in range(factor.shape[1])]
    assert len(order) == factor.shape[1]
    e, u = whitening.one_sided_jacobi(factor)
    assert np.allclose(u @ u.T, np.eye(len(e)), atol=1e-12)
    assert np.allclose(e[:6], np.linalg.eigvalsh(v)[::-1][:6], rtol=1e-8)


# Operator 12.


def ranked(docs, items, k=20):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall((text or "").translate(lower)))
        found = []
        for i, c in terms:
            m = 75 + (25 * sum(c.values()) * n) // length
            score = sum(q * int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = sorted(map(tuple, dual_tree.op12_dual_tree_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()))
    assert found == sorted(con.sql(f"select item_id, rank, doc_id, score from ({dual_tree.OP12_SQL})").fetchall()) and found


@pytest.mark.parametrize("seed", range(3))
def test_search_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "x_y", "ÀB"]
    odds = np.append(1 / np.arange(1, 301) ** 0.9, [0.1] * 3)
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(900)]
    docs += [(2000 + i, docs[5][1]) for i in range(60)] + [(7, docs[5][1]), (3000, None), (3001, ""), (3002, "..."), (None, docs[5][1]), (3003, "W1 " * 30_000)]
    items = [(i, text(rng.integers(1, 12))) for i in range(40)] + [(100, docs[5][1]), (101, None), (102, "?"), (103, "unseen"), (104, docs[5][1] + " w1 w1")]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    q = spark.createDataFrame(items + items[:3], "item_id long, text string")
    found = dual_tree.search(d, q, shard_docs=300)
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, items)


def test_pairs_of_nodes_are_pruned():
    rng = np.random.default_rng(0)
    topics = [rng.choice(4000, 60, replace=False).astype(np.uint64) for _ in range(64)]
    docs = [np.unique(rng.choice(topics[i // 64], 30)) for i in range(4096)]
    lengths = np.array([len(d) for d in docs])
    tree = dual_tree.DocumentTree(np.arange(4096), lengths, lengths, np.concatenate(docs), np.ones(lengths.sum(), np.int64), 4096, int(lengths.sum()))
    items = [(np.unique(rng.choice(topics[i], 10)), None) for i in range(64)]
    search = dual_tree.DualSearch(tree, [(t, np.full(len(t), 1000)) for t, _ in items], 20)
    search.run()
    assert search.pairs < 0.15 * 64 * 4096  # most pairs are never scored
    for (t, _), best in zip(items, search.best, strict=True):
        every = sorted((1000 * int(tree.impact[b:e][np.isin(tree.terms[tree.term[b:e]], t)].sum()) for b, e in zip(tree.begins, tree.ends, strict=True)), reverse=True)
        assert best.tolist() == [s for s in every[:20] if s > 0]


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dual_tree.search(none, items).collect() == []
    assert dual_tree.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.where("item_id > 1")).collect() == []


# Operator 13.


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(docs, radius=4):
    prints = [print_of(t) for _, t in docs]
    return components(prints, [i for i, _ in docs], radius), prints


def components(prints, ids, radius):
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [least.get(root(a)) for a in range(len(ids))]


def test_simhash_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    classes, prints = linked(docs)
    wanted = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, classes, strict=True))
    assert sorted(map(tuple, simhash.op13_simhash(spark, SF).collect())) == wanted


def test_simhash_of_hard_rows(spark):
    docs = [(5, None), (3, ""), (9, " \t\n"), (None, "One two"), (8, "one  TWO"), (8, "one two"), (2, "a b c d e"), (7, "É é ß"), (11, "word " * 50_000), (None, "alone here now and then")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, component int")
    classes, prints = linked(docs)
    wanted = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, classes, strict=True)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == wanted
    assert simhash.near_duplicates(df.where("doc_id > 1000")).collect() == []


@pytest.mark.parametrize("radius", [1, 4])
def test_masks_cover_every_pair(radius):
    rng = np.random.default_rng(radius)
    masks = simhash.covering_masks(0, radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        places = rng.choice(64, radius, replace=False)
        apart = np.uint64(sum(1 << int(p) for p in places))
        assert (masks & apart == 0).any()
    if radius == 4:
        held = np.bitwise_count(masks)
        assert held.min() >= 31 and held.max() <= 35
        taken = int(masks[0])
        deeper = simhash.covering_masks(taken, 4)
        assert (deeper & masks[0] == masks[0]).all() and np.bitwise_count(deeper).min() > np.bitwise_count(masks[0])


@pytest.mark.parametrize("most", [64, 4096])
def test_links_of_dense_prints(spark, most):
    """A dense heap of alike prints: buckets are split again and again, and no link is lost."""
    rng = np.random.default_rng(2)
    heap = {int(rng.integers(2**63)) for _ in range(40)}
    base = int(rng.integers(2**63))
    for _ in range(250):
        heap.add(base ^ sum(1 << int(p) for p in rng.choice(30, rng.integers(0, 9), replace=False)))
    for p in list(heap)[:40]:
        heap.add(p ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)))
    heap = sorted(heap)
    df = spark.createDataFrame([(p,) for p in heap], "fingerprint long")
    links = simhash.covering_links(df, 4, most).collect()
    assert all((r.a ^ r.b).bit_count() <= 4 for r in links)
    at = {p: i for i, p in enumerate(heap)}
    parent = list(range(len(heap)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in links:
        parent[root(at[r.a])] = root(at[r.b])
    mine = Counter(Counter(root(i) for i in range(len(heap))).values())
    theirs = Counter(Counter(components(heap, list(range(len(heap))), 4)).values())
    assert mine == theirs


def test_module_names():
    from prismframe.llm import queries

    assert {"op11_whiten", "op12_dual_tree_search", "op13_simhash"} <= set(queries.queries())
    assert os.path.isdir(SF)
