"""Components and link counts of near copies against all pairs, also where lists and components are parted."""

import numpy as np
import pytest

from prismframe.llm import jaccard_join


def near_copies(n_copies: int, n_words: int, most: int) -> list[tuple]:
    rng = np.random.default_rng(11)
    word = lambda: "w" + str(rng.integers(100_000))
    base = [word() for _ in range(n_words)]
    rows = []
    for k in range(n_copies):
        copy = list(base)
        for _ in range(int(rng.integers(most))):
            at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
            copy[at : at + (kind > 0)] = [word()] * (kind < 2)
        rows.append((k + 1, " ".join(copy)))
    rows += [(k + 1000, " ".join(word() for _ in range(30))) for k in range(20)]
    return [*rows, (2000, rows[3][1]), (None, rows[0][1]), (2001, None), (2002, "")]


@pytest.mark.parametrize(("width", "threshold", "parts"), [(4, 0.85, False), (5, 0.8, True)])
def test_components_and_links_by_all_pairs(spark, monkeypatch, width, threshold, parts):
    if parts:
        monkeypatch.setattr(jaccard_join, "LIST_ROWS", 7)
        monkeypatch.setattr(jaccard_join, "CELL_SETS", 5)
    rows = near_copies(70, 90, 7)
    sets = {}
    for k, text in rows:
        words = (text or "").split()
        if k is not None:
            sets[k] = frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    linked = lambda a, b: a and b and len(a & b) >= threshold * len(a | b) - 1e-9
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            root[a] = min(root[b] for b in sets if a == b or linked(sets[a], sets[b]))
    different = set(sets.values())
    want = {k: (len(s), root[k], sum(o != s and bool(linked(s, o)) for o in different)) for k, s in sets.items()}
    assert max(n for _, _, n in want.values()) > 5 and len(set(root.values())) > 24
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs, width, threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_parities_never_differ_in_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(base, int(k))) for k in rng.integers(1, 3000, 60)]
    bits = [jaccard_join._parities(one) for one in sets]
    every = np.ones((len(sets), len(sets)), bool)
    apart = jaccard_join._apart(bits, bits, every)
    real = np.array([[len(np.setxor1d(a, b)) for b in sets] for a in sets])
    assert (apart <= real).all() and (apart % 2 == real % 2).all() and (apart == apart.T).all()
    # sets without a common element are told apart at 0.8
    a, b = np.arange(2000).astype(np.uint64), np.arange(5000, 7100).astype(np.uint64)
    assert jaccard_join._apart([jaccard_join._parities(a)], [jaccard_join._parities(b)], np.ones((1, 1), bool))[0, 0] * 9 > 4100


def test_prefixes_leave_the_disk_before_sets_are_fetched(spark, monkeypatch):
    """What is kept beside the whole sets is small: no table with prefixes exists any more when the sets are written."""
    import os

    real, written, kept = jaccard_join.materialize, [], []

    def seen(df, name):
        out = real(df, name)
        written.append(out)
        if name == "sets":
            kept.append([t for t in written if "prefix" in t.columns and os.path.exists(t.materialized_at)])
        return out

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    rows = near_copies(12, 60, 6) + [(1000, "a b c d e f g"), (1001, "a b c d e f g"), (None, "a b c d e f g"), (1002, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (1000, 1001)} == {1000}
    assert kept and not any(kept)


def test_copies_are_told_by_a_bit_map(spark, monkeypatch):
    """What is sent to tell copies from the first ones holds one row for 64 documents, not one for each copy."""
    real, written = jaccard_join.materialize, {}

    def seen(df, name):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    rows = near_copies(20, 40, 4)
    rows += [(k, rows[5][1]) for k in range(3000, 3640)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5, 0.8, count_links=False).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id and r.doc_id >= 3000} == {next(r.component_id for r in got if r.doc_id == rows[5][0])}
    assert 0 < written["others"].count() <= 15
