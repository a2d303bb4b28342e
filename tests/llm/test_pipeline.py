"""The pipeline: stages on hard rows and columns with clashing names, near duplicates and the whole run by brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline

CLASHING = ["score", "kept", "size", "_w", "_t", "_row", "rounds", "target", "taken", "h", "spans"]


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(8)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    base, other = some(100), some(100)
    near = base[:30] + ["x"] + base[31:70] + ["y"] + base[71:]
    for repeat in (False, True):
        rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (None, " ".join(base)), (4, ""), (5, None)]
        rows += [(3, " ".join(some(80))), (6, " ".join(near)), (6, " ".join(some(90))), (4, ""), (3, " ".join(other[:99]))] * repeat
        sets = [(k, t, {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}) for k, t in rows]
        want, left = [], sorted((s for s in sets if s[0] is not None), key=lambda s: (s[0], s[1] or ""))
        for k, t, s in left:  # the links of these rows are transitive
            linked = lambda o: (100 * len(s & o[2]) >= 80 * len(s | o[2])) if s and o[2] else not s and not o[2] and k == o[0]  # noqa: B023, E731
            if not any(linked(o) for o in want):
                want.append((k, t, s))
        want += [s for s in sets if s[0] is None]
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
        assert Counter((r[0], r[1]) for r in got) == Counter((k, t) for k, t, _ in want)


def test_stages_on_hard_rows_with_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**5, n))
    rows = [(k, some(int(rng.integers(20, 80))), "en", ("a", "b", None)[k % 3], 0, *range(len(CLASHING))) for k in range(40)]
    rows += [rows[0], (None, some(30), None, "a", None, *range(len(CLASHING))), (50, None, "en", "a", 0, *range(len(CLASHING))), (51, "", "en", "b", 0, *range(len(CLASHING)))]
    rows += [(52, "mail me@x.org " + some(20), "en", "b", 0, *range(len(CLASHING))), (53, some(30_000), "en", "a", 0, *range(len(CLASHING)))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, kinds).repartition(2).write.parquet(f"{tmp_path}/0")
    docs, seen = spark.read.parquet(f"{tmp_path}/0"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == len(corpus_pipeline.STAGES) - 1:
            packed = out.collect()
            break
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k + 1}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k + 1}")
        rows_out = docs.collect()
        assert all(tuple(r[c] for c in CLASHING) == tuple(range(len(CLASHING))) for r in rows_out), name
        seen.append(rows_out)
    ids = [Counter(r["doc_id"] for r in s) for s in seen]
    assert ids[0][50] == ids[0][51] == 0 and ids[0][0] == 2 and ids[0][53] == 1 and ids[0][None] == 1
    assert ids[1] == Counter(dict.fromkeys(ids[0], 1)) and ids[2] == ids[1]
    assert [r["text"].split()[:2] for r in seen[2] if r["doc_id"] == 52] == [["mail", "[EMAIL]"]]
    taken = Counter()
    for r in seen[3]:
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(r["text"].split())
    sizes = {r["doc_id"]: len(r["text"].split()) for r in seen[2]}
    assert all(n <= 2 * sizes[k] for k, n in taken.items()) and set(taken) <= set(sizes)
    assert Counter(p["doc_id"] for p in packed if p["piece"] == 0) == Counter(r["doc_id"] for r in seen[3])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.schema(before.schema).parquet(_empty(spark, before, tmp_path)), str(tmp_path)).count() == 0


def _targets(sizes):
    """What each source should give: shares of 150 % of all words by the weights 3, 1, 2, none above twice its own words."""
    weights = {source: (3, 1, 2)[k % 3] for k, source in enumerate(sorted(sizes))}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        unit = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * unit > 2 * sizes[s]}
        if not full:
            return out | {s: weights[s] * unit for s in free}
        out |= {s: 2 * sizes[s] for s in full}
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    return out


def test_run_by_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    rows = [(k, " ".join(some(int(rng.integers(30, 70)))), "ab"[k % 3 == 0]) for k in range(90)]
    long = some(120)
    near = [*long[:50], "x", *long[51:]]
    rows += [(100, " ".join(long), "c"), (101, " ".join(near), "c"), (102, " ".join(long), "a"), (103, " ".join(some(60)), "c"), (104, " ".join(some(4)), "a"), (105, " ".join(some(6) * 6), "b")]
    rows += [(106, "write to joe.doe@mail.example.org or 10.1.2.3 " + " ".join(some(40)), "c"), (107, None, "a"), (108, "", "b")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    # no document is labelled bad, so no threshold can tell any apart and the base rules decide
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {i: (t, s) for i, t, s in rows if i not in (101, 102, 104, 105, 107, 108)}  # copies and failing documents are gone
    left[106] = (left[106][0].replace("joe.doe@mail.example.org", "[EMAIL]").replace("10.1.2.3", "[IP]"), "c")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    code = lambda w: np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    runs = defaultdict(dict)  # what a run of a document's words looks like when packed
    for i, (t, _) in left.items():
        ids = [code(w) for w in t.split()]
        for a in range(len(ids)):
            for b in range(a + 1, len(ids) + 1):
                coded = b"".join(ids[a:b]) + b"\0\0\0\0"
                runs[i][len(coded) // 4, zlib.crc32(coded)] = b - a
    taken, sources = Counter(), Counter()
    for r in packed:
        assert r["piece"] == 0 and r["start"] == 0
        taken[r["doc_id"]] += runs[r["doc_id"]][r["length"], r["ids_crc32"]]  # fails for any other text
    for i, n in taken.items():
        assert n <= 2 * len(left[i][0].split())
        sources[left[i][1]] += n
    sizes = Counter()
    for t, s in left.values():
        sizes[s] += len(t.split())
    for s, want in _targets(sizes).items():
        assert abs(sources[s] - want) <= 16, (s, sources[s], want)
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in packed) / 2048) + 1


def _empty(spark, like, folder):
    path = f"{folder}/empty"
    spark.createDataFrame([], like.schema).write.mode("overwrite").parquet(path)
    return path
