"""The training-data operators against brute force, round trips and held-out accuracy, with hard rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismframe.llm import bm25, chat, html_text, jaccard_join, mixing, packing, pii, quality, substring_dedup, urls

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, rank int"


def documents():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = some(120), some(60)
    texts = {1: base, 2: base, 3: base.replace(base.split()[60], "other"), 4: None, 5: "", 6: " \n\t ", 7: "one", 8: "One", 9: some(5000)}
    texts |= {10: some(80) + " " + passage + " " + some(50), 11: some(30) + "\n" + passage, 12: some(200), 13: "a b c d e f g a b c d e f g a b c d e f g", 14: "mail me@x.org, +1 (504) 555-2652 or 10.0.0.255"}
    texts |= {k: some(int(rng.integers(1, 300))) for k in range(20, 60)}
    texts[100], texts[200] = texts[12], passage
    return [(k, t, "en", ("a", "b", None)[k % 3], len(t or ""), k) for k, t in texts.items()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def low(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_jaccard_components(docs, empty):
    sets = {}
    for k, text, *_ in documents():
        w = low(text)
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {k: (len(s), root(k)) for k, s in sets.items()}
    assert root(3) == 1 and root(8) == 7 and root(100) == 12
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_packing(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = packing.pack(docs, capacity=256).toPandas()
    want = {}
    for k, text, *_ in documents():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4")
            want[k, piece] = at, len(part), zlib.crc32(part.tobytes())
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows["offset"]) == [0, *np.cumsum(rows["length"])[:-1]] and rows["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 1
    assert packing.pack(empty).count() == 0


def test_two_fit_beats_plain_greedy():
    bins = packing.best_two_fit(np.array([6, 3, 4, 2]), 10)
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3] and len(bins) == 2


def test_odd_words_tokenise_as_whole_texts():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ["It's Ünïcode and ２ digits!!", "<|endoftext|>x y<|startoftext|>", "İstanbul é́ \U0001f600!! a.b,c...", "don't 'S can'T $$$ £5"]
    got = packing._WordTokenizer("word_bpe_49k.json").encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_mixing(docs, empty):
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    rows = mixing.mix(sized).toPandas()
    again = mixing.mix(sized.repartition(5)).toPandas()
    assert rows.set_index("doc_id")["taken"].to_dict() == again.set_index("doc_id")["taken"].to_dict()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    sizes = rows.groupby(rows["source"].fillna("~"))["size"].sum()
    assert math.isclose(rows.groupby(rows["source"].fillna("~"))["target"].first().sum(), 1.5 * sizes.sum())
    for _, group in rows.groupby(rows["source"].fillna("~")):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 2
    assert mixing.mix(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0


def test_sainte_lague_gives_highest_quotients(spark):
    weights = {k: w for k, w in enumerate([53, 24, 23, 7, 1, 0])}
    df = spark.createDataFrame([("g", k, float(w), 21) for k, w in weights.items()], "g string, k int, w double, seats long")
    got = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "k", "w", "seats").collect()}
    best = sorted(((-w / (2 * s + 1), k) for k, w in weights.items() for s in range(30) if w))[:21]
    assert got == {k: Counter(k for _, k in best)[k] for k in weights}


def test_quality_base(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (12, 1, 0), (13, 0, 0), (None, 1, 0), (20, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    for k, text, *_ in documents():
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_repeat_words"], got[k]["base_failed"]) == (len(w), sum(map(len, w)), len(covered), failed)
        assert not (failed and got[k]["kept"])
    assert quality.judge(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_pii_base_and_discovery(docs, empty, spark):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    text = dict((d[0], d[1]) for d in documents())[14]
    assert [(x["k"], text[x["s"] : x["e"]]) for x in got[14]["spans"]] == [(0, "me@x.org"), (1, "10.0.0.255"), (3, "+1 (504) 555-2652")]
    shown = spark.createDataFrame([(i, f"host address {10 + i}.0.0.1 is up") for i in range(40)] + [(99, "host address 10.0.0.999 is up"), (100, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(shown).collect()}
    assert [(x["k"], x["s"], x["e"]) for x in found[99]["more"]] == [(1, 13, 23)]
    assert found[100]["spans"] == [] and pii.find_pii(empty).count() == 0
    long = "x" * 90  # neighbouring words count whole, however long, over line ends and other phrases
    shown = [(i, f"w {long}a\n{long}b {10 + i}.0.0.1 {long}c") for i in range(40)] + [(99, f"q\t{long}a  {long}b 10.0.0.999"), (98, f"12  34\n7\t{long}e x9 ")]
    contexts = {r["doc_id"]: [(p["l2"], p["l1"], p["r1"]) for p in r["phrases"]] for r in pii._scan(spark.createDataFrame(shown, "doc_id long, text string")).collect()}
    assert contexts[5] == [(f"{long}a", f"{long}b", f"{long}c")] and contexts[99] == [(f"{long}a", f"{long}b", "")]
    assert contexts[98] == [("", "", "34"), ("", "12", "7"), ("12", "34", f"{long}e"), ("7", f"{long}e", "")]
    found = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(shown, "doc_id long, text string")).collect()}
    assert [shown[40][1][x["s"] : x["e"]] for x in found[99]["more"]] == ["10.0.0.999"]
    line = spark.createDataFrame([("a me@x.org b",)], "t string").select(pii.redact(F.col("t"), F.expr("array(named_struct('k', 0, 's', 2, 'e', 10))")).alias("t")).first()["t"]
    assert line == "a [EMAIL] b"


def test_chat_round_trip_and_layouts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\<s>b", None, "<\\s>", "é\U0001f600\n[/INST"]
    rows = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t, "x") for i, t in enumerate(texts)] + [(None, None, None, "z", "x")], "conv_id long, turn long, role string, text string, extra string")
    out = chat.format_chats(chat.records_of_rows(rows)).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    one = next(r for r in out if r["conv_id"] == 1)
    assert [(t["role"], t["text"]) for t in one["back"]] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(texts)]
    assert one["formatted"].count("</s>") == len(texts)
    records = ['{"prompt":"p","completion":"c"}', '{"messages":[{"role":"human","content":"q"},{"role":"gpt","content":"r"}]}', '{"instruction":"i","input":"","output":"o"}', '{"data":{"question":"q","answer":"a"}}', '{"odd":1}']
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r["layout"] for r in got] == ["prompt-completion", "messages", "instruction-input", "nested-data", None]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "q"), ("assistant", "r")]


def test_urls(spark):
    rows = [(1, "http://A.example.ORG/es/x?y"), (2, "https://b.org"), (3, "x.com/de/1"), (4, None), (5, "http://q.com/de/"), (6, "ftp://m.example.org/en/12#f"), (7, "http://notorg/fr/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(1, 8)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("b.org", "", None), ("", "", None), ("", "", None), ("q.com", "/de/", "com/de/"), ("m.example.org", "/en/12", "example.org/en/1"), ("notorg", "/fr/", None),
    ]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}


def test_url_trees_on_held_out_urls(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    good = lambda: f"https://www.{word(6)}.net/{word(5)}/{word(8)}"
    bad = lambda: f"http://{word(4)}-{rng.integers(10**8)}.biz/{word(3)}?{'&'.join(f'{word(2)}={rng.integers(10**6)}' for _ in range(5))}"
    rows = [(k, bad() if k % 2 else good(), float(k % 2)) for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked double")
    features = urls.lexical(pages.withColumns(urls.split_url(F.col("url"))))
    model = urls.fit(features.where("page_id < 300"))
    got = model.block_probability(features.where("page_id >= 300")).select("blocked", "p_block").collect()
    assert model.trees is not None and len(got) == 300
    assert np.mean([(r["p_block"] >= 0.5) == (r["blocked"] == 1) for r in got]) > 0.97
    # rules of both kinds label URLs for the trees; columns of any name are carried
    rules = (urls.Rule("allow", "net", "/"), urls.Rule("block", "a.biz", "/"))
    ruled = [(k, bad().replace(".biz", ".a.biz") if k % 2 else good(), k, "x", 1) for k in range(200)] + [(1000, bad(), 7, "x", 1), (1001, None, 8, "x", 1)]
    own = spark.createDataFrame(ruled, "page_id long, url string, depth long, host string, _features int")
    judged = urls.judge(own, rules)
    assert judged.columns == ["page_id", "url", "depth", "_features", "host", "path", "rule", "verdict", "p_block"]
    judged = {r["page_id"]: r for r in judged.collect()}
    assert judged[1000]["verdict"] == "block" and judged[1000]["rule"] is None and judged[1000]["depth"] == 7
    assert judged[1001]["host"] == "" and judged[0]["rule"] == "net/" and len(judged) == 202
    assert urls.judge(own.limit(0), rules).count() == 0


def test_block_labeller_on_unseen_layouts():
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(1500)]
    labeller = html_text.train_labeller(vocabulary)
    rng, right, n = np.random.default_rng(11), 0, 0
    for _ in range(150):
        found = html_text.blocks_of(html_text.made_page(rng, vocabulary))
        truth = np.array(["\x02" in t for _, t, _ in found])
        p = labeller.probabilities([html_text.vectors([(a, t.replace("\x02", "").strip() or "x", c) for a, t, c in found])])[0]
        right, n = right + (truth == (p >= 0.5)).sum(), n + len(truth)
    assert right / n > 0.98


def test_blocks():
    found = html_text.blocks_of("<p>a&amp;b <b>c</b><br>d<p>e<script>x</script><ul><li>f<li>g</ul><!-- no -->")
    assert [t for _, t, _ in found] == ["a&b c d", "e", "f", "g"]
    assert html_text.blocks_of("") == []


def test_repeated_passages(docs, empty):
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    seen = defaultdict(set)
    for k, text, *_ in documents():
        w = low(text)
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    want = defaultdict(set)
    for k, text, *_ in documents():
        w = low(text)
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                want[k].update(range(i, i + 50))
    assert set(want) <= set(got) and set(got) - set(want) <= {3}
    assert all(len(want[k] - got[k]) <= 0.1 * len(want[k]) for k in want)
    assert substring_dedup.repeated_passages(empty).count() == 0


def passage_words(texts, width=46, longest=57):
    """Words in passages of which one of the pair has 50 words: shingle multisets, every pair of places."""
    grams = {k: [tuple(low(t)[i : i + 5]) for i in range(len(low(t)) - 4)] for k, t in texts.items()}
    out = defaultdict(set)
    for a, b in ((a, b) for a in grams for b in grams if a != b):
        for i in range(len(grams[a]) - width + 1):
            mine = Counter(grams[a][i : i + width])
            for n in range(width, longest + 1):
                for j in range(len(grams[b]) - n + 1):
                    both = sum((mine & Counter(grams[b][j : j + n])).values())
                    if 9 * both >= 4 * (width + n):
                        out[a].update(range(i, i + width + 4))
                        out[b].update(range(j, j + n + 4))
    return out


def covered(spark, texts, **options):
    got = defaultdict(set)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in substring_dedup.repeated_passages(rows, **options).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return got


def test_repeated_passages_with_inserted_and_deleted_words(spark):
    rng = np.random.default_rng(5)
    some = lambda n: [f"{a}{b}" for a, b in rng.integers(0, 10**6, (n, 2))]
    base, twice = some(60), some(12)
    texts = {1: base, 2: base[:30] + some(1) + base[30:], 3: base[:29] + base[30:], 4: some(20) + base[:31] + some(2) + base[31:] + some(10), 5: some(60)}
    texts |= {6: twice * 5, 7: twice * 2 + some(1) + twice * 3}
    texts = {k: " ".join(t) for k, t in texts.items()}
    got, want = covered(spark, texts, hashes=16), passage_words(texts)
    assert set(want) == {1, 2, 3, 4, 6, 7} and got == want
    # a copy with an insertion every 40 words is covered whole
    long = some(200)
    texts = {1: " ".join(long), 2: " ".join(w for k in range(0, 200, 40) for w in long[k : k + 40] + some(1))}
    got = covered(spark, texts, hashes=16)
    assert got[1] == set(range(200)) and set(range(204)) <= got[2]


def test_members_that_match_in_part_are_compared_with_each_other(spark):
    rng = np.random.default_rng(6)
    some = lambda n: [f"{a}{b}" for a, b in rng.integers(0, 10**6, (n, 2))]
    left, right = some(60), some(60)
    middle = some(30)
    # 2 shares its left and middle with 1, its middle and right with 3
    texts = {1: left + middle + some(60), 2: left + middle + right, 3: some(60) + middle + right}
    texts |= {10 + k: some(3 * k) + left[:25] + left[:25] + left[20:] for k in range(3)}
    texts = {k: " ".join(t) for k, t in texts.items()}
    got = covered(spark, texts, hashes=16)
    exact = defaultdict(set)
    for k, text in texts.items():
        w = low(text)
        for i in range(len(w) - 49):
            if any(o != k and " ".join(w[i : i + 50]) in other for o, other in texts.items()):
                exact[k].update(range(i, i + 50))
    assert all(exact[k] <= got[k] for k in texts)


def test_a_group_loses_no_match_to_its_leader():
    rng = np.random.default_rng(7)
    side = lambda: rng.integers(0, 2**32, 45, dtype=np.uint64).astype(np.uint32)
    left, right, pivot = side(), side(), np.uint32([1])
    near = [np.concatenate(x).tobytes() for x in ((left, pivot, side()), (left, pivot, right), (side(), pivot, right))]
    columns = [pa.array([64] * 3), pa.array([0] * 3), pa.array([7, 8, 9]), pa.array([1, 2, 3]), pa.array([100] * 3, pa.int32()), pa.array([45] * 3, pa.int32()), pa.array(near, pa.binary())]
    got = defaultdict(list)
    for batch in substring_dedup._verified(46, 0.8)([pa.RecordBatch.from_arrays(columns, ["value", "part", "like", "doc_id", "c", "after", "near"])]):
        for r in batch.to_pylist():
            got[r["doc_id"]].append((r["first"], r["last"]))
    assert max(b for _, b in got[2]) == 145 and max(b for _, b in got[3]) == 145 and min(a for a, _ in got[1]) == 55


def test_no_word_of_an_exact_repeat_is_lost(docs):
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    words, seen = {k: low(t) for k, t, *_ in documents()}, defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    assert all(set(range(i, i + 50)) <= got[k] for k, w in words.items() for i in range(len(w) - 49) if len(seen[tuple(w[i : i + 50])]) > 1)


def test_pivots_of_repeated_tokens_do_not_depend_on_the_place():
    passage = np.tile(np.arange(1, 8, dtype=np.uint64), 20)
    for shift in (1, 37, 63, 64):
        tokens = np.concatenate([np.arange(1000, 1000 + shift, dtype=np.uint64), passage])
        ends = np.array([len(tokens)])
        _, _, c, _, _ = substring_dedup.compact_windows(tokens, np.array([shift]), ends, 46, 1)
        _, _, c0, _, _ = substring_dedup.compact_windows(passage, np.array([0]), np.array([len(passage)]), 46, 1)
        assert (c - shift).tolist() == c0.tolist()


def test_bm25(docs, empty):
    counts = {k: Counter(low(t)) for k, t, *_ in documents()}
    length = {k: sum(c.values()) for k, c in counts.items()}
    mean = sum(length.values()) / len(length)
    df = Counter(w for c in counts.values() for w in c)
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = defaultdict(list)
    for r in bm25.search(docs, queries, k=5, shard_docs=16, group_terms=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    for q in (100, 200):
        scores = {}
        for k, c in counts.items():
            s = sum(m * math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[k] / mean)) for w, m in counts[q].items() if c[w])
            if s:
                scores[k] = s
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == [(k, round(s, 6)) for k, s in best]
    assert bm25.search(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_bm25_prunes_exactly():
    rng = np.random.default_rng(5)
    bags = [np.unique(rng.zipf(1.3, int(rng.integers(1, 200))) % 5000, return_counts=True) for _ in range(1500)]
    bags += bags[:200]
    ids, sizes = rng.permutation(len(bags)), np.array([c.sum() for _, c in bags])
    lengths, terms = np.array([len(t) for t, _ in bags]), np.concatenate([t for t, _ in bags]).astype(np.uint64)
    index = bm25.ShardIndex(ids, sizes, lengths, terms, np.concatenate([c for _, c in bags]), float(sizes.mean()))
    df = Counter(terms.tolist())
    for q in range(0, 300, 5):
        own, counts = bags[q]
        own, weights = own.astype(np.uint64), counts * np.log(1 + len(bags) / np.array([df[t] for t in own.tolist()]))
        weight = dict(zip(own.tolist(), weights.tolist(), strict=True))
        scores = {}
        for i, n, (t, c) in zip(ids.tolist(), sizes.tolist(), bags, strict=True):
            s = sum(weight[x] * m * 2.2 / (m + 1.2 * (0.25 + 0.75 * n / sizes.mean())) for x, m in zip(t.tolist(), c.tolist(), strict=True) if x in weight)
            if s:
                scores[i] = round(s, 9)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
        found, values = index.search(own, weights, 10)
        assert list(zip(found.tolist(), np.round(values, 9).tolist(), strict=True)) == best
    nothing = bm25.ShardIndex(ids[:0], sizes[:0], lengths[:0], terms[:0], terms[:0], 1.0)
    assert len(nothing.search(terms[:3], np.ones(3), 10)[0]) == 0


def test_digest_of_no_spans(docs):
    assert hashlib.sha256(b"").hexdigest() == docs.select(F.sha2(pii._written(F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")), 256)).first()[0]


def test_recall_of_edited_passages_with_the_default_hashes(spark):
    rng = np.random.default_rng(12)
    some = lambda n: [f"{a}{b}" for a, b in rng.integers(0, 10**6, (n, 2))]
    edits = {"insertion": lambda w, k: w[:k] + some(1) + w[k:], "deletion": lambda w, k: w[:k] + w[k + 1 :], "substitution": lambda w, k: w[:k] + some(1) + w[k + 1 :], "none": lambda w, k: w}
    texts, pairs = {}, {}
    for kind, edit in edits.items():
        for n in range(40):
            passage = some(60)
            one, other = len(texts), len(texts) + 1
            texts[one] = " ".join(some(int(rng.integers(5, 80))) + passage + some(20))
            texts[other] = " ".join(some(int(rng.integers(5, 80))) + edit(passage, int(rng.integers(20, 40))) + some(20))
            pairs.setdefault(kind, []).append((one, other))
    texts |= {1000 + k: " ".join(some(120)) for k in range(50)}
    found = set(covered(spark, texts))
    assert not any(k >= 1000 for k in found)
    recall = {kind: np.mean([a in found and b in found for a, b in some_pairs]) for kind, some_pairs in pairs.items()}
    assert recall["none"] == 1 and min(recall.values()) >= 0.9, recall
