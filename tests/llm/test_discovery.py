"""Discovery of personal data in shared contexts, and spans of texts with many of them."""

import re
import time

import numpy as np
import pytest

from prismframe.llm import pii

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    fits = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text) if fits[k](m[0])]


def noise(rng, n):
    """Texts with numbers in other contexts, so that their shapes are cold."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    say = lambda k: " ".join(rng.choice(words, k))
    return [f"{say(5)} {rng.integers(10, 9999)} {say(4)} {rng.integers(1, 99)} {say(3)}" for _ in range(n)]


@pytest.mark.parametrize(
    ("seed", "held", "n"),
    [("call me at +1 504 555 {:04d} before noon", "call me at 504-555-{:04d} before noon", 10), ("call me at +1 504 555 {:04d} before noon", "call me at 504-555-{:04d} before noon", 30), ("please write to joe{:d}@mail.org today", "please write to joe{:d}@mail today", 10)],
)
def test_unseen_shapes_in_shared_contexts_are_found(spark, seed, held, n):
    rng = np.random.default_rng(n)
    kind = 3 if "call" in seed else 0
    texts = [seed.format(1000 + i) for i in range(100 - n)] + [held.format(3000 + i) for i in range(n)]
    texts += noise(rng, 300) + [f"we meet at {i} before noon" for i in range(1, 4)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {(r["doc_id"], texts[r["doc_id"]][x["s"] : x["e"]], x["k"]) for r in got for x in r["more"]}
    wanted = {(i, re.search(r"504-555-\d+|joe\d+@mail", texts[i])[0], kind) for i in range(100 - n, 100)}
    assert len(added & wanted) >= 0.9 * len(wanted) and len(added & wanted) >= 0.9 * len(added)


def test_no_discovery_without_shared_contexts(spark):
    rng = np.random.default_rng(1)
    texts = noise(rng, 400) + [t.replace(" 1", f" +1 504 555 {i:04d} 1", 1) for i, t in enumerate(noise(rng, 200))]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(len(r["more"]) for r in got) <= 2


def test_base_spans_and_digests_by_brute_force(spark):
    rng = np.random.default_rng(7)
    parts = ["a@b.co", "@", ".", "x@y", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (504) 555-2652", "+12", "é\U0001f600", " ", "\n", "0", "5500005555555559", "+", "-", "q"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(400)] + [None, ""]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in found.select("doc_id", pii._written(found["spans"]).alias("spans")).collect():
        assert r["spans"] == ",".join(base_spans(texts[r["doc_id"]] or "")), texts[r["doc_id"]]


def test_many_phrases_take_time_in_proportion(spark):
    took = []
    for n in (5_000, 40_000):
        text = " ".join(f"row {i} a{i}@x.org," for i in range(n))
        began = time.time()
        spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
        took.append(time.time() - began)
        emails = [text[x["s"] : x["e"]] for x in spans if x["k"] == 0]
        assert emails == [f"a{i}@x.org" for i in range(n)]
    assert took[1] < 40
