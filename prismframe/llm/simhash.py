"""Operator 13: near-duplicates by SimHash with covering locality-sensitive hashing.

A text's words (lower-cased A-Z) are joined by one space in runs of ``width``; each run's XXH64 votes on 64 bits, and a
bit of the fingerprint is 1 if it is set in more than half of the hashes, repeats included.  Fewer words are one run,
no words give fingerprint zero.

Fingerprints within ``radius`` bits are found without loss (Pagh, "Locality-sensitive Hashing without False Negatives"):
place j of the bits gets a vector m(j) of radius + 1 bits, and for each nonzero v the mask of the places with odd <m(j), v> is
a table.  Two fingerprints that differ in at most ``radius`` places leave a v orthogonal to all of these places' vectors, and agree
on its mask.  The vectors are the powers of a generator, so each mask holds half of any long run of places.

Exact copies share a fingerprint, which goes through the tables once.  A bucket of at most ``MOST`` fingerprints is compared in memory and
gives a spanning forest of its links, never all pairs.  The members of a larger one differ in the mask's other places only
and go through the tables of those places, and so on: at every step about half the free places are left, and distinct
fingerprints with 12 free places or fewer are at most ``MOST``, so no bucket is skipped and no task holds a larger one.
Links go to connected components on Spark.

Null texts have no words.  Null ids are kept; a component of null ids only has a null component_id.  Repeated rows
give repeated results, an empty table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import materialize, rows_of, table
from prismframe.llm.components import connected_components

SEED = 42
MOST = 4096
#: Primitive polynomials over GF(2) by degree, with the leading term (fixed values).
PRIMITIVE = {1: 0b11, 2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10000011, 8: 0b100011101}


def text_fingerprint(text: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined, width = b" ".join(found), min(width, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    spans = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - width + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            prints = np.fromiter((text_fingerprint(t, width) for _, t in rows), np.uint64, len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


@lru_cache(maxsize=1 << 16)
def covering_masks(taken: int, radius: int) -> np.ndarray:
    """The tables' masks over the places that ``taken`` leaves free, each joined with ``taken``."""
    vectors, s = [], 1
    while not vectors or s != 1:
        vectors.append(s)
        s = s << 1 ^ (PRIMITIVE[radius + 1] if s >> radius else 0)
    free = [p for p in range(64) if not taken >> p & 1]
    masks = [taken | sum(1 << p for j, p in enumerate(free) if (vectors[j % len(vectors)] & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]
    return np.array(masks, np.uint64)


def spanning_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within the radius that join just those of the distinct fingerprints which links join."""
    heads, tails, left = [], [], prints
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= radius
            hit = near.any(0)
            if hit.any():
                heads.append(some[near[:, hit].argmax(0)])
                tails.append(left[hit])
                front, left = np.append(front, left[hit]), left[~hit]
    none = prints[:0]
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def _expand(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, prints = (batch[c].to_numpy().view(np.uint64) for c in ("mask", "a"))
            for mask in np.unique(taken).tolist():
                own, masks = prints[taken == np.uint64(mask)], covering_masks(mask, radius)
                for at in range(0, len(own), 1 << 13):
                    some = own[at : at + (1 << 13)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(masks, len(some)).view(np.int64)), pa.array(np.tile(some, len(masks)).view(np.int64))], ["mask", "a"])

    return run


def _meet(radius: int, most: int):
    """Sorted (mask, a) -> (null, a, b) for links and (mask, a, null) for members of buckets that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.uint64)
        large: tuple[int, int] | None = None

        def links(heads: list[np.ndarray], tails: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["mask", "a", "b"])

        def members(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1].view(np.int64)), pa.nulls(rows.shape[1], pa.int64())], ["mask", "a", "b"])

        def settle(rows: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Complete buckets."""
            mask, prints = rows
            sizes = ends - begins
            two = begins[sizes == 2]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
            heads, tails = [prints[near]], [prints[near + 1]]
            for b, e in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                if e - b > most:
                    yield members(rows[:, b:e])
                else:
                    a, c = spanning_links(prints[b:e], radius)
                    heads.append(a)
                    tails.append(c)
            if sum(map(len, heads)):
                yield links(heads, tails)

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch[c].to_numpy().view(np.uint64) for c in ("mask", "a")])], 1)
            if not rows.shape[1]:
                continue
            again = np.append(False, (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1]))
            rows = rows[:, ~again]  # buckets of one union of masks can be met twice
            key = rows[0] & rows[1]
            begins = np.flatnonzero(np.append(True, (rows[0, 1:] != rows[0, :-1]) | (key[1:] != key[:-1])))
            if large == (int(rows[0, 0]), int(key[0])):  # the rest of a bucket that has been found too large
                until = int(begins[1]) if len(begins) > 1 else rows.shape[1]
                yield members(rows[:, :until])
                rows, key, begins = rows[:, until:], key[until:], begins[1:] - until
                if not len(begins):
                    held = np.empty((2, 0), np.uint64)
                    continue
            yield from settle(rows, begins[:-1], begins[1:])
            held, large = rows[:, begins[-1] :], None
            if held.shape[1] > most:
                large = int(held[0, 0]), int(key[begins[-1]])
                yield members(held)
                held = np.empty((2, 0), np.uint64)
        if held.shape[1]:
            yield from settle(held, np.array([0]), np.array([held.shape[1]]))

    return run


def covering_links(prints: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """prints(fingerprint), each once -> links (a, b) within the radius whose components are those of all such links.

    ``most`` is at least 2^(radius + 1): a run of more than ``radius`` free places meets every mask, so larger buckets get smaller."""
    most = max(most, 2 << radius)
    rows, out = prints.select(F.lit(0).cast("long").alias("mask"), F.col("fingerprint").alias("a")), None
    while True:
        key = [F.col("mask"), F.col("mask").bitwiseAND(F.col("a"))]
        dealt = rows.mapInArrow(_expand(radius), "mask long, a long").repartition(*key).sortWithinPartitions(*key, "a")
        met = materialize(dealt.mapInArrow(_meet(radius, most), "mask long, a long, b long"), "met")
        links = met.where("mask is null").select("a", "b")
        out, rows = links if out is None else out.union(links), met.where("mask is not null").select("mask", "a")
        if rows.isEmpty():
            return out


def near_duplicates(documents: DataFrame, radius: int = 4, width: int = 4, most: int = MOST) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fingerprint in hex digits, component_id)."""
    prints = materialize(fingerprints(documents, width), "prints")
    each = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    found = materialize(connected_components(covering_links(each.select("fingerprint"), radius, most)), "components")
    each = each.join(found.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    first = each.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(each.join(first, "component").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
