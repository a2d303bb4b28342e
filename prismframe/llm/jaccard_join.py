"""Operator 6: exact n-gram Jaccard join by a size-aware heavy-light scheme.

Documents become sets of hashed word shingles.  Documents with equal sets are one *class* and only
its representative goes on.  Two different sets can reach the threshold only if they share an element among
the first ``n - ceil(t n) + 1`` of each in any fixed global order, and ``c`` elements among the first
``n - ceil(t n) + c``.  So

* *light* sets (size at most the boundary) enumerate all ``c``-subsets (c = 2) of the longer prefix:
  two light sets that link share at least one subset;
* *heavy* sets scan the inverted lists of their prefix elements; light sets near enough in size to link
  with a heavy one are in these lists too.

The boundary is the set size that makes the estimated cost least: rows of subset keys against rows of
single keys plus the candidates that the inverted lists are expected to give (their mean length is
measured over all sets).  The global order puts the shingles that many documents share last; it is a
fixed-size bit map plus the hash, so any content of the map gives the same result.

Pairs are never enumerated within a list.  First each set is verified against the first of the list and
the one before it.  Lists that still hold several components are then read whole, in parts of at most
``LIST_ROWS``: a bit-map filter, which bounds the intersection exactly, tells which *components* may link, and
their sets meet in blocks until one link is found.  Every link between different sets is thus verified or lies
within one component already; the number of each set's links is counted by comparing the blocks of its
component, which lists no pairs either.

Nulls, empty texts and texts without words have the empty set, link with nothing and are their own
component.  A null ``doc_id`` is kept as a row with a null component (it has no id to be reached by).
Repeated ids count as one document whose component holds all their texts.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.llm.common import broadcast_if_small, free, hashed_texts, materialize, mix, rows_of, shingles, table
from prismframe.llm.components import connected_components

HOT_BITS = 1 << 20
HOT_MOST = HOT_BITS // 8
HOT_CHUNK = 500_000
SKETCH_LONGS = 16
SUBSET = 2
LIGHT_MOST = 64
#: Rows of a list, and sets of a component, that meet in one task; more are parted and meet part by part.
LIST_ROWS = 4096
CELL_SETS = 256


def _sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    hashes, starts = hashed_texts([t.lower() if t else None for t in texts])
    runs = shingles(hashes, width)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:  # fewer words are one element; their own width keeps it apart from true shingles
            out.append(shingles(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def _needed(n: int, threshold: Fraction) -> int:
    """The least overlap of a set of n elements with any set that it links with."""
    return math.ceil(threshold * n)


def _heavy_hitters(width: int):
    """Chunks of texts -> (bucket of the hash, count) of shingles that repeat within the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array((values[often] % np.uint64(HOT_BITS)).astype(np.int32)), pa.array(counts[often])], ["bucket", "n"]
            )

        for rows in rows_of(batches):
            held += _sets([text for (text,) in rows], width)
            size += sum(len(one) for one in held[-len(rows) :])
            if size >= HOT_CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _hot_map(texts: DataFrame, width: int) -> np.ndarray:
    """Bit map (fixed size) of the buckets with the most frequent shingles, counted over all texts."""
    rows = (
        texts.select("text")
        .mapInArrow(_heavy_hitters(width), "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .where("n >= 16")
        .orderBy(F.desc("n"), "bucket")
        .limit(HOT_MOST)
        .select("bucket")
        .toPandas()
    )
    hot = np.zeros(HOT_BITS, bool)
    hot[rows["bucket"].to_numpy(np.int64)] = True
    return np.packbits(hot)


def _sketch(one: np.ndarray) -> np.ndarray:
    """Parity bit map: its Hamming distance to another never exceeds the symmetric difference."""
    places = mix(one, 17) % np.uint64(64 * SKETCH_LONGS)
    parity = np.bincount(places.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _fingerprints(width: int, threshold: Fraction, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            ids, sizes, digests, prefixes, sketches = [r[0] for r in rows], [], [], [], []
            for one in _sets([r[1] for r in rows], width):
                n = len(one)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(one.tobytes()) if n else None)
                sketches.append(_sketch(one).tolist())
                if n < 2:
                    prefixes.append([])
                    continue
                bucket = (one % np.uint64(HOT_BITS)).astype(np.int64)
                late = (hot[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1
                order = np.lexsort((one, late))
                prefixes.append(one[order[: n - _needed(n, threshold) + SUBSET]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "prefix", "sketch"],
            )

    return run


def _id_filter(members: DataFrame) -> np.ndarray:
    """Bit map of the members' hashed ids, some 8 bits for each and never more than 16 MB, so that the
    texts of others need not be shuffled; the exact semi join follows on what passes."""
    bits = 1 << min(27, max(16, (8 * members.count()).bit_length()))
    rows = members.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("m")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out


def _parities(one: np.ndarray) -> np.ndarray:
    """For each of 2^k places, at least as many as elements, whether an odd number of elements falls there: two sets
    differ in no fewer elements than their bits do, also after folding (see ``_apart``)."""
    bits = max(64, 1 << (len(one) - 1).bit_length())
    odd = np.bincount((mix(one, 23) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _apart(x: list[np.ndarray], y: list[np.ndarray], on: np.ndarray) -> np.ndarray:
    """In how many bits the pairs marked in ``on`` differ, where the longer one is folded to the length of the shorter."""
    out, longs = np.zeros(on.shape, np.int64), np.array([len(b) for b in y])
    for k, one in enumerate(x):
        for size in np.unique(longs[on[k]]).tolist():
            at, least = np.flatnonzero(on[k] & (longs == size)), min(len(one), size)
            others = np.stack([y[j] for j in at]).reshape(len(at), -1, least)
            differ = np.bitwise_xor.reduce(others, axis=1) ^ np.bitwise_xor.reduce(one.reshape(-1, least), axis=0)
            out[k, at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def _whole_sets(width: int, passes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["p"].to_numpy() % (64 * len(passes))
            batch = batch.filter(pa.array((passes[at >> 6] >> (at & 63)) & 1 == 1))
            for rows in rows_of([batch]):
                sets = _sets([r[1] for r in rows], width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_parities(s).tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n", "elements", "parities"],
                )

    return run


def _sets_of(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, elements, parities) of the members (a materialised table of distinct ids), from the texts."""
    hashed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 27)).alias("p"))
    sets = hashed.mapInArrow(_whole_sets(width, _id_filter(members)), "doc_id long, n int, elements binary, parities binary")
    return materialize(sets.join(broadcast_if_small(members), "doc_id", "left_semi").where("n >= 2").distinct(), "sets")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches -> a table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = bool(held) and any(c[0] != held[-1][k][-1].as_py() for k, c in zip(keys, columns, strict=True))
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if at and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each left with each right set."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    names, at = np.unique(np.concatenate(left + right), return_inverse=True)
    often = np.bincount(at) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    on = often[at]
    row, at = row[on], place[at[on]]
    out = np.zeros((len(left), len(right)))
    for a in range(0, int(often.sum()), 8192):
        some = (at >= a) & (at < a + 8192)
        marks = np.zeros((len(left) + len(right), 8192), np.float32)
        marks[row[some], at[some] - a] = 1
        out += marks[: len(left)] @ marks[len(left) :].T
    return np.rint(out).astype(np.int64)


CELL = ["hub", "i", "j"]


def _cells(threshold: Fraction, what: str):
    """Sorted rows (hub, i, j, side, rep, c, n, s) of cells -> what holds for the sets of side 0 against those of side 1.

    ``may``: (hub, c) unless sizes or parities rule a link out; ``link``: (hub, c) with a link; ``count``: each
    set's number of links in the cell (cells with i = j are compared with themselves)."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, CELL):
            side, rep, c, n = (group[k].to_numpy() for k in ("side", "rep", "c", "n"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["s"]]
            alone = what == "count" and group["i"][0] == group["j"][0]
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
            if len(x) and len(y):
                left, right = ([sets[k] for k in at] for at in (x, y))
                total = n[x][:, None].astype(np.int64) + n[y]
                if what == "may":
                    least = np.minimum(n[x][:, None], n[y]).astype(np.int64)
                    on = least * den >= num * (total - least)
                    on &= _apart(left, right, on) * (num + den) <= (den - num) * total
                else:
                    both = _shared(left, right)
                    on = (den * both >= num * (total - both)) & (both > 0) & (rep[x][:, None] != rep[y])
                if what == "count":
                    sides = [(x, on.sum(axis=1))] + [(y, on.sum(axis=0))] * (not alone)
                    out += [(int(rep[k]), int(v)) for at, found in sides for k, v in zip(at, found, strict=True) if v]
                else:
                    hub = group["hub"][0].as_py()
                    out += [(hub, v) for v in np.unique(c[y[on.any(axis=0)]]).tolist()]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in zip(*out, strict=True)], ["a", "b"])

    return run


def _in_cells(rows: DataFrame, sets: DataFrame, column: str, threshold: Fraction, what: str) -> DataFrame:
    """rows(hub, i, j, side, rep, c): the cells' sets meet in one task, some ``CELL_SETS`` of either side."""
    filled = rows.join(sets.select(F.col("doc_id").alias("rep"), "n", F.col(column).alias("s")), "rep")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filled.select(*CELL, "side", "rep", "c", "n", "s").repartition(n, *CELL).sortWithinPartitions(*CELL, "side")
    return dealt.mapInArrow(_cells(threshold, what), "a long, b long")


def _hub_cells(pairs: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Cells in which each hub a meets its partners b, so that a hub's sets are not copied for every partner.

    Hubs and partners are ids or, with blocks(c, id, block, blocks), components: then every partner's
    set meets every block of the hub."""
    if blocks is None:
        guests = pairs.select(F.col("a").alias("hub"), F.lit(0).alias("i"), F.col("b").alias("rep"), F.col("b").alias("c"))
    else:
        split = blocks.groupBy("c").agg(F.first("blocks").alias("k"))
        guests = pairs.join(split.toDF("a", "k"), "a").join(blocks.select(F.col("c").alias("b"), F.col("id").alias("rep")), "b")
        guests = guests.select(F.col("a").alias("hub"), F.explode(F.expr("sequence(0, k - 1)")).alias("i"), "rep", F.col("b").alias("c"))
    parts = guests.where("i = 0").groupBy("hub").agg(F.ceil(F.count("*") / CELL_SETS).cast("int").alias("parts"))
    guests = guests.join(parts, "hub").select("hub", "i", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("j"), F.lit(1).alias("side"), "rep", "c")
    of = parts.select("hub", F.lit(0).alias("i"), F.col("hub").alias("rep"), "parts") if blocks is None else parts.join(blocks.select(F.col("c").alias("hub"), F.col("block").alias("i"), F.col("id").alias("rep")), "hub").select("hub", "i", "rep", "parts")
    hosts = of.select("hub", "i", F.explode(F.expr("sequence(0, parts - 1)")).alias("j"), F.lit(0).alias("side"), "rep", F.col("hub").alias("c"))
    return guests.union(hosts)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: Fraction, blocks: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) of ids, or of components, of which some sets reach the threshold."""
    may = materialize(_in_cells(_hub_cells(pairs, blocks), sets, "parities", threshold, "may").distinct(), "may_link")
    links = materialize(_in_cells(_hub_cells(may, blocks), sets, "elements", threshold, "link").distinct(), "linked")
    free(may)
    return links


def _crossing(threshold: Fraction):
    """Sorted rows (key, s1, s2, n, c, sketch) of lists -> the pairs of components (a < b) of which some
    sets may link: near in size and no further apart than the sketches allow."""
    num, den = threshold.numerator, threshold.denominator

    def near(n, c, sketch, x, y) -> np.ndarray:
        """Which of the rows x may link with the rows y of another component."""
        total = n[x] + n[y]
        on = (c[x] != c[y]) & (np.minimum(n[x], n[y]) * den >= num * np.maximum(n[x], n[y]))
        shape, on = on.shape, np.flatnonzero(on)
        x, y = np.broadcast_to(x, shape).ravel()[on], np.broadcast_to(y, shape).ravel()[on]
        apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        close = apart * (num + den) <= (den - num) * total.ravel()[on]
        return np.stack([np.minimum(c[x], c[y])[close], np.maximum(c[x], c[y])[close]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks()
            key, s1, s2, n, c = (rows[k].to_numpy() for k in ("key", "s1", "s2", "n", "c"))
            edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))), len(key))
            if not last:
                edges = edges[:-1]  # the last list may go on
            held = [] if last else rows.slice(edges[-1]).to_batches()
            n, sketch = n.astype(np.int64), rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_LONGS)
            sizes, found = np.diff(edges), []
            # short lists, all at once: each row with the one d places on
            end = np.repeat(np.where(sizes <= 64, edges[1:], edges[:-1]), sizes)
            at = np.arange(edges[0], edges[-1])
            for d in range(1, 64):
                at = at[at + d < end[at - edges[0]]]
                if not len(at):
                    break
                found += [near(n, c, sketch, x, x + d) for x in np.split(at, range(65536, len(at), 65536))]
            for a, b in zip(edges[:-1][sizes > 64].tolist(), edges[1:][sizes > 64].tolist(), strict=True):
                names, which, counts = np.unique(c[a:b], return_inverse=True, return_counts=True)
                minor = a + np.flatnonzero(which != counts.argmax())
                found += [np.unique(near(n, c, sketch, minor[k : k + 64][:, None], np.arange(a, b)), axis=1) for k in range(0, len(minor), 64)]
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
            if pairs.size:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 20_000:
                    yield from finish(False)
        if held:
            yield from finish(True)

    return run


def _blocks(comps: DataFrame, of: DataFrame) -> DataFrame:
    """comps(id, c) -> (c, id, block, blocks) of the components in ``of`` (c), at most some ``CELL_SETS`` ids in a block."""
    sizes = comps.groupBy("c").agg(F.count("*").alias("k")).join(of, "c", "left_semi").select("c", F.ceil(F.col("k") / CELL_SETS).cast("int").alias("blocks"))
    return comps.join(sizes, "c").select("c", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks")


def _bit_words(places: DataFrame) -> DataFrame:
    """One column of whole numbers -> (w, bits): the words of their bit map that are not zero."""
    p = places.columns[0]
    return places.groupBy(F.expr(f"{p} div 64").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({p} % 64 as int)))").alias("bits"))


def _without(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The rows whose ``row`` is not in the bit map ``words`` (materialised)."""
    found = rows.withColumn("w", F.expr("row div 64")).join(broadcast_if_small(words), "w", "left")
    return found.where("coalesce(getbit(bits, cast(row % 64 as int)), 0) = 0").select(*rows.columns)


def _boundary(single: DataFrame, threshold: Fraction) -> int:
    """The largest set size for which enumerating subsets costs no more rows than scanning lists.

    A scan costs its postings and, for each, the other members of its list; the mean of these is
    measured over all sets of at most ``LIGHT_MOST`` elements (larger ones have too many subsets)."""
    lengths = single.where(f"n <= {LIGHT_MOST}").groupBy("key").agg(F.count("*").alias("k"))
    total, squares = lengths.agg(F.sum("k"), F.sum(F.col("k") * F.col("k"))).first()
    mean_list = squares / total - 1 if total else 0
    light = 0
    for n in range(2, LIGHT_MOST + 1):
        prefix = n - _needed(n, threshold) + 1
        if prefix * (prefix + 1) / 2 > prefix * (1 + mean_list):
            break
        light = n
    return light


def jaccard_components(documents: DataFrame, width: int = 4, threshold: float = 0.85, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links): see the module's text.

    ``class_id`` is the smallest id with the same set; ``n_links`` is the number of other classes (different
    sets) that link with the document's, null if ``count_links`` is off.
    """
    t = Fraction(str(threshold))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    hot = _hot_map(docs, width)
    marks = docs.mapInArrow(_fingerprints(width, t, hot), "doc_id long, n int, digest binary, prefix array<long>, sketch array<long>")
    marks = materialize(marks.withColumn("row", F.monotonically_increasing_id()), "marks")
    known = marks.where("n > 0 and doc_id is not null")
    copies = known.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("k")).where("k > 1")
    copies = materialize(copies.select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row")), "copies")
    others = materialize(_bit_words(known.select("digest", "row").join(broadcast_if_small(copies), "digest").where("row <> class_row").select("row")), "others")
    # 64 row numbers in a word: broadcast up to some ten millions, so that prefixes are not shuffled with them
    apart = lambda rows: _without(rows.where("n >= 2 and doc_id is not null"), others).withColumnRenamed("doc_id", "rep")
    reps = apart(marks).select("rep", "n", "prefix")
    num, den = t.numerator, t.denominator
    needed = f"(n * {num}L + {den - 1}L) div {den}L"
    single = reps.select("rep", "n", F.explode(F.expr(f"slice(prefix, 1, cast(n - {needed} + 1 as int))")).alias("key"))
    light = _boundary(single, t)
    # two light sets meet by c-subsets; a heavy one meets any other, light or heavy, by its inverted lists
    to_lists = single.where(f"n > {light} or n * {den}L >= {num}L * {light + 1}L").select(
        "rep", "n", (F.col("n") <= light).alias("light"), F.xxhash64(F.lit(1), "key").alias("key")
    )
    pairs = reps.where(f"n <= {light}").select(
        "rep", "n", F.explode(F.expr("flatten(transform(prefix, (x, i) -> transform(slice(prefix, i + 2, size(prefix)), y -> xxhash64(2, least(x, y), greatest(x, y)))))")).alias("key")
    )
    postings = to_lists.union(pairs.select("rep", "n", F.lit(None).cast("boolean").alias("light"), "key"))
    by_key = Window.partitionBy("key")
    lists = materialize(
        postings.withColumns({"m": F.count("*").over(by_key), "heavy": F.max(~F.coalesce("light", F.lit(False))).over(by_key)})
        .where("m > 1 and heavy")
        .select("key", "rep", "n"),
        "lists",
    )
    # the prefixes have served
    whole, marks = marks, materialize(marks.select("doc_id", "n", "digest", "sketch", "row"), "sketches")
    free(whole)
    reps = apart(marks).select("rep", "n", "sketch")
    near = f"least(n, n2) * {den}L >= {num}L * greatest(n, n2)"
    ordered = by_key.orderBy("n", "rep")
    before = F.lag(F.struct(F.col("rep").alias("rep2"), F.col("n").alias("n2"))).over(ordered)
    first = F.first(F.struct(F.col("rep").alias("rep2"), F.col("n").alias("n2"))).over(ordered)
    tried = materialize(
        lists.withColumn("tries", F.array(before, first)).select("rep", "n", F.explode("tries").alias("o")).where("o is not null").select("rep", "n", "o.rep2", "o.n2")
        .where(f"rep <> rep2 and {near}")
        .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
        .distinct(),
        "tried",
    )
    # symmetric difference <= (1 - t) / (1 + t) * (n + n2)
    differ = " + ".join(f"bit_count(sketch[{k}] ^ s2[{k}])" for k in range(SKETCH_LONGS))
    close = f"({differ}) * {num + den}L <= {den - num}L * (n + n2)"
    one, other = (reps.select("rep", "n", "sketch").toDF(*names) for names in (("a", "n", "sketch"), ("b", "n2", "s2")))
    likely = materialize(tried.join(one, "a").join(other, "b").where(close).select("a", "b"), "likely")
    free(tried)
    members = materialize(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "members")
    sets = _sets_of(docs, members, width)
    links = _linked(likely, sets, t)
    free(likely)

    comps = _components(links)
    more = _joined(docs, reps, lists, comps, sets, members, width, t)
    if more is not None:
        joined, fetched = more
        links, sets, members = links.union(joined).distinct(), sets.union(fetched), fetched.select("doc_id").union(members)
        comps = _components(links)
    free(lists)
    degree = _degrees(docs, comps, sets, members, width, t) if count_links else None
    return _result(marks, copies, links, comps, degree)


def _components(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links).withColumnRenamed("component", "c"), "comps")


def _joined(docs: DataFrame, reps: DataFrame, lists: DataFrame, comps: DataFrame, sets: DataFrame, members: DataFrame, width: int, t: Fraction) -> tuple[DataFrame, DataFrame] | None:
    """Links (a, b) between components that some list holds together, and the sets fetched for them; None if there are none to try.

    Lists that still hold several components tell which of these may link; then their sets meet in exact blocks."""
    placed = lists.join(broadcast_if_small(comps), lists.rep == comps.id, "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("g")).where("lo < hi").select("key", "g")
    several = materialize(several, "several")
    placed = placed.join(broadcast_if_small(several), "key").withColumn("salt", F.pmod(F.xxhash64("rep"), "g").cast("int"))
    placed = placed.join(reps.select("rep", "sketch"), "rep")
    # a long list is compared in parts: every row meets each of the list's parts
    placed = placed.withColumn("o", F.explode(F.expr("sequence(0, g - 1)"))).select("key", F.least("salt", "o").alias("s1"), F.greatest("salt", "o").alias("s2"), "n", "c", "sketch")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(partitions, "key", "s1", "s2").sortWithinPartitions("key", "s1", "s2")
    crossing = materialize(dealt.mapInArrow(_crossing(t), "a long, b long").distinct(), "crossing")
    free(several)
    if crossing.isEmpty():
        return None
    ends = materialize(crossing.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ends")
    # a component's name is the id of one of its rows
    grown = materialize(ends.join(broadcast_if_small(comps.where("id = c").select("c")), "c", "left_anti").select(F.col("c").alias("id"), "c"), "grown")
    blocks = materialize(_blocks(comps.select("id", "c").union(grown), broadcast_if_small(ends)), "blocks")
    free(ends, grown)
    wanted = materialize(blocks.select(F.col("id").alias("doc_id")).distinct().join(members, "doc_id", "left_anti"), "wanted")
    more = _sets_of(docs, wanted, width)
    every = sets.union(more)
    size = blocks.groupBy("c").agg(F.count("*").alias("k"))
    sized = crossing.join(size.toDF("a", "ka"), "a").join(size.toDF("b", "kb"), "b")
    # the larger one is the hub
    hubs = materialize(sized.select(F.when(F.col("ka") >= F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("ka") >= F.col("kb"), F.col("b")).otherwise(F.col("a")).alias("b")), "hubs")
    joined = _linked(hubs, every, t, blocks)
    free(crossing, blocks, hubs)
    return joined, more


def _degrees(docs: DataFrame, comps: DataFrame, sets: DataFrame, held: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """(id, n_links) of the representatives: each component is compared with itself in blocks, so links are
    counted and not listed."""
    pairs = comps.groupBy("c").agg(F.count("*").alias("k"))
    two = comps.join(pairs.where("k = 2"), "c", "left_semi").select("id", F.lit(1).cast("long").alias("n_links"))
    large = materialize(_blocks(comps.select("id", "c"), pairs.where("k > 2").select("c")), "large")
    if large.isEmpty():
        return materialize(two, "degrees")
    wanted = materialize(large.select(F.col("id").alias("doc_id")).distinct().join(held, "doc_id", "left_anti"), "wanted")
    more = _sets_of(docs, wanted, width)
    # block x meets every block y: cell (min, max), side 1 for the larger
    met = large.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = met.select(F.col("c").alias("hub"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).cast("int").alias("side"), F.col("id").alias("rep"), "c")
    counted = _in_cells(rows, sets.union(more), "elements", threshold, "count").toDF("id", "n").groupBy("id").agg(F.sum("n").alias("n_links"))
    return materialize(counted.union(two), "degrees")


def _result(marks: DataFrame, copies: DataFrame, links: DataFrame, comps: DataFrame, degree: DataFrame | None) -> DataFrame:
    """Spread the representatives' components to all members of their classes."""
    member = marks.select("doc_id", "n", "digest").join(broadcast_if_small(copies.select("digest", "class_id")), "digest", "left")
    member = member.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    # several texts under one id join their classes too
    repeated = member.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count()
    if repeated:
        links = links.union(member.where("class_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))).distinct()
        comps = _components(links)
    at = "doc_id" if repeated else "class_id"
    out = member.withColumn("id", F.col(at)).join(broadcast_if_small(comps), "id", "left")
    n_links = F.lit(None).cast("long")
    if degree is not None:
        out = out.join(broadcast_if_small(degree.toDF("class_id", "links")), "class_id", "left")
        n_links = F.coalesce("links", F.lit(0))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("c", "class_id").alias("component_id"), "class_id", n_links.cast("long").alias("n_links"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 0.85)
