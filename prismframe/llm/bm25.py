"""Operator 1: exact top-k search with BM25 over sharded inverted indexes with block maxima.

Document frequencies, the number of documents and their mean length are counted over all documents.
Documents are dealt by hash over shards; each shard builds an inverted index whose posting lists are cut into blocks of
``BLOCK`` documents, with the largest impact of each list and, of longer lists, of each (list, block).  Queries come in groups of a
bounded size, which go to the shards whole; an index is built for several groups, never copied.

Block-max WAND, for numpy: the lists of many documents are rows of a matrix, whose product with the weights of many queries
at once gives what they add.  A query reads its other lists in falling order of their upper bounds.  The k-th best sum so far is
the threshold, or the k-th best score of shards searched before.  Once the lists not read cannot reach it by themselves, only documents met so
far can be pivots: those whose sum and the lists' upper bounds reach the threshold, and then those whose sum and their block's maxima do.
When scoring the pivots costs less than reading on, they are scored exactly, the highest bound first, until the
next bound is below the k-th best score.  The shards' top k are merged exactly, since all scores use the global
statistics and one order of summation; ties go to the smaller id.

Only terms that some query has (a fixed-size filter, then exact) are indexed, which changes no score.
Words are lower-cased (A-Z).  Null texts have no words and match nothing; queries without words have no results; rows
with a null id are left out; repeated ids are separate documents.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.llm.common import bit_map, free, hashed_texts, materialize, mix, rows_of, table

BLOCK = 64
K1, B = 1.2, 0.75
CHUNK = 1_000_000
#: Bounds are raised by this factor, since sums of rounded impacts stand for exact ones.
SLACK = 1 + 1e-5
#: Lists of more than this part of a shard's documents, the longest so many, are kept as rows of a matrix.
DENSE, DENSE_LISTS = 20, 1024
#: How many sums (queries x documents) are held at once.
SUMS = 1 << 21
#: Groups of queries that one job answers; from so many shards on, every so many-th of them is searched first.
GROUPS, SHARDS, FIRST = 8, 32, 16
#: How many entries of posting lists are read in the time of one of a document's own entries.
OWN_COST = 4


def _terms(rows: list[tuple]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, words, distinct term hashes, their counts) of each row (id, text)."""
    hashes, starts = hashed_texts([t.lower() if t else None for _, t in rows])
    for (i, _), a, b in zip(rows, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        terms, counts = np.unique(hashes[a:b], return_counts=True)
        yield i, b - a, terms, counts


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        for i, _, terms, counts in _terms(rows):
            if len(terms):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), i)), pa.array(terms.view(np.int64)), pa.array(counts)], ["query_id", "term", "n"])


def _passing(terms: np.ndarray, passes: np.ndarray) -> np.ndarray:
    at = (mix(terms, 7) % np.uint64(8 * len(passes))).astype(np.int64)
    return (passes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter_of(terms: DataFrame) -> np.ndarray:
    """Bit map of hashed terms, some 8 bits for each and never more than 16 MB."""
    return bit_map(terms, 7)


def _told(passes: np.ndarray):
    """(words, terms that pass) of each document."""
    return lambda batches: ((n, terms[_passing(terms, passes)]) for rows in rows_of(batches) for _, n, terms, _ in _terms(rows))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The same from the rows that ``_postings`` gave."""
    for batch in batches:
        terms, lengths = _flat(batch["terms"])
        ends = np.cumsum(lengths)
        for n, a, b in zip(batch["n_words"].to_pylist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
            yield n, terms[a:b].view(np.uint64)


def _frequencies(of):
    """Partial document frequencies of the terms that ``of`` gives, and under a null term (documents, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs, words = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            terms, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts), pa.array(np.zeros(len(terms), np.int64))], ["term", "df", "words"])

        for n, terms in of(batches):
            docs, words = docs + 1, words + n
            held.append(terms)
            size += len(terms)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs]), pa.array([words])], ["term", "df", "words"])

    return run


def _postings(passes: np.ndarray):
    """The terms that pass of each document, also of those without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            ids, sizes, terms, counts = [], [], [], []
            for i, n, t, c in _terms(rows):
                on = _passing(t, passes)
                ids.append(i)
                sizes.append(n)
                terms.append(t[on].view(np.int64))
                counts.append(c[on].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                ["doc_id", "n_words", "terms", "counts"],
            )

    return run


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of several ranges, end to end."""
    counts = ends - begins
    return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


class Queries(NamedTuple):
    """A group of queries: query i has the terms known[term[begin[i]:begin[i + 1]]], in their order, and their weights."""

    ids: np.ndarray
    begin: np.ndarray
    known: np.ndarray
    term: np.ndarray
    weight: np.ndarray


class ShardIndex:
    """Posting lists sorted by (term, document) with the largest impact of each list and of each block, and the
    documents' own terms for exact scores.  Lists hold rounded impacts; ``SLACK`` covers that in every bound."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, mean: float):
        order = np.argsort(ids, kind="stable")  # ties between equal scores then go to the smaller id
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.ids = ids[order]
        ends = np.cumsum(lengths)
        self.own_begin, self.own_end = (ends - lengths)[order], ends[order]
        self.sizes, self.counts, self.mean = sizes[order], counts, mean
        doc = np.repeat(rank, lengths)
        by = np.lexsort((doc, terms))
        terms, doc, impact = terms[by], doc[by], np.empty(len(by), np.float32)
        for some in (slice(i, i + CHUNK) for i in range(0, len(by), CHUNK)):
            impact[some] = self._impact(doc[some], by[some])
        new_term = np.append(True, terms[1:] != terms[:-1]) if len(terms) else np.zeros(0, bool)
        self.terms, self.begin = terms[new_term], np.flatnonzero(new_term)
        self.end = np.append(self.begin[1:], len(doc))
        del terms
        # weights stand by falling length of the lists, so that those of most entries are near each other
        longest = np.argsort(self.begin - self.end, kind="stable")
        self.slot = np.empty(len(longest), np.int32)
        self.slot[longest] = np.arange(len(longest))
        self.own_term = np.empty(len(by), np.int32)
        self.own_term[by] = np.repeat(self.slot, self.end - self.begin)
        del by
        # blocks of the lists that have several documents in most of them
        sizes, n, self.n_blocks = self.end - self.begin, len(ids), -(-len(ids) // BLOCK)
        held = np.repeat(sizes > 2 * self.n_blocks, sizes)
        at = np.flatnonzero(held & (new_term | np.append(True, doc[1:] // BLOCK != doc[:-1] // BLOCK))) if len(doc) else np.empty(0, np.int64)
        self.block = doc[at] // BLOCK
        cuts = np.union1d(at, 1 + np.flatnonzero(held[:-1] & ~held[1:]))  # also where such lists end
        self.block_most = np.maximum.reduceat(impact, cuts)[np.searchsorted(cuts, at)] if len(at) else impact[:0]
        self.first, self.last = np.searchsorted(at, self.begin).astype(np.int32), np.searchsorted(at, self.end).astype(np.int32)
        self.most = np.maximum.reduceat(impact, self.begin) if len(doc) else impact
        self.weight, self.asked = np.zeros(len(self.terms)), np.zeros(len(self.terms), bool)
        # the lists that hold many documents, as rows of a matrix
        dense = longest[:DENSE_LISTS]
        dense = dense[sizes[dense] * DENSE > n]
        self.dense, self.row = np.zeros((len(dense), n), np.float32), np.full(len(self.terms), -1, np.int32)
        self.row[dense] = np.arange(len(dense))
        places = _ranges(self.begin[dense], self.end[dense])
        self.dense[np.repeat(np.arange(len(dense)), sizes[dense]), doc[places]] = impact[places]
        self.slack = SLACK + 2.0**-22 * len(dense)
        self.entries = np.stack([doc, impact.view(np.int32)], axis=1).view(np.int64)[:, 0]  # a document and its impact are gathered at once

    def _impact(self, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The exact impacts of documents' own entries, which stand at ``places``."""
        counts = self.counts[places].astype(np.int64)
        return counts * (K1 + 1) / (counts + K1 * (1 - B + B * self.sizes[docs] / self.mean))

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents by their own terms, always summed in the order of the terms."""
        own = [b + np.flatnonzero(self.asked[self.own_term[b:e]]) for b, e in zip(self.own_begin[docs].tolist(), self.own_end[docs].tolist(), strict=True)]
        places, of = np.concatenate([np.empty(0, np.int64), *own]), np.repeat(np.arange(len(docs)), [len(one) for one in own])
        return np.bincount(of, self.weight[self.own_term[places]] * self._impact(docs[of], places), len(docs))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents; terms are sorted."""
        return next(self.search_all(Queries(np.zeros(1, np.int64), np.array([0, len(terms)]), terms, np.arange(len(terms)), weights), k))[1:]

    def search_all(self, asked: Queries, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k best documents of each query, of scores that are not below its ``least``."""
        found = np.searchsorted(self.terms, asked.known)
        found[found == len(self.terms)] = 0
        found[self.terms[found] != asked.known if len(self.terms) else slice(None)] = -1
        least = np.zeros(len(asked.ids)) if least is None else least
        step = max(1, min(256, SUMS // max(1, len(self.ids))))
        for first in range(0, len(asked.ids), step):
            queries = range(first, min(first + step, len(asked.ids)))
            own, some = [], np.zeros((len(queries), len(self.dense)), np.float32)
            for i, q in enumerate(queries):
                at, weights = found[asked.term[asked.begin[q] : asked.begin[q + 1]]], asked.weight[asked.begin[q] : asked.begin[q + 1]]
                at, weights = at[at >= 0], weights[at >= 0]
                row = self.row[at]
                some[i, row[row >= 0]] = weights[row >= 0]
                own.append((at, weights, row < 0))
            sums = some @ self.dense
            for i, q in enumerate(queries):
                yield asked.ids[q], *self._best(*own[i], sums[i], k, float(least[q]))

    def _kth(self, sums: np.ndarray, k: int) -> float:
        """The k-th largest sum."""
        if len(sums) < 64 * k:
            return float(np.partition(sums, len(sums) - k)[len(sums) - k])
        # the k-th largest of the maxima of 16 k runs and the rest is not above it, and few sums are as large
        runs = sums[: len(sums) // (16 * k) * 16 * k].reshape(16 * k, -1).max(axis=1)
        large = sums[sums >= np.partition(runs, 15 * k)[15 * k]]
        return float(np.partition(large, len(large) - k)[len(large) - k])

    def _best(self, at: np.ndarray, weights: np.ndarray, sparse: np.ndarray, sums: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents: ``sums`` has what the dense lists add, the ``sparse`` ones are read."""
        if not len(at):
            return self.ids[:0], np.empty(0)
        lists, own = at[sparse], weights[sparse]
        bound = own * self.most[lists]
        order = np.argsort(-bound)
        lists, own = lists[order], own[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0) * SLACK  # what lists from here on can add
        begin, end = self.begin[lists], self.end[lists]
        sizes = end - begin
        upto = np.append(0, np.cumsum(sizes))
        n, k = len(self.ids), min(k, len(self.ids))
        read, step = 0, max(n // 2, 1024)
        must = int(np.argmax(rest < least)) if least > 0 else 0  # lists to read before others can be left
        while True:
            if read < len(lists):
                until = max(must, read + 1, int(np.searchsorted(upto, upto[read] + step, "right")) - 1)
                found = self.entries[_ranges(begin[read:until], end[read:until])].view(np.int32).reshape(-1, 2)
                sums = sums + np.bincount(found[:, 0], found[:, 1].view(np.float32) * np.repeat(own[read:until], sizes[read:until]), n)
                read, step = until, 3 * step
            threshold = max(least, self._kth(sums, k) / self.slack)
            if read < len(lists) and rest[read] >= threshold:
                continue  # a document of none of the lists so far could still be among the best
            most = sums * self.slack + rest[read]
            pivots = np.flatnonzero((most >= threshold) & (sums > 0))
            most = most[pivots] if read < len(lists) else np.full(len(pivots), np.inf)
            if read < len(lists) and not self._cheap(pivots, upto[-1] - upto[read]):
                blocks = self.last[lists[read:]] - self.first[lists[read:]]
                if not blocks.any():
                    continue  # reading on is cheaper, and the bounds get tighter
                entries = _ranges(self.first[lists[read:]], self.last[lists[read:]])
                more = np.bincount(self.block[entries], np.repeat(own[read:], blocks) * self.block_most[entries], self.n_blocks)
                more += bound[order][read:][blocks == 0].sum()
                most = (sums[pivots] + more[pivots // BLOCK]) * self.slack
                pivots, most = pivots[most >= threshold], most[most >= threshold]
                if not self._cheap(pivots, upto[-1] - upto[read]):
                    continue
            break
        order = np.argsort(-most, kind="stable")
        pivots, most = pivots[order], most[order]
        self.weight[self.slot[at]], self.asked[self.slot[at]] = weights, True
        docs, scores, done = pivots[:0], np.empty(0), 0
        step = len(pivots) if read == len(lists) else 2 * k
        while done < len(pivots) and most[done] >= threshold:
            some = pivots[done : done + step]
            docs, scores = np.append(docs, some), np.append(scores, self._scores(some))
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                threshold = max(threshold, scores[-1])
            done, step = done + len(some), 2 * step
        self.asked[self.slot[at]] = False
        docs, scores = docs[scores >= least], scores[scores >= least]
        return self.ids[docs], scores

    def _cheap(self, pivots: np.ndarray, left: int) -> bool:
        """Whether documents are scored in less time than so many entries of lists are read."""
        return OWN_COST * (self.own_end[pivots] - self.own_begin[pivots]).sum() <= left


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False), np.diff(array.offsets.to_numpy())


def _search(mean: float, k: int, groups: list[Broadcast], least: tuple[np.ndarray, np.ndarray] | None):
    """The best documents of each shard, whose rows follow one another, for each query of the groups, of scores that are not below
    ``least`` (sorted queries, scores)."""

    def found(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, sizes, lengths, terms, counts = (np.concatenate([part.pop(0) for part in held]) for _ in range(5))
        index = ShardIndex(ids, sizes, lengths, terms, counts, mean)
        del ids, sizes, lengths, terms, counts
        for group in groups:
            asked, most = group.value, None
            vars(group).pop("_value", None)  # a task holds one group at a time
            if least is not None and len(least[0]):
                at = np.minimum(np.searchsorted(least[0], asked.ids), len(least[0]) - 1)
                most = np.where(least[0][at] == asked.ids, least[1][at], 0.0)
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
            for query, docs, scores in index.search_all(asked, k, most):
                for column, values in zip(out, (np.full(len(docs), query), docs, scores), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            edges = [0, *(1 + np.flatnonzero(shard[1:] != shard[:-1])).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and shard[a] != last:
                    yield from found(held)
                    held = []
                part, last = batch.slice(a, b - a), shard[a]
                terms, lengths = _flat(part["terms"])
                counts, _ = _flat(part["counts"])
                # copies, so that the batch goes
                held.append([part["doc_id"].to_numpy().copy(), part["n_words"].to_numpy().copy(), lengths, terms.view(np.uint64).copy(), counts.astype(np.min_scalar_type(counts.max()))])
        if held:
            yield from found(held)

    return run


def _fetched(queries: DataFrame) -> Queries:
    """A group of queries, whose size is bounded."""
    found = queries.toArrow()
    terms, lengths = _flat(found["terms"])
    weights, _ = _flat(found["weights"])
    by = np.lexsort((terms.view(np.uint64), np.repeat(np.arange(len(lengths)), lengths)))
    known, term = np.unique(terms.view(np.uint64)[by], return_inverse=True)
    return Queries(found["query_id"].to_numpy(), np.append(0, np.cumsum(lengths)), known, term.astype(np.int32), weights[by])


def search(documents: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = 16_384, shard_words: int = 16_000_000, group_terms: int = 1 << 20) -> DataFrame:
    """documents(doc_id, text), queries(query_id, text) -> (query_id, rank, doc_id, score), the best first.

    A shard has about ``shard_docs`` documents or ``shard_words`` words, whichever is less; a group of queries has
    about ``group_terms`` terms (20 bytes each at most), and ``GROUPS`` of them are a job over all shards.  If there are many
    shards, some are searched first: the k-th best score there is the least that the others need to tell."""
    clean = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col("text").cast("string").cast("binary").alias("text"))
    spark = documents.sparkSession
    docs, asked = clean(documents, "doc_id"), clean(queries, "query_id")
    asked = materialize(asked.mapInArrow(_query_terms, "query_id long, term long, n long").groupBy("query_id", "term").agg(F.sum("n").alias("n")), "asked")
    passes = _filter_of(asked.select("term").distinct())
    groups = max(1, -(-asked.count() // group_terms))
    indexed = docs.mapInArrow(_postings(passes), "doc_id long, n_words int, terms array<long>, counts array<int>")
    stored = groups > GROUPS or docs.count() > SHARDS * shard_docs
    if stored:
        indexed = postings = materialize(indexed, "postings")  # read by several jobs
    partial = indexed.select("n_words", "terms").mapInArrow(_frequencies(_stored), "term long, df long, words long") if stored else docs.mapInArrow(_frequencies(_told(passes)), "term long, df long, words long")
    counted = materialize(partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "counted")
    n, words = counted.where("term is null").agg(F.sum("df"), F.sum("words")).first()
    n, words = n or 0, words or 0
    mean = max(words / max(n, 1), 1e-9)
    shards = max(1, -(-n // shard_docs), -(-words // shard_words))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ready = (
        asked.join(counted, "term").select("query_id", F.struct("term", (idf * F.col("n")).alias("weight")).alias("t"))
        .groupBy("query_id")
        .agg(F.collect_list("t").alias("t"))
        .select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part"))
    )
    ready = materialize(ready, "ready")
    free(asked, counted)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    indexed = indexed.where(F.size("terms") > 0).withColumn("shard", shard)
    rounds = [F.col("shard") % FIRST == 0, F.col("shard") % FIRST > 0] if stored and shards >= SHARDS else [F.lit(True)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = []
    for parts in (range(groups)[i : i + GROUPS] for i in range(0, groups, GROUPS)):
        held = [spark.sparkContext.broadcast(_fetched(ready.where(F.col("part") == part).select("query_id", "terms", "weights"))) for part in parts]
        before = least = None
        for some in rounds:
            dealt = indexed.where(some).repartition(tasks, "shard").sortWithinPartitions("shard")
            found = dealt.mapInArrow(_search(mean, k, held, least), "query_id long, doc_id long, score double")
            if before:
                found = found.union(before.select("query_id", "doc_id", "score"))
            found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            found = materialize(found.select("query_id", "rank", "doc_id", "score"), "found")
            if len(rounds) > 1 and not before:
                last = found.where(F.col("rank") == k).select("query_id", "score").toArrow()
                order = np.argsort(last["query_id"].to_numpy())
                least = last["query_id"].to_numpy()[order], last["score"].to_numpy()[order]
            if before:
                free(before)
            before = found
        done.append(before)
        for group in held:
            group.destroy()
    free(ready, *([postings] if stored else []))
    return spark.read.schema(done[0].schema).parquet(*(one.materialized_at for one in done))


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries).withColumn("score", F.round("score", 6))
