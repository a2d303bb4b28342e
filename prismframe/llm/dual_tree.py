"""Operator 12: exact ranked lexical search by two trees.

A document's coordinate for a term is its impact, (1000000000 * tf) div (1000 * tf + 12 * m); an item's is the term's weight times
its occurrences in the item; a score is their inner product, in whole numbers.  Weights, document frequencies, N and L are of
all documents.  Documents are dealt by hash over shards and ordered by their least term hashes, so that copies and alike texts are
neighbours.  Each shard builds a tree of blocks over them, whose nodes hold the largest impact of each term, the other one is a tree
over items with the largest coordinates.  The inner product of two nodes' maxima bounds every pair below them.

First each item descends greedily to a few blocks, which gives it k scores.  Then pairs of nodes are
visited from the roots: document nodes whose bound does not reach the weakest k-th score of an item node's items are pruned for all of
these items at once, the others are split on both sides.  A single item's blocks are scored exactly, best bound first.  Bounds are
sums of whole numbers in doubles (exact below 2^53), scores are summed in 64-bit integers.  The shards' best are merged exactly.

A shard's index is built once; all items pass by it in groups of ``GROUP``.  Documents are tokenised once; only terms that some item has
(a filter of at most 16 MB, then an exact match) are indexed.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, lower-cased A-Z.  Null texts have none.  Documents with a null id
count in all statistics but are not ranked; repeated ids are separate documents, and among equal scores the smaller id is first.
Equal rows of items are one item; items with one id and different texts are ranked separately; a null item id is kept.  Documents
with score 0 and items without terms have no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.llm.bm25 import _filter_of, _passing, _ranges
from prismframe.llm.common import free, materialize, mix, rows_of, table, word_hashes

#: Documents of a block, blocks of a node, items of a node's part, items searched at once.
LEAF, FAN, PARTS, GROUP = 16, 8, 4, 256
#: Nodes followed at each level by the greedy descent.
BEAM = 3
_TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ROW = "shard int, kind int, a long, b long, h long, n long, terms array<long>, values array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM).split() if text else []


def _counted(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(all terms, distinct term hashes, their counts)."""
    found = terms_of(text)
    counts = Counter(found)
    return len(found), word_hashes(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))


def _signature(terms: np.ndarray) -> tuple[int, int]:
    """The two least mixed hashes: alike sets of terms often share them."""
    least = np.sort(mix(terms, 3))[:2].view(np.int64).tolist() if len(terms) else []
    return (*least, 0, 0)[:2]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        for text, h in rows:
            _, terms, counts = _counted(text)
            a, b = _signature(terms)
            same = lambda v, n=len(terms): pa.array(np.full(n, v, np.int64))
            yield pa.RecordBatch.from_arrays([same(h), same(a), same(b), pa.array(terms.view(np.int64)), pa.array(counts)], ["h", "a", "b", "term", "n"])


def _postings(passes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            out: list[tuple] = []
            for i, text in rows:
                n, terms, counts = _counted(text)
                on = _passing(terms, passes)
                out.append((i, n, *_signature(terms), terms[on].view(np.int64), counts[on]))
            ids, sizes, a, b, terms, counts = zip(*out, strict=True)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, sizes, a, b)), pa.array(terms, many), pa.array(counts, many)], ["doc_id", "n", "a", "b", "terms", "values"])

    return run


class DocumentTree:
    """A shard's documents in order: their own impacts, and for each level the largest impact of each (term, node)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, length: int):
        m = 75 + (25 * sizes * n) // max(length, 1)
        self.ids, self.ends = ids, np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(m, lengths))
        self.terms, self.term = np.unique(terms, return_inverse=True)
        by = np.argsort(self.term, kind="stable")  # postings already stand in the documents' order
        term, node, most = self.term[by], np.repeat(np.arange(len(ids)), lengths)[by], self.impact[by]
        least, self.levels, fan = ids, [], LEAF
        while True:
            node = node // fan
            at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (node[1:] != node[:-1]))) if len(term) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(most, at) if len(at) else most
            term, node = term[at], node[at]
            least = np.minimum.reduceat(least, np.arange(0, len(least), fan)) if len(least) else least
            self.levels.append((np.searchsorted(term, np.arange(len(self.terms) + 1)), node, most.astype(float), least))
            fan = FAN
            if len(least) <= FAN:
                break
        self.weight = np.zeros(len(self.terms), np.int64)

    def places(self, terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An item's coordinates among the shard's terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), values[:0]
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        on = self.terms[at] == terms
        return at[on], values[on]

    def bounds(self, level: int, at: np.ndarray, values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The inner products of a node's coordinates with those of a level's nodes (sorted)."""
        starts, node, most, least = self.levels[level]
        places = _ranges(starts[at], starts[at + 1])
        rank = np.full(len(least), -1)
        rank[nodes] = np.arange(len(nodes))
        to, what = rank[node[places]], most[places] * np.repeat(values.astype(float), starts[at + 1] - starts[at])
        return np.bincount(to[to >= 0], what[to >= 0], len(nodes))

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of the next level down that stand under ``nodes``."""
        found = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return found[found < len(self.levels[level - 1][3])]

    def scores(self, at: np.ndarray, values: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the documents of some blocks, of those with a score."""
        docs = (blocks[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.ids)]
        self.weight[at] = values
        places = _ranges(self.begins[docs], self.ends[docs])
        sums = np.append(0, np.cumsum(self.weight[self.term[places]] * self.impact[places]))
        self.weight[at] = 0
        ends = np.cumsum(self.ends[docs] - self.begins[docs])
        found = sums[ends] - sums[ends - (self.ends[docs] - self.begins[docs])]
        return self.ids[docs][found > 0], found[found > 0]


class DualSearch:
    """The k best documents of one shard for a group of items (sorted so that alike ones are neighbours)."""

    def __init__(self, tree: DocumentTree, items: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.tree, self.k = tree, k
        self.items = [tree.places(terms, values) for terms, values in items]
        self.ids, self.best = [np.zeros(0, np.int64)] * len(items), [np.zeros(0, np.int64)] * len(items)
        self.floor = np.zeros(len(items), np.int64)  # the k-th best score so far
        self.last = np.full(len(items), -(2**63))  # and its document
        self.scored = [np.zeros(0, np.int64)] * len(items)
        self.pairs = 0

    def run(self) -> None:
        top = len(self.tree.levels) - 1
        roots = np.arange(len(self.tree.levels[top][3]))
        if not len(roots) or not self.items:
            return
        for item in range(len(self.items)):
            self._descend(item, top, roots)
        self._visit(0, len(self.items), top, roots)

    def _maxima(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if hi - lo == 1:
            return self.items[lo]
        at = np.concatenate([a for a, _ in self.items[lo:hi]])
        values = np.concatenate([v for _, v in self.items[lo:hi]])
        if not len(at):
            return at, values
        by = np.argsort(at, kind="stable")
        begins = np.flatnonzero(np.append(True, at[by][1:] != at[by][:-1]))
        return at[by][begins], np.maximum.reduceat(values[by], begins)

    def _descend(self, item: int, level: int, nodes: np.ndarray) -> None:
        at, values = self.items[item]
        while True:
            bound = self.tree.bounds(level, at, values, nodes)
            nodes = np.sort(nodes[np.argsort(-bound, kind="stable")[:BEAM]])
            if not level:
                break
            nodes, level = self.tree.below(level, nodes), level - 1
        self._score(item, nodes)

    def _score(self, item: int, blocks: np.ndarray) -> None:
        ids, scores = self.tree.scores(*self.items[item], blocks)
        self.scored[item] = np.append(self.scored[item], blocks)
        self.pairs += len(blocks) * LEAF
        ids, scores = np.append(self.ids[item], ids), np.append(self.best[item], scores)
        by = np.lexsort((ids, -scores))[: self.k]
        self.ids[item], self.best[item] = ids[by], scores[by]
        if len(by) == self.k:
            self.floor[item], self.last[item] = self.best[item][-1], self.ids[item][-1]

    def _reach(self, item: int, level: int, nodes: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a node can hold one more of the item's k best."""
        floor = self.floor[item]
        return (bound > floor) | ((bound == floor) & (floor > 0) & (self.tree.levels[level][3][nodes] < self.last[item]))

    def _visit(self, lo: int, hi: int, level: int, nodes: np.ndarray) -> None:
        bound = self.tree.bounds(level, *self._maxima(lo, hi), nodes)
        if hi - lo == 1:
            on = self._reach(lo, level, nodes, bound)
        else:
            on = bound >= max(int(self.floor[lo:hi].min()), 1)
        nodes, bound = nodes[on], bound[on]
        if not len(nodes):
            return
        if level:
            below = self.tree.below(level, nodes)
        elif hi - lo == 1:
            fresh = ~np.isin(nodes, self.scored[lo])
            nodes, bound = nodes[fresh], bound[fresh]
            order = np.argsort(-bound, kind="stable")
            nodes, bound = nodes[order], bound[order]
            step = 2
            while len(nodes):
                self._score(lo, nodes[:step])
                nodes, bound = nodes[step:], bound[step:]
                on = self._reach(lo, 0, nodes, bound)
                nodes, bound, step = nodes[on], bound[on], 2 * step
            return
        else:
            below = nodes
        size = -(-(hi - lo) // PARTS)
        for part in range(lo, hi, size):
            self._visit(part, min(part + size, hi), max(level - 1, 0), below)


def _search(n: int, length: int, k: int):
    """Rows of shards, documents (kind 0) before items (kind 1), -> (item, h, doc_id, score) of the best of each shard."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, docs, items = None, None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal tree, docs, items
            if tree is None and docs:
                parts = [(b["h"].to_numpy(), b["n"].to_numpy(), *flat(b["terms"])[::-1], flat(b["values"])[0]) for b in docs]
                ids, sizes, lengths, terms, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
                tree, docs = DocumentTree(ids, sizes, lengths, terms.view(np.uint64), counts, n, length), []
            if tree is not None and items:
                search = DualSearch(tree, [(t, v) for _, t, v in items], k)
                search.run()
                found = [(h, ids, best) for (h, _, _), ids, best in zip(items, search.ids, search.best, strict=True) if len(ids)]
                if found:
                    hs = np.repeat([h for h, _, _ in found], [len(ids) for _, ids, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(hs), *(pa.array(np.concatenate([f[c] for f in found])) for c in (1, 2))], ["h", "doc_id", "score"])
            items = []

        for batch in batches:
            shards, kinds = batch["shard"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]))).tolist() if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if shard != shards[a]:
                    yield from answers()
                    shard, tree, docs = shards[a], None, []
                if kinds[a] == 0:
                    docs.append(batch.slice(a, b - a))
                    continue
                for at in range(a, b):
                    one = batch.slice(at, 1)
                    items.append((one["h"][0].as_py(), flat(one["terms"])[0].view(np.uint64), flat(one["values"])[0]))
                    if len(items) == GROUP:
                        yield from answers()
        yield from answers()

    return run


def search(documents: DataFrame, items: DataFrame, k: int = 20, shard_docs: int = 16_384, shard_terms: int = 8_000_000) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): each item's k best documents.

    A shard has about ``shard_docs`` documents or ``shard_terms`` indexed terms, whichever is less."""
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("item_id", "text"))
    names = materialize(asked.groupBy("h", "item_id").agg(F.first("text").alias("text")), "items")
    terms = names.select(F.col("text").cast("binary").alias("text"), "h").mapInArrow(_item_rows, "h long, a long, b long, term long, n long")
    terms = materialize(terms, "terms")
    passes = _filter_of(terms.select("term").distinct())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    docs = materialize(docs.mapInArrow(_postings(passes), "doc_id long, n long, a long, b long, terms array<long>, values array<long>"), "postings")
    n, length, held = docs.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    length = length or 0
    shards = max(1, -(-n // shard_docs), -(-(held or 0) // shard_terms))
    frequency = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))) * F.col("n")
    ready = terms.join(frequency, "term").groupBy("h", "a", "b").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("value")))).alias("t"))
    ready = materialize(ready.selectExpr("h", "a", "b", "t.term as terms", "t.value as values"), "ready")
    every = ready.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "a", "b", "h", F.lit(0).cast("long").alias("n"), "terms", "values")
    here = docs.where("doc_id is not null and size(terms) > 0").select(F.pmod(F.xxhash64("doc_id", "a", "b", "n"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "a", "b", F.col("doc_id").alias("h"), "n", "terms", "values")
    dealt = here.union(every).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "a", "b", "h")
    found = materialize(dealt.mapInArrow(_search(n, length, k), "h long, doc_id long, score long"), "found")
    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    free(terms, docs, ready)
    return best.join(names.select("h", "item_id"), "h").select("item_id", "rank", "doc_id", "score")


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP12_SQL = f"""
with d as (select doc_id, unnest({_WORDS.format('text')}) as term from documents),
tf as (select doc_id, term, count(*) as tf from d group by 1, 2),
dl as (select doc_id, sum(tf) as n from tf group by 1),
st as (select count(*) as dn, sum(n)::bigint as l from dl),
df as (select term, count(*) as df from tf group by 1),
q as (select item_id, unnest({_WORDS.format('text')}) as term from benchmark),
qt as (select item_id, term, count(*) as c from q group by 1, 2),
w as (select item_id, term, c * floor(1000 * ln((2 * dn + 2)::double / (2 * df + 1)))::bigint as w from qt join df using (term), st),
m as (select doc_id, 75 + (25 * n::bigint * dn) // l as m from dl, st),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from w join tf using (term) join m using (doc_id) group by 1, 2)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0
qualify rank <= 20"""
