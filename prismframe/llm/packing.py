"""Operator 10: pack tokenised documents into sequences of bounded length, best-two-fit.

Each document is tokenised, closed by an end id and cut into pieces only where it exceeds the capacity.  Full pieces
are sequences of their own.  The others are dealt at random over shards of about ``shard_pieces``
pieces, so that a shard's distribution of lengths is the corpus's and a shard loses at most its last,
part-filled sequence against packing all at once.  Within a shard a sequence is filled greedily with
the longest unpacked piece that fits; then its smallest piece is exchanged for two unpacked pieces
that together fit the widened gap more tightly, if there are such.

Null texts are empty documents (the end id alone); null ids and other columns are carried or ignored;
repeated rows are packed each; an empty table gives no rows.  Nothing is dropped.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import materialize, rows_of, table

_TOKENIZERS: dict[str, "_WordTokenizer"] = {}
_MARKS = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
_STEM_END = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class _WordTokenizer:
    """Texts to little-endian ids, for vocabularies whose tokens never span white space, ignore case
    and end each word with a marked token.  Words and stems are tokenised once and remembered (about
    ``limit``, then all are forgotten)."""

    def __init__(self, vocabulary: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(path := vocabulary):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        found = [t.split() if t else [] for t in texts]
        known = [list(map(self.words.get, ws)) for ws in found]
        gaps = [list(compress(range(len(ids)), map(is_, ids, repeat(None)))) for ids in known]
        new = {ws[i] for ws, at in zip(found, gaps, strict=True) for i in at}
        if new:
            if len(self.words) + len(new) > self.limit:
                self.words.clear()
            self._learn(new)
            for ws, ids, at in zip(found, known, gaps, strict=True):
                for i in at:
                    ids[i] = self.words[ws[i]]
        return list(map(b"".join, known))

    def _learn(self, new: set[bytes]) -> None:
        """A word is its stem and the ASCII marks after it if the stem ends in a letter or digit: marks
        and letters are never in one token.  Only stems and runs of marks are then tokenised."""
        plain = {word for word in new if word.isalpha() and word.islower()}
        parts, odd = {}, set()
        for word in new - plain:
            stem = word.lower().rstrip(_MARKS)
            # a word that may hold a special token stays whole and keeps its case
            part = (stem, word[len(stem) :]) if stem and stem[-1] in _STEM_END and b"<|" not in word else (word, b"")
            parts[word] = part
            for one in part:
                if one and one not in self.words:
                    letters = one.isalpha() and one.islower() or (not one.isascii() and (text := one.decode()).isalpha() and text.islower())
                    (plain if letters else odd).add(one)
        plain = list(plain)
        if plain and not self._at_once(plain):
            odd.update(plain)
        if odd:
            odd = list(odd)
            for stem, one in zip(odd, self.tokenizer.encode_batch_fast([x.decode() for x in odd], add_special_tokens=False), strict=True):
                self.words[stem] = np.array(one.ids, "<u4").tobytes()
        self.words[b""] = b""
        for word, (stem, marks) in parts.items():
            self.words[word] = self.words[stem] + self.words[marks]

    def _at_once(self, plain: list[bytes]) -> bool:
        """Words of letters only, as one text: each gives tokens up to the next marked one.  False if
        the words cannot be told apart in the result."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(plain) or ends[-1] != len(ids):
            return False
        data, at = ids.tobytes(), 0
        for stem, end in zip(plain, (4 * ends).tolist(), strict=True):
            self.words[stem] = data[at:end]
            at = end
        return True


def _tokenizer(vocabulary: str) -> _WordTokenizer:
    if vocabulary not in _TOKENIZERS:
        _TOKENIZERS[vocabulary] = _WordTokenizer(vocabulary)
    return _TOKENIZERS[vocabulary]


def _pieces(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary).encode
        for rows in rows_of(batches, 128):
            out: list[list] = [[] for _ in range(6)]
            for (doc_id, _), ids in zip(rows, encode([text for _, text in rows]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(value)
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns if with_ids else columns[:-1], names if with_ids else names[:-1])

    return run


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the lengths (each below the capacity) in each bin."""
    order = np.argsort(-lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1]:
        stacks.setdefault(int(lengths[i]), []).append(int(i))
    free = mirror = 0  # bit n of free, and bit capacity - n of mirror: a piece of n tokens is unpacked
    for n in stacks:
        free |= 1 << n
        mirror |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal free, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            free ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal free, mirror
        if not stacks[n]:
            free |= 1 << n
            mirror |= 1 << (capacity - n)
        stacks[n].append(i)

    bins = []
    while free:
        gap, held = capacity, []
        while n := (free & ((2 << gap) - 1)).bit_length() - 1 if gap and free & ((2 << gap) - 1) else 0:
            held.append((n, take(n)))
            gap -= n
        small = held[-1][0]
        if gap and free:
            shortest = (free & -free).bit_length() - 1
            for total in range(gap + small, max(small, 2 * shortest - 1), -1):
                # bit a: pieces of a and of total - a tokens are both unpacked
                both = free & (mirror >> (capacity - total))
                if not total % 2 and both >> (total // 2) & 1 and len(stacks[total // 2]) < 2:
                    both ^= 1 << (total // 2)
                if both:
                    a = (both & -both).bit_length() - 1
                    two = [(n, take(n)) for n in (a, total - a)]
                    give(*held.pop())
                    held += two
                    break
        bins.append([i for _, i in held])
    return bins


def pack(
    documents: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, shard_pieces: int = 25_000, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row for each piece."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(vocabulary, capacity, end_id, with_ids), kinds), "pieces")
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    part = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))
    columns = pieces.columns[:-1]

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, held in enumerate(best_two_fit(lengths, capacity)):
            sequence[held] = k
            offset[held] = np.cumsum(lengths[held]) - lengths[held]
        sequence += np.int64(rows["shard"][0].as_py()) << 32
        return rows.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = (
        part.withColumn("shard", F.expr(f"cast(pmod(xxhash64(row), {shards}) as int)"))
        .groupBy("shard")
        .applyInArrow(fill, f"{kinds}, sequence_id long, offset long")
    )
    full = pieces.where(F.col("length") == capacity).select(*columns, (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
