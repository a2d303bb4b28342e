"""Helpers shared by the training-data operators: words, hashing, materialised intermediates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.sources.shared import shared_dir

#: ASCII white space, as in the contracts' word class ``[^\x20\x09-\x0D]+``.
WORD_RE = r"[^\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives
    lost executors.  The files go with ``free`` or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    # shuffle files of finished jobs go once the driver has collected what refers to them
    jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing unfinished reads any more."""
    for one in tables:
        spark = one.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(one.materialized_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_RE), F.lit(0))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def hashed_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts in one array, and where each text begins (one more at the
    end).  ``bytes.split`` parts at exactly the contracts' white space."""
    found = [t.split() if t else [] for t in texts]
    starts = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(ws) for ws in found], out=starts[1:])
    return word_hashes([w for ws in found for w in ws]), starts


_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer; different seeds give independent-looking orders."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words (none if there are fewer words)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += mix(hashes[k : k + n], k + 1) * _ODD[k % len(_ODD)]
    return mix(out)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[list[tuple]]:
    """Python rows of Arrow batches, a few at a time so that long texts do not pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield list(zip(*(column.to_pylist() for column in part.columns), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a piece of a bit map.
PIECE = 1 << 20


def bit_map(values: DataFrame, seed: int) -> np.ndarray:
    """Bit map of hashed values (one column of longs), some 8 bits for each and never more than 16 MB.  Tasks fill pieces of it, so
    that the driver gets no more than the map."""
    (name,) = values.columns
    bits = 1 << min(27, max(16, (8 * values.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mix(batch[name].to_numpy().view(np.uint64), seed) % np.uint64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // PIECE).astype(np.int32)), pa.array((at % PIECE).astype(np.int32))], ["piece", "at"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            pieces, at = batch["piece"].to_numpy(), batch["at"].to_numpy()
            for piece in np.unique(pieces).tolist():
                own = at[pieces == piece]
                np.bitwise_or.at(held.setdefault(piece, np.zeros(PIECE // 8, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        for piece, marks in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([marks.tobytes()])], ["piece", "marks"])

    tasks = min(-(-bits // PIECE), int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = values.mapInArrow(places, "piece int, at int").repartition(tasks, "piece").mapInArrow(filled, "piece int, marks binary").toArrow()
    out = np.zeros(max(bits, PIECE) // 8, np.uint8)
    for piece, marks in zip(found["piece"].to_pylist(), found["marks"], strict=True):
        out[piece * PIECE // 8 : (piece + 1) * PIECE // 8] = np.frombuffer(marks.as_buffer(), np.uint8)
    return out[: bits // 8].copy()


def broadcast_if_small(df: DataFrame, most_bytes: int = 8_000_000) -> DataFrame:
    """``df`` (a materialised table) with a broadcast hint if its files hold at most ``most_bytes``;
    beyond that it is left to a shuffled join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most_bytes else df
