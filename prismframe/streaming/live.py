"""Structured Streaming twins of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismframe.operators.timeline import frame_asof
from prismframe.sources.media import classify


def stream_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """New supported files of a folder as they arrive; contents are not kept."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(folder)
    return stream_listing(files.select("path", "length", "modificationTime"))


def stream_listing(files: DataFrame) -> DataFrame:
    """A stream of files(path, ...) -> the supported ones with their kinds."""
    return classify(files).where("supported")


def running_histogram(pixels: DataFrame) -> DataFrame:
    """Counts per image, channel and value, for update or complete mode."""
    return pixels.unpivot(["image_id"], ["r", "g", "b"], "channel", "bin").groupBy("image_id", "channel", "bin").agg(F.count("*").alias("n"))


def latest_epoch(frames: DataFrame) -> DataFrame:
    """frames(clip_id, epoch, pts): rows of an epoch older than one seen before for the clip are dropped."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        rows = pd.concat(list(parts), ignore_index=True)
        known = rows["epoch"].dropna()  # rows without an epoch belong to none and go
        newest = max(newest, int(known.max())) if len(known) else newest
        state.update((newest,))
        yield rows[rows["epoch"] == newest]

    return frames.groupBy("clip_id").applyInPandasWithState(keep, "clip_id long, epoch long, pts long", "newest long", "append", GroupStateTimeout.NoTimeout)


PRESENTED = "clip_id long, t_us long, frame_idx int"


def present(events: DataFrame) -> DataFrame:
    """A stream of frames and ticks -> (clip_id, t_us, frame_idx): the latest frame that starts at or before each tick.

    events(clip_id, epoch, tick, t_us, frame_idx): a frame that starts at t_us (``tick`` false) or a question (``tick`` true).  Ticks of
    a clip move forward from batch to batch, and a tick sees the frames of its own and of earlier batches.  The state of a clip
    is its newest epoch and the frames that later ticks can still show, those after the last tick and the one before them; the
    others are evicted as ticks pass, so a batch reads only its own rows and that state.  Frames of an epoch older than the newest seen
    are dropped, and a newer epoch empties the state.  Rows without a time are dropped."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, starts, frames = -1, np.empty(0, np.int64), np.empty(0, np.int64)
        if state.exists:
            newest, *held = state.get
            starts, frames = (np.frombuffer(bytes(h), np.int64) for h in held)
        rows = pd.concat(list(parts), ignore_index=True).dropna(subset=["t_us"])
        fresh = rows[~rows["tick"].astype(bool)].dropna(subset=["frame_idx", "epoch"])
        if len(fresh) and int(fresh["epoch"].max()) > newest:
            newest, starts, frames = int(fresh["epoch"].max()), starts[:0], frames[:0]
        fresh = fresh[fresh["epoch"] == newest]
        starts, frames = np.append(starts, fresh["t_us"].to_numpy(np.int64)), np.append(frames, fresh["frame_idx"].to_numpy(np.int64))
        by = np.lexsort((frames, starts))
        starts, frames = starts[by], frames[by]
        asked = np.sort(rows.loc[rows["tick"].astype(bool), "t_us"].to_numpy(np.int64))
        at = np.searchsorted(starts, asked, "right") - 1
        shown = pd.array([int(frames[k]) if k >= 0 else None for k in at], "Int32")
        if len(asked):
            first = max(int(at[-1]), 0)  # frames before the one shown last are passed
            starts, frames = starts[first:], frames[first:]
        state.update((newest, starts.tobytes(), frames.tobytes()))
        yield pd.DataFrame({"clip_id": np.full(len(asked), key[0]), "t_us": asked, "frame_idx": shown})

    return events.groupBy("clip_id").applyInPandasWithState(step, PRESENTED, "newest long, starts binary, frames binary", "append", GroupStateTimeout.NoTimeout)


def presented_frames(frames: DataFrame, ticks: DataFrame, folder: str, clock: str = "clip_id long, frame_idx int, start_us long") -> None:
    """frames (a stream of clip_id, frame_idx, start_us) -> in ``folder``/out, for every batch, the frame that each tick shows.

    Frames are kept as files, a folder for each batch; a batch answers the ticks of its own clips with all frames so
    far, so the answers of a clip's last batch are the final ones (``shown_frames``)."""

    def show(rows: DataFrame, batch: int) -> None:
        rows.select("clip_id", "frame_idx", "start_us").write.mode("overwrite").parquet(f"{folder}/frames/{batch}")
        spark = rows.sparkSession
        known = spark.read.schema(clock).option("recursiveFileLookup", "true").parquet(f"{folder}/frames")
        touched = spark.read.schema(clock).parquet(f"{folder}/frames/{batch}").select("clip_id").distinct()
        shown = frame_asof(known.join(touched, "clip_id", "left_semi").distinct(), ticks.join(touched, "clip_id", "left_semi"))
        shown.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/{batch}")

    frames.writeStream.foreachBatch(show).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def shown_frames(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("clip_id long, t_us long, frame_idx int, batch long").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy("clip_id", "t_us").agg(F.max_by("frame_idx", "batch").alias("frame_idx"))
