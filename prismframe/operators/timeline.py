"""Clip timelines: frame clocks, trims, as-of frames, timestamp repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames (or packets) and microseconds of a clip that one task orders.  Running values are carried from part to part, so a long
#: clip is spread over many tasks.
PART_FRAMES, PART_US = 1 << 16, 600_000_000


def _carried(df: DataFrame, keys: list[str], part: Column, value: Column, running) -> DataFrame:
    """``df`` with _part and _carry: ``running`` (a window aggregate) over the values of all earlier parts of its keys.

    The values are aggregated before the shuffle; what is ordered by keys is one row for each part."""
    df = df.withColumn("_part", part)
    parts = df.groupBy(*keys, "_part").agg(value.alias("_value"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(parts.select(*keys, "_part", running(F.col("_value")).over(before).alias("_carry")), [*keys, "_part"])


def _frame_part(column: str, size: int) -> Column:
    return F.coalesce(F.expr(f"floor({column} / {size}D)"), F.lit(-(2**62)))


def _by_frame() -> Window:
    return Window.partitionBy("clip_id").orderBy("frame_idx")


#: SQL of a frame's delay in whole milliseconds by container: hundredths of a second, a fraction of a second, milliseconds.
DELAY_UNITS = {"gif": "delay * 10", "apng": "delay * 1000 div greatest(denom, 1)", "webp": "delay"}


def normalize_delays(frames: DataFrame) -> DataFrame:
    """Delays below 20 ms are 100 ms."""
    return frames.selectExpr("clip_id", "frame_idx", "if(raw_us < 20000, 100000, raw_us) as delay_us")


def container_delays(frames: DataFrame) -> DataFrame:
    """frames(clip_id, frame_idx, container, delay, denom) in the units of each container -> microseconds, repaired like others."""
    ms = "case container " + " ".join(f"when '{k}' then {v}" for k, v in DELAY_UNITS.items()) + " end"
    return normalize_delays(frames.selectExpr("clip_id", "frame_idx", f"cast({ms} as long) * 1000 as raw_us"))


def frame_clock(frames: DataFrame, part_frames: int = PART_FRAMES) -> DataFrame:
    """Start and end of each frame: delays are summed within parts of a clip, and the parts' totals carried along."""
    df = _carried(frames, ["clip_id"], _frame_part("frame_idx", part_frames), F.sum("delay_us"), F.sum)
    own = F.sum("delay_us").over(Window.partitionBy("clip_id", "_part").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end_us", own + F.coalesce("_carry", F.lit(0))).selectExpr("clip_id", "frame_idx", "delay_us", "end_us - delay_us as start_us", "end_us")


def clip_totals(frames: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Duration and number of frames; with sizes(clip_id, w, h) also the bytes of all decoded frames."""
    out = frames.groupBy("clip_id").agg(F.sum("delay_us").alias("duration_us"), F.count("*").alias("frame_count"))
    if sizes is None:
        return out
    return out.join(sizes, "clip_id").selectExpr("clip_id", "duration_us", "frame_count", "frame_count * w * h * 4 as decoded_bytes")


def resolve_trim(clips: DataFrame, trims: DataFrame) -> DataFrame:
    """clips(clip_id, duration_us), trims(clip_id, start_us, end_us nullable) -> spans of at least 1 ms; ``full`` if nothing is cut.

    Clips without a trim keep their whole length; with a column ``trim_idx`` (and ``enabled``) each clip's first enabled trim counts."""
    if "trim_idx" in trims.columns:  # the first enabled one counts
        enabled = trims.where("enabled") if "enabled" in trims.columns else trims
        trims = enabled.groupBy("clip_id").agg(F.min_by(F.struct("start_us", "end_us"), "trim_idx").alias("t")).select("clip_id", "t.start_us", "t.end_us")
    df = clips.join(trims, "clip_id", "left").withColumns({"start_us": F.coalesce("start_us", F.lit(0)), "d": F.greatest("duration_us", F.lit(1000))})
    df = df.withColumn("e", F.greatest(F.least(F.coalesce("end_us", "d"), F.col("d")), F.lit(1000)))
    return df.selectExpr("clip_id", "greatest(least(start_us, e - 1000), 0) as start_us", "e as end_us", "start_us <= 0 and e = d as full")


def trim_frames(clock: DataFrame, spans: DataFrame) -> DataFrame:
    """Frames that overlap their clip's span; the first frame where none does."""
    span = spans.select("clip_id", F.col("start_us").alias("a"), F.col("end_us").alias("b"))
    df = clock.join(span, "clip_id").withColumn("hit", F.expr("end_us > a and start_us < b"))
    found = df.groupBy("clip_id").agg(F.max("hit").alias("any"))  # one row for each clip: no clip is gathered
    return df.join(found, "clip_id").where("hit or (not any and frame_idx = 0)").select("clip_id", "frame_idx", "start_us", "end_us")


def frame_asof(clock: DataFrame, ticks: DataFrame, part_us: int = PART_US) -> DataFrame:
    """ticks(clip_id, t_us) -> the latest frame that starts at or before each tick (null before the first).

    Both sides become one stream, ordered within parts of a clip's time, so a clip's frames are never paired with its ticks; the last
    frame of earlier parts is carried along."""
    both = clock.selectExpr("clip_id", "start_us as t_us", "0 as tick", "frame_idx").union(ticks.selectExpr("clip_id", "t_us", "1", "cast(null as int)"))
    latest = F.expr("max_by(frame_idx, struct(t_us, frame_idx)) filter (where frame_idx is not null)")
    both = _carried(both, ["clip_id"], _frame_part("t_us", part_us), latest, lambda v: F.last(v, ignorenulls=True))
    upto = Window.partitionBy("clip_id", "_part").orderBy("t_us", "tick", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.coalesce(F.last("frame_idx", ignorenulls=True).over(upto), "_carry")
    return both.withColumn("frame_idx", shown).where("tick = 1").select("clip_id", "t_us", "frame_idx")


def looped_ticks(ticks: DataFrame, totals: DataFrame) -> DataFrame:
    return ticks.join(totals, "clip_id").selectExpr("clip_id", "pmod(t_us, greatest(duration_us, 1)) as t_us")


def played_once(ticks: DataFrame, totals: DataFrame) -> DataFrame:
    """ticks of clips that do not loop: from the end on they stay at the last frame, before the start at the first."""
    return ticks.join(totals, "clip_id").selectExpr("clip_id", "t_us as asked_us", "least(greatest(t_us, 0L), greatest(duration_us - 1, 0L)) as t_us")


def seek_frame(clock: DataFrame, totals: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(clip_id, idx) -> the frame of that number, held within the clip, and when it starts."""
    at = wanted.join(totals, "clip_id").selectExpr("clip_id", "idx", "cast(least(greatest(idx, 0), frame_count - 1) as int) as frame_idx")
    return at.join(clock, ["clip_id", "frame_idx"]).select("clip_id", "idx", "frame_idx", "start_us")


def clip_rate(clips: DataFrame, fallback_fps: float = 24.0) -> DataFrame:
    """clips(clip_id, num, den, frame_count nullable, duration_us) -> mean frames a second (0 without a denominator) and the number
    of frames, from the duration where it is not stored."""
    count = f"if(coalesce(frame_count, 0) > 0, frame_count, cast(floor(duration_us / 1000000D * if(den <> 0 and num / den > 0, num / den, {float(fallback_fps)}D) + 0.5) as long))"
    return clips.selectExpr("clip_id", "if(den <> 0, num / cast(den as double), 0D) as fps", f"{count} as frame_count")


def to_ticks(us: str, num: str, den: str) -> str:
    """SQL: microseconds in ticks of num / den seconds, 0 without a time base."""
    return f"if(({num}) = 0 or ({den}) = 0, 0L, cast(floor(({us}) / 1000000D / (cast({num} as double) / ({den})) + 0.5) as long))"


def from_ticks(ticks: str, num: str, den: str) -> str:
    """SQL: ticks of num / den seconds in microseconds; negative ones are 0, as is all without a time base."""
    return f"if(({den}) = 0, 0L, cast(floor(greatest({ticks}, 0) * (cast({num} as double) / ({den})) * 1000000 + 0.5) as long))"


def step_frames(clock: DataFrame) -> DataFrame:
    """First, last, previous and next frame of each frame, staying at the span's edges."""
    every = Window.partitionBy("clip_id")
    return clock.select(
        "clip_id", "frame_idx", F.min("frame_idx").over(every).alias("first_idx"), F.max("frame_idx").over(every).alias("last_idx"),
        F.coalesce(F.lag("frame_idx").over(_by_frame()), "frame_idx").alias("prev_idx"), F.coalesce(F.lead("frame_idx").over(_by_frame()), "frame_idx").alias("next_idx"),
    )


def repair_pts(packets: DataFrame, start: int, end: int, part_packets: int = PART_FRAMES) -> DataFrame:
    """packets(clip_id, stream, seq, pts) kept in [start, end), rebased, strictly rising: the running
    maximum of pts - rank, plus the rank, is the least rising sequence at or above the input.

    Ranks and maxima are taken within parts of a stream; the number of packets and the maximum of earlier parts are carried along."""
    keys = ["clip_id", "stream"]
    kept = packets.where(f"pts is null or (pts >= {start} and pts < {end})").withColumn("pts", F.col("pts") - start)
    by = Window.partitionBy(*keys, "_part").orderBy("seq")
    df = kept.withColumn("_part", _frame_part("seq", part_packets)).withColumn("_n", F.row_number().over(by))
    parts = df.groupBy(*keys, "_part").agg(F.count("*").alias("_size"), F.max(F.col("pts") - F.col("_n")).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_carry", F.max(F.col("_top") - F.col("_first")).over(before))
    df = df.join(parts.select(*keys, "_part", "_first", "_carry"), [*keys, "_part"]).withColumn("_rank", F.col("_n") + F.col("_first"))
    own = F.max(F.col("pts") - F.col("_rank")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # a missing timestamp follows the one before it (-1 before the first)
    return df.withColumn("out_pts", F.coalesce(F.greatest(own, "_carry"), F.lit(-1)) + F.col("_rank")).select("clip_id", "stream", "seq", "pts", "out_pts")


def trim_packets(packets: DataFrame, start: int, end: int) -> DataFrame:
    return packets.where(f"pts < {end} and pts + dur > {start}").selectExpr("clip_id", "stream", "seq", f"greatest(pts - {start}, 0) as pts", "dur")


def latest_generation(results: DataFrame, key: str = "key", generation: str = "generation") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(generation))
    return results.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def still_frame(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frame of a kept span for a still: wanted(clip_id, idx in the whole clip), re-anchored into the span and clamped."""
    span = frames.groupBy("clip_id").agg(F.min("frame_idx").alias("first"), F.count("*").alias("n"))
    at = wanted.join(span, "clip_id").selectExpr("clip_id", "idx", "cast(first + least(greatest(idx - first, 0), n - 1) as int) as frame_idx")
    return at.join(frames, ["clip_id", "frame_idx"])


def frame_at(t: str, duration: str, n: str) -> str:
    """SQL: the frame number (0..n) of a time."""
    return f"if({duration} <= 0, 0L, least({n}, cast(floor(least(greatest({t} / {duration}, 0D), 1D) * {n} + 0.5) as long)))"


def trim_report(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """spans(clip_id, start_us, end_us) -> first and last frame number and how many are kept (never below 0)."""
    at = lambda c: frame_at(c, "duration_us", "frame_count")
    out = spans.join(totals, "clip_id").selectExpr("clip_id", "start_us", "end_us", f"{at('start_us')} as a", f"{at('end_us')} as b")
    return out.selectExpr("clip_id", "a as first_frame", "b as last_frame", "greatest(b - a, 0L) as kept", "greatest(end_us - start_us, 0L) as kept_us")


def export_progress(frames: DataFrame, spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Each kept frame's share of the frames expected in its span, at most 1 (null where none are expected)."""
    expected = spans.join(totals, "clip_id").selectExpr("clip_id", "case when full then frame_count when frame_count > 0 and duration_us > 0 then cast(floor((end_us - start_us) / duration_us * frame_count + 0.5) as long) else 0L end as expected")
    done = frames.withColumn("done", F.row_number().over(_by_frame()))
    return done.join(expected, "clip_id").selectExpr("clip_id", "frame_idx", "expected", "if(expected > 0, least(done / expected, 1D), null) as progress")


def frame_interval(fps: str) -> str:
    """SQL: seconds between frames; rates are held in 24..120, 60 where there is none."""
    return f"if({fps} <= 1, 1 / 60D, 1 / least(greatest(cast({fps} as double), 24D), 120D))"


def clip_duration(ticks: str, num: str, den: str, container_us: str) -> str:
    """SQL: microseconds of a stream's own duration if it has one, else the container's (at least 0)."""
    return f"if(({ticks}) > 0 and ({den}) <> 0, cast(floor(({ticks}) * ({num}) / ({den}) * 1000000 + 0.5) as long), greatest(coalesce({container_us}, 0L), 0L))"
