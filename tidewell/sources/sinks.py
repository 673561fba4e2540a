"""Writers: language columns, clipped datasets, task files, manifests. Each refuses to overwrite unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.sequences import global_offsets, kept_segments, retained_frames


def write_frames(frames: DataFrame, path: str, chunk_size: int = 1000, overwrite: bool = False) -> None:
    """Frames by chunk of episodes, sorted by episode and frame, so that scans for an episode skip most row groups."""
    rows = frames.withColumn("chunk", F.floor(F.col("episode_index") / chunk_size))
    rows = rows.repartitionByRange("chunk", "episode_index").sortWithinPartitions("chunk", "episode_index", "frame_index")
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chunk").parquet(path)


def reindexed(frames: DataFrame) -> DataFrame:
    """``frames`` with dense episode numbers, frame numbers from 0, and ``index`` through all of them."""
    counts = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    numbers = global_offsets(counts.select("episode_index", F.lit(1).alias("length"))).select("episode_index", F.col("from_index").alias("s_new"))
    starts = global_offsets(counts).select("episode_index", F.col("from_index").alias("s_from")).join(numbers, "episode_index")
    segments = kept_segments(frames.select("episode_index", "frame_index"))
    w = segments.select("episode_index", "source_start_frame", "source_end_frame", "output_start_frame")
    rows = frames.join(starts, "episode_index").join(w, "episode_index").filter("frame_index >= source_start_frame AND frame_index < source_end_frame")
    frame = F.col("output_start_frame") + F.col("frame_index") - F.col("source_start_frame")
    others = [c for c in frames.columns if c not in ("episode_index", "frame_index", "index")]
    return rows.select(F.col("s_new").alias("episode_index"), frame.alias("frame_index"), (F.col("s_from") + frame).alias("index"), *others)


def write_clipped(frames: DataFrame, intervals: DataFrame, path: str, **options) -> None:
    """Frames outside the intervals, numbered anew."""
    write_frames(reindexed(retained_frames(frames, intervals)), path, **options)


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One compact JSON object with sorted keys a line."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    rows.select(line.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Values joined by commas, without quoting."""
    rows.select(F.concat_ws(",", *rows.columns).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)
