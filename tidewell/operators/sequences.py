"""Sequences within an episode: runs, spans, intervals, as-of joins and sampled kernels.

Intervals are half open, ``[start_frame, end_frame)``. Every window is over one episode in a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import per_episode


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """``episode_index, start_frame, end_frame``: the union of an episode's intervals; touching ones become one."""
    w = per_episode("start_frame", "end_frame")
    before = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("opens", F.when(before.isNull() | (F.col("start_frame") > before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("episode_index", "island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("island")


def retained_frames(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Frames outside every interval. Merged intervals are disjoint, so the last one that starts by a frame decides.

    A union and one sort by episode answer that, in place of a range join.
    """
    marks = merge_intervals(intervals).select("episode_index", F.col("start_frame").alias("frame_index"), F.col("end_frame").alias("stop"), F.lit(0).alias("kind"))
    rows = frames.withColumn("kind", F.lit(1)).withColumn("stop", F.lit(None).cast("bigint"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    last = F.last("stop", ignorenulls=True).over(per_episode("frame_index", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("stop", last).filter((F.col("kind") == 1) & (F.col("stop").isNull() | (F.col("stop") <= F.col("frame_index"))))
    return out.select(*frames.columns)


def kept_segments(kept: DataFrame) -> DataFrame:
    """``episode_index, source_start_frame, source_end_frame, output_start_frame``: runs of consecutive kept frames."""
    rows = kept.select("episode_index", "frame_index", (F.row_number().over(per_episode("frame_index")) - 1).cast("bigint").alias("new"))
    runs = rows.groupBy("episode_index", (F.col("frame_index") - F.col("new")).alias("shift"))
    return runs.agg(F.min("frame_index").alias("source_start_frame"), (F.max("frame_index") + 1).alias("source_end_frame"), F.min("new").alias("output_start_frame")).drop("shift")


def as_of(frames: DataFrame, atoms: DataFrame, value: str, by: tuple[str, ...] = ("episode_index",), tolerance: float = 0.0) -> DataFrame:
    """``frames`` with ``value`` of the latest atom whose time is at or before the frame's (give or take); later ``seq`` wins.

    A union and a running last value: one shuffle by key and one sort, whatever the number of atoms a key has.
    """
    marks = atoms.select(*by, (F.col("timestamp") - F.lit(tolerance)).alias("at"), F.lit(0).alias("kind"), "seq", F.struct(value).alias("found"))
    rows = frames.withColumn("at", F.col("timestamp")).withColumn("kind", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("at", "kind", F.coalesce("seq", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("found", F.last("found", ignorenulls=True).over(w)).filter("kind = 1")
    return out.select(*frames.columns, F.col("found")[value].alias(value))


def nearest_frame(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``points`` (with ``t``) and the ``frame_index`` nearest in time; of two equally near ones the earlier.

    The frame before and the frame behind each point come from one sort of both.
    """
    marks = frames.select("episode_index", F.col("timestamp").alias("t"), F.lit(0).alias("kind"), F.struct("timestamp", "frame_index").alias("f"))
    both = points.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = per_episode("t", "kind")
    back = F.last("f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("f", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("back", back).withColumn("ahead", ahead).filter("kind = 1")
    gap = lambda c: F.abs(F.col(c)["timestamp"] - F.col("t"))
    pick = F.when(F.col("ahead").isNull() | (gap("back") <= gap("ahead")), F.col("back")["frame_index"]).otherwise(F.col("ahead")["frame_index"])
    pick = F.when(F.col("back").isNull(), F.col("ahead")["frame_index"]).otherwise(pick)
    return out.select(*points.columns, pick.alias("frame_index"))


def value_runs(frames: DataFrame, value: str) -> DataFrame:
    """``episode_index, run, value, start_frame, n``: maximal runs of equal values, in order."""
    w = per_episode("frame_index")
    rows = frames.withColumn("starts", F.when(~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("episode_index", "run").agg(F.min(value).alias("value"), F.min("frame_index").alias("start_frame"), F.count(F.lit(1)).alias("n"))


def spans(marks: DataFrame, start: str, end: Column) -> DataFrame:
    """``marks`` with ``span_end``: where the next mark of the episode starts, or else ``end``."""
    w = per_episode(start, "seq")
    return marks.withColumn("span_end", F.coalesce(F.lead(start).over(w), end))


def transition_pauses(frames: DataFrame, joints: list[Column], fps: float, entry: int = 1, others: tuple[int, ...] = (2, 3), move: float = 0.1) -> DataFrame:
    """``episode_index, start_frame, end_frame``: pauses between a switch of mode and the onset of motion.

    A switch goes from mode ``entry`` to one of ``others`` or back. The onset is the first frame of the new run from
    which three windows in a row, each wholly in the run, see a joint move by more than ``move``.
    """
    window = max(2, round(0.2 * fps))
    w = per_episode("frame_index")
    last, mode = F.lag("mode").over(w), F.col("mode")
    switch = ((last == entry) & mode.isin(*others)) | (last.isin(*others) & (mode == entry))
    rows = frames.withColumn("changed", F.when(last.isNull() | (last != mode), 1).otherwise(0)).withColumn("switch", F.coalesce(switch, F.lit(False)))
    ahead = w.rowsBetween(0, window - 1)
    widest = reduce(F.greatest, [F.max(j).over(ahead) - F.min(j).over(ahead) for j in joints]) if len(joints) > 1 else F.max(joints[0]).over(ahead) - F.min(joints[0]).over(ahead)
    rows = rows.withColumn("moves", widest > move).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("episode_index", "run")
    rows = rows.withColumn("stop", F.max("frame_index").over(run) + 1).withColumn("head", F.min("frame_index").over(run)).withColumn("is_switch", F.max(F.col("switch").cast("int")).over(run))
    starts = run.orderBy("frame_index")
    three = F.col("moves") & F.lead("moves", 1).over(starts) & F.lead("moves", 2).over(starts) & (F.col("frame_index") + 2 <= F.col("stop") - window)
    found = rows.withColumn("three", three).filter("three AND is_switch = 1").groupBy("episode_index", "run").agg(F.min("head").alias("start_frame"), F.min("frame_index").alias("end_frame"))
    return found.filter("end_frame > start_frame").select("episode_index", "start_frame", "end_frame")


def grip_diagnostic(frames: DataFrame, joints: dict[str, Column], least_joints: int = 4) -> DataFrame:
    """``episode_index, frame_index, aperture, smoothed, derivative`` of a hand.

    Joints are clipped to their 5th and 95th percentiles and scaled; the aperture is the root mean square distance
    from the median of the first half second; it is smoothed over 11 frames, the ends repeated; the derivative is the
    difference of the smoothed values 5 frames ahead and back. Episodes with fewer usable joints give no rows.
    """
    w = per_episode("frame_index")
    rows = frames.select("episode_index", "frame_index", "timestamp", *[c.alias(k) for k, c in joints.items()])
    ends = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"), *[F.percentile(k, F.array(F.lit(0.05), F.lit(0.95))).alias(f"q_{k}") for k in joints])
    rows = rows.join(ends, "episode_index")
    usable = {k: F.col(f"q_{k}")[1] - F.col(f"q_{k}")[0] > 1e-6 for k in joints}
    scaled = [F.when(usable[k], (F.greatest(F.col(f"q_{k}")[0], F.least(F.col(f"q_{k}")[1], F.col(k))) - F.col(f"q_{k}")[0]) / (F.col(f"q_{k}")[1] - F.col(f"q_{k}")[0])).alias(k) for k in joints]
    count = reduce(lambda a, b: a + b, [u.cast("int") for u in usable.values()])
    rows = rows.select("episode_index", "frame_index", "timestamp", "n", "last", count.alias("n_usable"), *scaled).filter(F.col("n_usable") >= least_joints).filter("n >= 11")
    base = rows.filter(F.col("timestamp") < F.least(F.lit(0.5), F.col("last"))).groupBy("episode_index").agg(*[F.percentile(k, 0.5).alias(f"b_{k}") for k in joints])
    rows = rows.join(base, "episode_index")
    squares = reduce(lambda a, b: a + b, [F.coalesce((F.col(k) - F.col(f"b_{k}")) * (F.col(k) - F.col(f"b_{k}")), F.lit(0.0)) for k in joints])
    rows = rows.select("episode_index", "frame_index", "n", F.sqrt(squares / F.col("n_usable")).alias("aperture"))
    near = w.rowsBetween(-5, 5)
    first, last = F.first("aperture").over(per_episode("frame_index")), F.last("aperture").over(per_episode("frame_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    short = F.greatest(F.lit(0), 5 - F.col("frame_index")) * first + F.greatest(F.lit(0), F.col("frame_index") + 6 - F.col("n")) * last
    rows = rows.withColumn("smoothed", (F.sum("aperture").over(near) + short) / 11)
    return rows.select("episode_index", "frame_index", "aperture", "smoothed", (F.lead("smoothed", 5).over(w) - F.lag("smoothed", 5).over(w)).alias("derivative"))


def grip_extrema(diagnostic: DataFrame, digits: int = 9) -> DataFrame:
    """``episode_index, grasp_frame, release_frame, status``: the first steepest rise, and the first steepest fall behind it."""
    rows = diagnostic.filter("derivative IS NOT NULL").withColumn("d", F.round("derivative", digits))
    grasp = rows.groupBy("episode_index").agg(F.max_by("frame_index", F.struct("d", -F.col("frame_index"))).alias("grasp_frame"), F.max("d").alias("rise"))
    late = rows.join(grasp, "episode_index").filter(F.col("frame_index") > F.col("grasp_frame"))
    release = late.groupBy("episode_index").agg(F.min_by("frame_index", F.struct("d", "frame_index")).alias("release_frame"), F.min("d").alias("fall"))
    status = F.when(F.col("release_frame").isNull(), "release_not_available").when((F.col("rise") <= 0) | (F.col("fall") >= 0), "invalid_derivative_sign").otherwise("available")
    return grasp.join(release, "episode_index", "left").select("episode_index", "grasp_frame", "release_frame", status.alias("status"))


def global_offsets(episodes: DataFrame) -> DataFrame:
    """``episodes`` with ``from_index`` and ``to_index``: where each starts and ends in one sequence of all frames.

    Lengths are summed in ranges of ids first, so that no window holds more than the ranges or one range's episodes.
    """
    ranged = episodes.withColumn("s_range", F.floor(F.col("episode_index") / 4096))
    sums = ranged.groupBy("s_range").agg(F.sum("length").alias("s_sum"))
    base = sums.select("s_range", F.coalesce(F.sum("s_sum").over(Window.orderBy("s_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_base"))
    w = Window.partitionBy("s_range").orderBy("episode_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(base, "s_range").withColumn("to_index", (F.col("s_base") + F.sum("length").over(w)).cast("bigint"))
    return rows.withColumn("from_index", F.col("to_index") - F.col("length")).drop("s_range", "s_base")
