"""Analytics over the frames of many episodes: variance, movement, activity, velocity, autocorrelation, alignment.

Frames have ``episode_index``, ``frame_index`` (from 0, without gaps) and a vector ``action``. One shuffle by episode
serves every window here; what follows are map-side combined aggregates over (dimension), (bin) or (lag).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import element, even_position, js_round, norm, per_episode
from tidewell.functions.lineage import cut
from tidewell.operators.lags import lag_sums
from tidewell.operators.ranks import global_rank

ACTIVITY_SHARE = 0.001
DISCRETE_VALUES = 4


def long_form(frames: DataFrame, width: int, vector: str = "action") -> DataFrame:
    """``episode_index, frame_index, dim, v, delta``: a row for each dimension, with the change since the last frame.

    Changes are taken on the vectors, before they are exploded: the window sorts one row a frame, not one a dimension.
    """
    before = frames.select("episode_index", "frame_index", vector, F.lag(vector).over(per_episode("frame_index")).alias("last"))
    v = [F.struct(F.lit(k).alias("dim"), element(F.col(vector), k).alias("v"), F.when(F.col("last").isNotNull(), element(F.col(vector), k) - element(F.col("last"), k)).alias("delta")) for k in range(width)]
    return before.select("episode_index", "frame_index", F.inline(F.array(*v)))


def cross_episode_variance(frames: DataFrame, width: int, bins: int = 50) -> DataFrame:
    """``bin, dim, variance``: population variance over episodes of the frames nearest to each of ``bins`` times.

    A frame knows by arithmetic which bins it stands for, so bins are generated from frames and nothing is joined.
    """
    lengths = frames.withColumn("n", F.count(F.lit(1)).over(per_episode()))
    at = lambda b: F.floor(b / F.lit(float(bins - 1)) * (F.col("n") - 1) + F.lit(0.5))
    low = F.greatest(F.lit(0), F.floor((F.col("frame_index") - F.lit(0.5)) * F.lit(bins - 1) / F.greatest(F.col("n") - 1, F.lit(1))) - 1)
    high = F.least(F.lit(bins - 1), F.ceil((F.col("frame_index") + F.lit(0.5)) * F.lit(bins - 1) / F.greatest(F.col("n") - 1, F.lit(1))) + 1)
    near = F.when(F.col("n") == 1, F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).otherwise(F.sequence(low.cast("bigint"), F.greatest(low, high).cast("bigint")))
    mine = F.filter(near, lambda b: at(b) == F.col("frame_index"))
    rows = lengths.select(F.explode(mine).alias("bin"), "action")
    rows = rows.select("bin", F.inline(F.array(*[F.struct(F.lit(k).alias("dim"), element(F.col("action"), k).alias("v")) for k in range(width)])))
    mean = F.avg("v")
    return rows.groupBy("bin", "dim").agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.avg(F.col("v") * F.col("v")) - mean * mean).alias("variance"))


def movement_scores(frames: DataFrame, width: int) -> DataFrame:
    """``episode_index, movement``: mean length of the step between frames, to 4 digits; 0 with fewer than two frames."""
    step = norm(F.col("action"), F.lag("action").over(per_episode("frame_index")), width)
    steps = frames.select("episode_index", F.when(F.lag("action").over(per_episode("frame_index")).isNotNull(), step).alias("step"))
    return steps.groupBy("episode_index").agg(F.coalesce(js_round(F.avg("step"), 4), F.lit(0.0)).alias("movement"))


def low_movement(frames: DataFrame, width: int, k: int = 10) -> DataFrame:
    """The ``k`` episodes that move least."""
    return movement_scores(frames, width).orderBy("movement", "episode_index").limit(k)


def step_stats(long: DataFrame) -> DataFrame:
    """``episode_index, dim`` and what all figures of movement need of it, in one pass over the steps, written once.

    ``p95`` is the value at rank floor(0.95 n), counted from 0, of the n sorted step sizes. ``few`` holds the least
    distinct values, one more than a discrete dimension may have; so many tell whether there are more over all episodes.
    """
    w = Window.partitionBy("episode_index", "dim")
    size = F.abs("delta")
    rows = long.withColumn("s_k", F.row_number().over(w.orderBy(size.asc_nulls_last()))).withColumn("s_n", F.count("delta").over(w)).withColumn("s_v", F.dense_rank().over(w.orderBy("v")))
    p95 = F.max(F.when(F.col("delta").isNotNull() & (F.col("s_k") == F.floor(F.col("s_n") * 0.95) + 1), size))
    few = F.collect_set(F.when(F.col("s_v") <= DISCRETE_VALUES + 1, F.col("v")))
    return cut(rows.groupBy("episode_index", "dim").agg(
        p95.alias("p95"), F.min("v").alias("low"), F.max("v").alias("high"), few.alias("few"), F.count("delta").alias("n"), F.sum("delta").alias("total"),
        F.sum(F.col("delta") * F.col("delta")).alias("squares"), F.sum(size).alias("sizes"), F.min("delta").alias("least"), F.max("delta").alias("most"),
    ))


def _ranges(stats: DataFrame) -> DataFrame:
    out = stats.groupBy("dim").agg((F.max("high") - F.min("low")).alias("spread"))
    unique = stats.select("dim", F.explode("few").alias("v")).groupBy("dim").agg(F.least(F.count_distinct("v"), F.lit(DISCRETE_VALUES + 1)).alias("n_unique"))
    spread = F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread"))
    return out.join(unique, "dim").select("dim", spread.alias("motor_range"), "n_unique", (F.col("n_unique") <= DISCRETE_VALUES).alias("discrete"))


def motor_ranges(long: DataFrame) -> DataFrame:
    """``dim, motor_range, n_unique, discrete``: spread of each dimension (0 counts as 1) and its distinct values, to 5."""
    return _ranges(step_stats(long))


def _active(stats: DataFrame) -> DataFrame:
    out = stats.join(F.broadcast(_ranges(stats)), "dim")
    return out.withColumn("active", F.coalesce(F.col("p95") >= F.col("motor_range") * ACTIVITY_SHARE, F.lit(False)))


def activity_map(long: DataFrame) -> DataFrame:
    """``episode_index, dim, active``: whether the 95th of 100 step sizes reaches a thousandth of the dimension's range."""
    return _active(step_stats(long)).select("episode_index", "dim", "active")


def _used(stats: DataFrame) -> DataFrame:
    """Rows whose steps statistics take: those of active episodes, or all of a dimension that has none."""
    active = _active(stats)
    some = active.groupBy("dim").agg(F.max(F.col("active").cast("int")).alias("some"))
    return active.join(F.broadcast(some), "dim").filter(F.col("active") | (F.col("some") == 0))


def agg_velocity(long: DataFrame) -> DataFrame:
    """``dim, std, max_abs, lo, hi, n, inactive, discrete``: steps of each dimension in shares of its range."""
    rows = _used(step_stats(long)).groupBy("dim", "motor_range", "discrete").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("some").alias("some"),
    )
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    share = lambda c: c / F.col("motor_range")
    return rows.filter("n > 0").select(
        "dim", share(std).alias("std"), share(F.greatest(F.abs("least"), F.abs("most"))).alias("max_abs"), share(F.col("least")).alias("lo"), share(F.col("most")).alias("hi"), "n",
        (F.col("some") == 0).alias("inactive"), "discrete",
    )


def velocity_verdict(stats: DataFrame) -> DataFrame:
    """One row: ``verdict`` on how smooth the motors move, and how many of them are of each kind.

    ``stats`` has ``name, std, inactive, discrete``. Motors are held against the largest deviation of an active one that
    is not discrete: below 0.4 of it they are smooth, below 0.7 moderate, else jerky. Grippers may be jerky.
    """
    rows = stats.withColumn("use", ~F.col("inactive") & ~F.col("discrete"))
    top = rows.agg(F.coalesce(F.max(F.when(F.col("use"), F.col("std"))), F.lit(1.0)).alias("top"))
    share = F.try_divide(F.col("std"), F.col("top"))
    use, gripper = F.col("use"), F.col("name").rlike("(?i)grip")
    n = rows.crossJoin(F.broadcast(top)).agg(
        F.count_if(use).alias("n"), F.count_if(use & (share < 0.4)).alias("n_smooth"), F.count_if(use & (share >= 0.4) & (share < 0.7)).alias("n_moderate"),
        F.count_if(use & (share >= 0.7) & ~gripper).alias("n_jerky"), F.count_if(use & (share >= 0.7) & gripper).alias("n_jerky_grippers"), F.count_if(~use).alias("n_excluded"),
    )
    smooth = F.try_divide(F.col("n_smooth"), F.col("n"))
    verdict = F.when(F.col("n") == 0, "N/A").when((smooth >= 0.6) & (F.col("n_jerky") == 0), "Smooth").when((F.col("n_jerky") <= 2) & (smooth >= 0.3), "Moderate").otherwise("Jerky")
    return n.select(verdict.alias("verdict"), "n_smooth", "n_moderate", "n_jerky", "n_jerky_grippers", "n_excluded")


def speed_ranks(scores: DataFrame) -> DataFrame:
    """``rank, speed`` from 1: episodes by how much they move."""
    return global_rank(scores, F.floor("movement"), ["movement", "episode_index"]).select((F.col("rank") + 1).alias("rank"), F.col("movement").alias("speed"))


def speed_variance(scores: DataFrame) -> DataFrame:
    """``mean, std, cv, median, bins, verdict`` of the movement of episodes; the median is the upper one."""
    s = scores.agg(F.avg("movement").alias("mean"), F.stddev_pop("movement").alias("std"), F.count(F.lit(1)).alias("n"))
    middle = global_rank(scores, F.floor("movement"), ["movement", "episode_index"]).crossJoin(F.broadcast(s)).filter(F.col("rank") == F.floor(F.col("n") / 2))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    verdict = F.when(cv < 0.2, "Consistent").when(cv < 0.4, "Moderate variance").otherwise("High variance")
    return middle.select("mean", "std", cv.alias("cv"), F.col("movement").alias("median"), F.least(F.lit(30), F.ceil(F.sqrt("n"))).cast("bigint").alias("bins"), verdict.alias("verdict"))


def velocity_histogram(long: DataFrame, bins: int = 30) -> DataFrame:
    """``dim, bin, n``: steps of each dimension in ``bins`` equal bins; the last one is closed."""
    used = _used(step_stats(long))
    ends = used.groupBy("dim").agg(F.min(F.col("least") / F.col("motor_range")).alias("lo"), F.max(F.col("most") / F.col("motor_range")).alias("hi"))
    rows = long.filter("delta IS NOT NULL").join(used.select("episode_index", "dim", "motor_range"), ["episode_index", "dim"]).join(F.broadcast(ends), "dim")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) / bins
    rows = rows.select("dim", F.least(F.floor((F.col("delta") / F.col("motor_range") - F.col("lo")) / width), F.lit(bins - 1)).alias("bin"))
    return rows.groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("n"))


def jerky_episodes(long: DataFrame) -> DataFrame:
    """``episode_index, mean_abs_delta``: mean step of an episode's active dimensions in shares of their ranges."""
    rows = _active(step_stats(long))
    total = F.sum(F.when(F.col("active"), F.col("sizes") / F.col("motor_range")))
    return rows.groupBy("episode_index").agg(F.coalesce(F.try_divide(total, F.sum(F.when(F.col("active"), F.col("n")))), F.lit(0.0)).alias("mean_abs_delta"))


def _centred(values: list[Column]) -> Column:
    return F.array(*[v - F.avg(v).over(per_episode()) for v in values])


def autocorrelation(frames: DataFrame, width: int, most: int = 100) -> DataFrame:
    """``dim, lag, acf``: mean over episodes of the autocorrelation at lags 1 to min(``most``, half the shortest episode).

    An episode without variance counts with 0.
    """
    n = F.count(F.lit(1)).over(per_episode())
    rows = frames.select("episode_index", F.col("frame_index").alias("t"), n.alias("n"), _centred([element(F.col("action"), k) for k in range(width)]).alias("xs"))
    deepest = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.lit(most), F.floor(F.min("n") / 2)).alias("max_lag"))
    sums = lag_sums(rows.withColumn("ys", F.col("xs")), width, 0, most)
    own = Window.partitionBy("episode_index", "pair")
    sums = sums.withColumn("var", F.max(F.when(F.col("lag") == 0, F.col("xy"))).over(own)).crossJoin(F.broadcast(deepest))
    sums = sums.filter("max_lag >= 2 AND lag >= 1 AND lag <= max_lag")
    return sums.groupBy(F.col("pair").alias("dim"), "lag").agg(F.avg(F.coalesce(F.try_divide("xy", "var"), F.lit(0.0))).alias("acf"))


def suggested_chunk(acf: DataFrame, below: float = 0.5) -> DataFrame:
    """``suggested_chunk``: the upper median over dimensions of the first lag whose autocorrelation is under ``below``."""
    first = acf.filter(F.col("acf") < below).groupBy("dim").agg(F.min("lag").alias("lag"))
    lags = first.agg(F.array_sort(F.collect_list("lag")).alias("lags"))
    return lags.select(F.get("lags", F.floor(F.size("lags") / 2).cast("int")).cast("bigint").alias("suggested_chunk"))


def alignment(frames: DataFrame, pairs: list[tuple[int, int]], most: int = 30, least_frames: int = 10) -> DataFrame:
    """``lag, pair, corr``: correlation of action steps with state steps ``lag`` frames later, averaged over episodes.

    Steps are centred on their mean over the whole episode; the variances are those of the overlap only.
    """
    n, order = F.count(F.lit(1)).over(per_episode()), per_episode("frame_index")

    def steps(name: str, k: int) -> Column:
        v = element(F.col(name), k)
        return v - F.lag(v).over(order)

    xs, ys = [f"x{i}" for i in range(len(pairs))], [f"y{i}" for i in range(len(pairs))]
    moves = [steps("action", a).alias(x) for (a, _), x in zip(pairs, xs, strict=True)] + [steps("state", b).alias(y) for (_, b), y in zip(pairs, ys, strict=True)]
    rows = frames.select("episode_index", (F.col("frame_index") - 1).alias("t"), (n - 1).alias("n"), *moves).filter(F.col("t") >= 0).filter(F.col("n") >= least_frames - 1)
    rows = rows.select("episode_index", "t", "n", _centred([F.col(x) for x in xs]).alias("xs"), _centred([F.col(y) for y in ys]).alias("ys"))
    v = F.col("xx") * F.col("yy")
    corr = F.avg(F.when(v > 0, F.col("xy") / F.sqrt(F.when(v > 0, v))))
    return lag_sums(rows, len(pairs), -most, most).groupBy("pair", "lag").agg(F.coalesce(corr, F.lit(0.0)).alias("corr"))


def sample_episodes(episodes: DataFrame, target: int) -> DataFrame:
    """``target`` episodes at evenly spread ranks, or all if there are no more."""
    ranked = global_rank(episodes, F.floor(F.col("episode_index") / 4096), ["episode_index"], "s_k").crossJoin(F.broadcast(episodes.agg(F.count(F.lit(1)).alias("s_n"))))
    i = F.floor(F.col("s_k") * F.lit(float(target - 1)) / F.greatest(F.col("s_n") - 1, F.lit(1)) + F.lit(0.5))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((i + d).between(0, target - 1) & (even_position(i + d, F.col("s_n"), F.lit(target)) == F.col("s_k")))
    return ranked.filter((F.col("s_n") <= target) | hit).drop("s_k", "s_n")


def even_sample(frames: DataFrame, target: int, key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """Rows of each key at ``target`` evenly spread positions, or all if there are no more.

    A row keeps itself if its position is one of the targets, which arithmetic tells; no list of positions is joined.
    """
    w = Window.partitionBy(key)
    rows = frames.withColumn("s_n", F.count(F.lit(1)).over(w)).withColumn("s_k", F.row_number().over(w.orderBy(order)) - 1)
    i = F.floor(F.col("s_k") * F.lit(float(target - 1)) / F.greatest(F.col("s_n") - 1, F.lit(1)) + F.lit(0.5))
    near = [even_position(F.greatest(i + d, F.lit(0)), F.col("s_n"), F.lit(target)) == F.col("s_k") for d in (-1, 0, 1)]
    bound = [(i + d >= 0) & (i + d <= target - 1) for d in (-1, 0, 1)]
    hit = (near[0] & bound[0]) | (near[1] & bound[1]) | (near[2] & bound[2])
    return rows.filter((F.col("s_n") <= target) | hit).drop("s_n", "s_k")


def time_bin_resample(frames: DataFrame, bins: int = 50) -> DataFrame:
    """``episode_index, bin, frame_index``: the frame nearest to each of ``bins`` normalised times of an episode."""
    lengths = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    rows = lengths.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    at = F.floor(F.col("bin") / F.lit(float(bins - 1)) * (F.col("n") - 1) + F.lit(0.5)).cast("bigint")
    return rows.select("episode_index", "bin", F.least(at, F.col("n") - 1).alias("frame_index"))


def sampling_gate(frames: DataFrame, frame_bytes: int, fps: float = 2.0, seconds: float = 120.0, most: int = 240, payload: int = 64 << 20) -> DataFrame:
    """``episode_index, gate``: the first limit that an episode exceeds when it is sampled at ``fps``, or ``ready``."""
    e = frames.groupBy("episode_index").agg(F.max("timestamp").alias("duration"), F.count(F.lit(1)).alias("n"))
    gate = F.when(F.col("duration") > seconds, "duration_limit").when(F.floor(F.col("duration") * fps) + 1 > most, "frame_limit").when(F.col("n") * frame_bytes > payload, "payload_limit").otherwise("ready")
    return e.select("episode_index", gate.alias("gate"))
