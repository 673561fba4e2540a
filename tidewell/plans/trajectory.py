"""Queries: trajectory analytics and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import js_round
from tidewell.operators import trajectory as T
from tidewell.plans.registry import query
from tidewell.plans.views import EPISODES, EVENT_FRAMES, FRAMES, LONG, episodes, event_frames, frames, r, rounded

WIDTH = 4
_long = lambda spark, d: T.long_form(frames(spark, d), WIDTH)

RANGES = LONG + """,
ranges AS (SELECT dim, CASE WHEN max(v) = min(v) THEN 1.0 ELSE max(v) - min(v) END AS motor_range, least(count(DISTINCT v), 5) AS n_unique FROM long GROUP BY dim)
"""
ACTIVE = RANGES + """,
ranked AS (SELECT episode_index, dim, abs(delta) AS a, row_number() OVER (PARTITION BY episode_index, dim ORDER BY abs(delta)) AS k,
                  count(*) OVER (PARTITION BY episode_index, dim) AS n FROM long WHERE delta IS NOT NULL),
activity AS (SELECT e.episode_index, e.dim, coalesce(p.a >= m.motor_range * 0.001, FALSE) AS active
             FROM (SELECT DISTINCT episode_index, dim FROM long) e
             LEFT JOIN (SELECT * FROM ranked WHERE k = floor(n * 0.95) + 1) p ON p.episode_index = e.episode_index AND p.dim = e.dim
             JOIN ranges m ON m.dim = e.dim)
"""
POOLED = ACTIVE + """,
pooled AS (SELECT l.dim, l.delta / m.motor_range AS x FROM long l JOIN activity a ON a.episode_index = l.episode_index AND a.dim = l.dim
           JOIN ranges m ON m.dim = l.dim JOIN (SELECT dim, bool_or(active) AS some FROM activity GROUP BY dim) s ON s.dim = l.dim
           WHERE l.delta IS NOT NULL AND (a.active OR NOT s.some))
"""
MOVEMENT = LONG + f""",
movement AS (SELECT episode_index, coalesce({r('avg(step)')}, 0) AS movement
             FROM (SELECT episode_index, frame_index, sqrt(sum(delta * delta)) AS step FROM long GROUP BY ALL) GROUP BY 1)
"""


@query("frame_delta", f"WITH {LONG} SELECT episode_index, frame_index, dim, {r('delta')} AS delta FROM long")
def frame_delta(spark, d):
    return _long(spark, d).select("episode_index", "frame_index", "dim", rounded(F.col("delta")).alias("delta"))


@query("time_bin_resample", f"""WITH {FRAMES} SELECT episode_index, bin, least(floor(bin / 49.0::DOUBLE * (n - 1) + 0.5)::BIGINT, n - 1) AS frame_index
FROM (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1), range(50) t(bin)""")
def time_bin_resample(spark, d):
    return T.time_bin_resample(frames(spark, d))


@query("cross_episode_variance", f"""WITH {FRAMES}, bins AS (
  SELECT episode_index, bin, least(floor(bin / 49.0::DOUBLE * (n - 1) + 0.5)::BIGINT, n - 1) AS frame_index
  FROM (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1), range(50) t(bin))
SELECT bin, dim, {r('CASE WHEN count(*) < 2 THEN 0 ELSE avg(v * v) - avg(v) * avg(v) END', 3)} AS variance
FROM (SELECT bin, unnest([0, 1, 2, 3]) AS dim, unnest(action) AS v FROM bins JOIN frames USING (episode_index, frame_index)) GROUP BY bin, dim""")
def cross_episode_variance(spark, d):
    return T.cross_episode_variance(frames(spark, d), WIDTH).select("bin", "dim", rounded(F.col("variance"), 3).alias("variance"))


@query("movement_scores", f"WITH {MOVEMENT} SELECT episode_index, movement FROM movement")
def movement_scores(spark, d):
    return T.movement_scores(frames(spark, d), WIDTH)


@query("low_movement", f"WITH {MOVEMENT} SELECT episode_index, movement FROM movement ORDER BY movement, episode_index LIMIT 10")
def low_movement(spark, d):
    return T.low_movement(frames(spark, d), WIDTH)


@query("speed_distribution", f"WITH {MOVEMENT} SELECT row_number() OVER (ORDER BY movement, episode_index) AS rank, movement AS speed FROM movement")
def speed_distribution(spark, d):
    return T.speed_ranks(T.movement_scores(frames(spark, d), WIDTH))


@query("motor_ranges", f"WITH {RANGES} SELECT dim, {r('motor_range')} AS motor_range, n_unique, n_unique <= 4 AS discrete FROM ranges")
def motor_ranges(spark, d):
    return T.motor_ranges(_long(spark, d)).withColumn("motor_range", rounded(F.col("motor_range")))


@query("activity_map", f"WITH {ACTIVE} SELECT episode_index, dim, active FROM activity")
def activity_map(spark, d):
    return T.activity_map(_long(spark, d))


@query("agg_velocity", f"""WITH {POOLED} SELECT dim, {r('stddev_pop(x)')} AS std, {r('max(abs(x))')} AS max_abs, {r('min(x)')} AS lo, {r('max(x)')} AS hi, count(*) AS n
FROM pooled GROUP BY dim""")
def agg_velocity(spark, d):
    out = T.agg_velocity(_long(spark, d))
    return out.select("dim", *[rounded(F.col(c)).alias(c) for c in ("std", "max_abs", "lo", "hi")], "n")


@query("velocity_histogram", f"""WITH {POOLED} SELECT dim, least(floor((x - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END / 30)), 29)::BIGINT AS bin, count(*) AS n
FROM pooled JOIN (SELECT dim, min(x) AS lo, max(x) AS hi FROM pooled GROUP BY dim) USING (dim) GROUP BY ALL""")
def velocity_histogram(spark, d):
    return T.velocity_histogram(_long(spark, d))


@query("jerky_episodes", f"""WITH {ACTIVE} SELECT l.episode_index, coalesce({r('avg(CASE WHEN active THEN abs(delta) / motor_range END)')}, 0) AS mean_abs_delta
FROM long l JOIN activity a ON a.episode_index = l.episode_index AND a.dim = l.dim JOIN ranges m ON m.dim = l.dim GROUP BY 1""")
def jerky_episodes(spark, d):
    return T.jerky_episodes(_long(spark, d)).select("episode_index", rounded(F.col("mean_abs_delta")).alias("mean_abs_delta"))


ACF = LONG + """,
sized AS (SELECT episode_index, dim, frame_index, v - avg(v) OVER (PARTITION BY episode_index, dim) AS c FROM long),
lags AS (SELECT unnest(range(1, (SELECT least(100, min(n) // 2) FROM (SELECT count(*) AS n FROM frames GROUP BY episode_index)) + 1)) AS lag),
vars AS (SELECT episode_index, dim, sum(c * c) AS var FROM sized GROUP BY ALL),
series AS (SELECT episode_index, dim, list(c ORDER BY frame_index) AS cs FROM sized GROUP BY ALL),
acf AS (SELECT dim, lag, avg(CASE WHEN var = 0 THEN 0 ELSE list_dot_product(cs[:len(cs) - lag], cs[lag + 1:]) / var END) AS acf
        FROM series JOIN vars USING (episode_index, dim), lags GROUP BY dim, lag)
"""


@query("autocorrelation", f"WITH {ACF} SELECT dim, lag, {r('acf')} AS acf FROM acf")
def autocorrelation(spark, d):
    return T.autocorrelation(frames(spark, d), WIDTH).select("dim", F.col("lag").cast("bigint").alias("lag"), rounded(F.col("acf")).alias("acf"))


@query("autocorrelation_single", f"WITH {ACF.replace('FROM lineitem', 'FROM (SELECT * FROM lineitem WHERE l_suppkey = 1)')} SELECT dim, lag, {r('acf')} AS acf FROM acf")
def autocorrelation_single(spark, d):
    one = frames(spark, d).filter("episode_index = 1")
    return T.autocorrelation(one, WIDTH).select("dim", F.col("lag").cast("bigint").alias("lag"), rounded(F.col("acf")).alias("acf"))


@query("suggested_chunk", f"""WITH {ACF} SELECT lags[len(lags) // 2 + 1] AS suggested_chunk
FROM (SELECT list(lag ORDER BY lag) AS lags FROM (SELECT dim, min(lag) AS lag FROM acf WHERE acf < 0.5 GROUP BY dim))""")
def suggested_chunk(spark, d):
    return T.suggested_chunk(T.autocorrelation(frames(spark, d), WIDTH))


ALIGNED = FRAMES + """,
steps AS (SELECT episode_index, frame_index, unnest([0, 1, 2, 3]) AS pair, unnest(list_zip(action, lag(action) OVER w, state, lag(state) OVER w)) AS z
          FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
deltas AS (SELECT episode_index, pair, frame_index, z[1] - z[2] AS a, z[3] - z[4] AS b, count(*) OVER (PARTITION BY episode_index, pair) AS n FROM steps WHERE frame_index > 0),
centred AS (SELECT episode_index, pair, list(a - am ORDER BY frame_index) AS a, list(b - bm ORDER BY frame_index) AS b
            FROM (SELECT *, avg(a) OVER e AS am, avg(b) OVER e AS bm FROM deltas WHERE n >= 9 WINDOW e AS (PARTITION BY episode_index, pair)) GROUP BY ALL),
cut AS (SELECT pair, lag, a[greatest(-lag, 0) + 1 : greatest(-lag, 0) + len(a) - abs(lag)] AS a, b[greatest(lag, 0) + 1 : greatest(lag, 0) + len(a) - abs(lag)] AS b
        FROM centred, (SELECT unnest(range(-30, 31)) AS lag) WHERE len(a) > abs(lag)),
aligned AS (SELECT pair, lag, coalesce(avg(CASE WHEN list_dot_product(a, a) * list_dot_product(b, b) > 0
            THEN list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) END), 0) AS corr FROM cut GROUP BY ALL)
"""
_PAIRS = [(k, k) for k in range(WIDTH)]


@query("state_action_alignment", f"WITH {ALIGNED} SELECT lag, {r('max(corr)')} AS max_corr, {r('avg(corr)')} AS mean_corr, {r('min(corr)')} AS min_corr FROM aligned GROUP BY lag")
def state_action_alignment(spark, d):
    out = T.alignment(frames(spark, d), _PAIRS).groupBy(F.col("lag").cast("bigint").alias("lag"))
    return out.agg(rounded(F.max("corr")).alias("max_corr"), rounded(F.avg("corr")).alias("mean_corr"), rounded(F.min("corr")).alias("min_corr"))


@query("alignment_peaks", f"""WITH {ALIGNED}, peaks AS (SELECT pair, arg_max(lag, (round(corr, 9), -lag)) AS lag FROM aligned GROUP BY pair)
SELECT min(lag) AS lag_range_min, max(lag) AS lag_range_max, count(*) AS num_pairs FROM peaks""")
def alignment_peaks(spark, d):
    peaks = T.alignment(frames(spark, d), _PAIRS).groupBy("pair").agg(F.max_by("lag", F.struct(F.round("corr", 9), -F.col("lag"))).cast("bigint").alias("lag"))
    return peaks.agg(F.min("lag").alias("lag_range_min"), F.max("lag").alias("lag_range_max"), F.count(F.lit(1)).alias("num_pairs"))


@query("alignment_single", f"WITH {ALIGNED.replace('FROM lineitem', 'FROM (SELECT * FROM lineitem WHERE l_suppkey = 1)')} SELECT pair, lag, {r('corr')} AS corr FROM aligned")
def alignment_single(spark, d):
    return T.alignment(frames(spark, d).filter("episode_index = 1"), _PAIRS).select("pair", F.col("lag").cast("bigint").alias("lag"), rounded(F.col("corr")).alias("corr"))


@query("velocity_single", f"""WITH {LONG}, one AS (SELECT * FROM long WHERE episode_index = 1)
SELECT dim, {r('stddev_pop(delta) / any_value(m)')} AS std, {r('max(abs(delta)) / any_value(m)')} AS max_abs
FROM one JOIN (SELECT dim, CASE WHEN max(v) = min(v) THEN 1.0 ELSE max(v) - min(v) END AS m FROM one GROUP BY dim) USING (dim) WHERE delta IS NOT NULL GROUP BY dim""")
def velocity_single(spark, d):
    long = T.long_form(frames(spark, d).filter("episode_index = 1"), WIDTH)
    rows = long.filter("delta IS NOT NULL").join(F.broadcast(T.motor_ranges(long)), "dim").withColumn("x", F.col("delta") / F.col("motor_range"))
    return rows.groupBy("dim").agg(rounded(F.stddev_pop("x")).alias("std"), rounded(F.max(F.abs("x"))).alias("max_abs"))


_MOTORS = ("quantity", "gripper_price", "discount", "tax")


@query("velocity_verdict", f"""WITH {POOLED}, s AS (SELECT dim, {list(_MOTORS)}[dim + 1] AS name, stddev_pop(x) AS std FROM pooled GROUP BY dim),
k AS (SELECT s.*, n_unique > 4 AND coalesce(lively, 0) = 1 AS use FROM s JOIN ranges USING (dim) JOIN (SELECT dim, max(active::INT) AS lively FROM activity GROUP BY dim) USING (dim)),
m AS (SELECT coalesce(max(std) FILTER (WHERE use), 1) AS top FROM k),
c AS (SELECT count(*) FILTER (WHERE use) AS n, count(*) FILTER (WHERE use AND std / top < 0.4) AS n_smooth, count(*) FILTER (WHERE use AND std / top >= 0.4 AND std / top < 0.7) AS n_moderate,
      count(*) FILTER (WHERE use AND std / top >= 0.7 AND name NOT ILIKE '%grip%') AS n_jerky, count(*) FILTER (WHERE use AND std / top >= 0.7 AND name ILIKE '%grip%') AS n_jerky_grippers, count(*) FILTER (WHERE NOT use) AS n_excluded FROM k, m)
SELECT CASE WHEN n = 0 THEN 'N/A' WHEN n_smooth / n >= 0.6 AND n_jerky = 0 THEN 'Smooth' WHEN n_jerky <= 2 AND n_smooth / n >= 0.3 THEN 'Moderate' ELSE 'Jerky' END AS verdict,
       n_smooth, n_moderate, n_jerky, n_jerky_grippers, n_excluded FROM c""")
def velocity_verdict(spark, d):
    names = F.get(F.array(*map(F.lit, _MOTORS)), F.col("dim"))
    return T.velocity_verdict(T.agg_velocity(_long(spark, d)).withColumn("name", names))


@query("speed_variance", f"""WITH {MOVEMENT}, s AS (SELECT avg(movement) AS mean, stddev_pop(movement) AS std, count(*) AS n, list(movement ORDER BY movement) AS xs FROM movement)
SELECT {r('mean')} AS mean, {r('std')} AS std, {r('CASE WHEN mean > 0 THEN std / mean ELSE 0 END')} AS cv, {r('xs[n // 2 + 1]')} AS median, least(30, ceil(sqrt(n)))::BIGINT AS bins,
       CASE WHEN mean = 0 OR std / mean < 0.2 THEN 'Consistent' WHEN std / mean < 0.4 THEN 'Moderate variance' ELSE 'High variance' END AS verdict FROM s""")
def speed_variance(spark, d):
    s = T.speed_variance(T.movement_scores(frames(spark, d), WIDTH))
    return s.select(*[rounded(F.col(c)).alias(c) for c in ("mean", "std", "cv", "median")], "bins", "verdict")


# sampling

_EVEN = lambda n, t, k: f"list_contains(list_transform(range({t}), lambda i: floor(i * ({n} - 1) / {t - 1}.0::DOUBLE + 0.5)::BIGINT), {k})"


@query("even_sample", f"""WITH {FRAMES} SELECT episode_index, frame_index FROM (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames)
WHERE n <= 40 OR {_EVEN('n', 40, 'frame_index')}""")
def even_sample(spark, d):
    return T.even_sample(frames(spark, d).select("episode_index", "frame_index"), 40)


@query("even_sample_by_episode", f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, {r('value')} AS value FROM (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM event_frames)
WHERE n <= 60 OR {_EVEN('n', 60, 'frame_index')}""")
def even_sample_by_episode(spark, d):
    rows = T.even_sample(event_frames(spark, d).select("episode_index", "frame_index", "value"), 60)
    return rows.withColumn("value", rounded(F.col("value")))


@query("sample_episodes", f"""WITH {EPISODES}, ranked AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS k, count(*) OVER () AS n FROM episodes)
SELECT episode_index FROM ranked WHERE n <= 120 OR {_EVEN('n', 120, 'k')}""")
def sample_episodes(spark, d):
    return T.sample_episodes(episodes(spark, d).select("episode_index"), 120)


@query("sample_2fps", f"""WITH {FRAMES}, e AS (SELECT episode_index, max(timestamp) AS last, count(*) AS n FROM frames GROUP BY 1),
targets AS (SELECT episode_index, n, unnest(range(floor(last * 2)::BIGINT + 1)) / 2.0::DOUBLE AS t FROM e),
near AS (SELECT DISTINCT episode_index, least(n - 1, ceil(t * 10 - 0.5)::BIGINT) AS frame_index FROM targets) SELECT * FROM near""")
def sample_2fps(spark, d):
    """Frames nearest to each half second; of two equally near ones the earlier."""
    e = frames(spark, d).groupBy("episode_index").agg(F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
    t = e.select("episode_index", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") * 2))).alias("h"))
    return t.select("episode_index", F.least(F.col("n") - 1, F.ceil(F.col("h") / 2 * 10 - F.lit(0.5))).alias("frame_index")).distinct()


@query("qa_frames", f"""WITH {FRAMES}, e AS (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1)
SELECT DISTINCT episode_index, round_even(i * (n - 1) / 5.0::DOUBLE, 0)::BIGINT AS frame_index FROM e, range(6) t(i)""")
def qa_frames(spark, d):
    """Six frames spread over an episode; positions are rounded half to even."""
    e = frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    return e.select("episode_index", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.rint(i * (F.col("n") - 1) / 5.0).cast("bigint")))).alias("frame_index"))


@query("sampling_gate", f"""WITH {FRAMES}, e AS (SELECT episode_index, max(timestamp) AS duration, count(*) AS n FROM frames GROUP BY 1)
SELECT episode_index, CASE WHEN duration > 120 THEN 'duration_limit' WHEN floor(duration * 2) + 1 > 240 THEN 'frame_limit' WHEN n * 110000 > 67108864 THEN 'payload_limit' ELSE 'ready' END AS gate FROM e""")
def sampling_gate(spark, d):
    return T.sampling_gate(frames(spark, d), 110_000)


@query("js_round", f"WITH {EVENT_FRAMES} SELECT event_id, floor((value - 50) * 2 + 0.5) / 2 AS x FROM event_frames")
def js_round_query(spark, d):
    return event_frames(spark, d).select("event_id", (js_round((F.col("value") - 50) * 2) / 2).alias("x"))
