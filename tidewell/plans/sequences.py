"""Queries: intervals, runs, spans, as-of and nearest joins, kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import per_episode
from tidewell.operators import sequences as S
from tidewell.operators.ranks import global_rank, of_ids
from tidewell.operators.trajectory import element
from tidewell.plans.registry import query
from tidewell.plans.views import ATOMS, EPISODES, EVENT_FRAMES, EXCLUSIONS, FRAMES, atoms, episodes, event_frames, exclusions, frames, r, rounded

MERGED = EXCLUSIONS + """,
opened AS (SELECT *, CASE WHEN start_frame > max(end_frame) OVER (PARTITION BY episode_index ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           OR row_number() OVER (PARTITION BY episode_index ORDER BY start_frame, end_frame) = 1 THEN 1 ELSE 0 END AS opens FROM exclusions),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY episode_index ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS island FROM opened),
merged AS (SELECT episode_index, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM islands GROUP BY episode_index, island)
"""
KEPT = FRAMES + "," + MERGED + """,
kept AS (SELECT f.* FROM frames f WHERE NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.episode_index = f.episode_index AND f.frame_index >= x.start_frame AND f.frame_index < x.end_frame))
"""


@query("interval_merge", f"WITH {MERGED} SELECT * FROM merged")
def interval_merge(spark, d):
    return S.merge_intervals(exclusions(spark, d))


@query("exclusion_totals", f"WITH {MERGED} SELECT count(DISTINCT episode_index) AS episodes, sum(end_frame - start_frame)::BIGINT AS frames FROM merged")
def exclusion_totals(spark, d):
    return S.merge_intervals(exclusions(spark, d)).agg(F.count_distinct("episode_index").alias("episodes"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"))


@query("retained_frames", f"WITH {KEPT} SELECT episode_index, frame_index FROM kept")
def retained_frames(spark, d):
    return S.retained_frames(frames(spark, d).select("episode_index", "frame_index"), exclusions(spark, d))


@query("kept_segments", f"""WITH {KEPT}, numbered AS (SELECT episode_index, frame_index, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS new FROM kept)
SELECT episode_index, min(frame_index) AS source_start_frame, max(frame_index) + 1 AS source_end_frame, min(new) AS output_start_frame FROM numbered GROUP BY episode_index, frame_index - new""")
def kept_segments(spark, d):
    return S.kept_segments(S.retained_frames(frames(spark, d).select("episode_index", "frame_index"), exclusions(spark, d)))


@query("clip_frames", f"""WITH {KEPT} SELECT episode_index, frame_index AS source_frame, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS frame_index,
{r('action[1]')} AS a0, {r('action[2]')} AS a1 FROM kept""")
def clip_frames(spark, d):
    rows = S.retained_frames(frames(spark, d).select("episode_index", "frame_index", "action"), exclusions(spark, d))
    new = (F.row_number().over(per_episode("frame_index")) - 1).cast("bigint")
    return rows.select("episode_index", F.col("frame_index").alias("source_frame"), new.alias("frame_index"), rounded(element(F.col("action"), 0)).alias("a0"), rounded(element(F.col("action"), 1)).alias("a1"))


@query("align_reindex", f"""WITH {KEPT}, numbered AS (SELECT episode_index, action, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS k FROM kept)
SELECT episode_index, count(*) AS length, {r('min(action[1])')} AS min_a0, {r('max(action[1])')} AS max_a0, {r('avg(action[1])')} AS mean_a0, {r('stddev_pop(action[1])')} AS std_a0,
{r('max(k) / 10.0::DOUBLE')} AS last_timestamp FROM numbered GROUP BY 1""")
def align_reindex(spark, d):
    """Statistics of the retained frames of each episode after they are numbered anew."""
    rows = S.retained_frames(frames(spark, d).select("episode_index", "frame_index", F.get("action", F.lit(0)).alias("a0")), exclusions(spark, d))
    out = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.min("a0").alias("min_a0"), F.max("a0").alias("max_a0"), F.avg("a0").alias("mean_a0"), F.stddev_pop("a0").alias("std_a0"))
    return out.select("episode_index", "length", *[rounded(F.col(c)).alias(c) for c in ("min_a0", "max_a0", "mean_a0", "std_a0")], rounded((F.col("length") - 1) / 10).alias("last_timestamp"))


@query("accepted_frames", f"""WITH {KEPT} SELECT count(*) AS frames, {r('count(*) / 10.0::DOUBLE')} AS seconds, count(DISTINCT episode_index) AS episodes FROM kept""")
def accepted_frames(spark, d):
    kept = S.retained_frames(frames(spark, d).select("episode_index", "frame_index"), exclusions(spark, d))
    return kept.agg(F.count(F.lit(1)).alias("frames"), rounded(F.count(F.lit(1)) / 10).alias("seconds"), F.count_distinct("episode_index").alias("episodes"))


@query("exclusion_update", f"""WITH {MERGED} SELECT episode_index, count(*) AS n_spans, max(end_frame) AS last_end, count(*) <> (SELECT count(*) FROM exclusions x WHERE x.episode_index = m.episode_index) AS changed
FROM merged m GROUP BY episode_index""")
def exclusion_update(spark, d):
    """Episodes whose stored intervals differ from their normal form, which drops their review."""
    x = exclusions(spark, d)
    merged = S.merge_intervals(x).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n_spans"), F.max("end_frame").alias("last_end"))
    raw = x.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    return merged.join(raw, "episode_index").select("episode_index", "n_spans", "last_end", (F.col("n") != F.col("n_spans")).alias("changed"))


# as-of and nearest

_EVENT_ATOMS = EVENT_FRAMES + """,
marks AS (SELECT episode_index, frame_index AS seq, floor(timestamp / 86400) * 86400 AS timestamp, event_type AS label, event_id FROM event_frames WHERE frame_index % 5 = 2)
"""


def _event_atoms(spark, d):
    f = event_frames(spark, d).filter("frame_index % 5 = 2")
    return f.select("episode_index", F.col("frame_index").alias("seq"), (F.floor(F.col("timestamp") / 86400) * 86400.0).alias("timestamp"), F.col("event_type").alias("label"))


@query("active_at", f"""WITH {_EVENT_ATOMS} SELECT f.episode_index, f.frame_index, (SELECT arg_max(m.label, (m.timestamp, m.seq)) FROM marks m
WHERE m.episode_index = f.episode_index AND m.timestamp <= f.timestamp) AS label FROM event_frames f""")
def active_at(spark, d):
    f = event_frames(spark, d).select("episode_index", "frame_index", "timestamp")
    return S.as_of(f, _event_atoms(spark, d), "label").drop("timestamp")


@query("robot_frame_at", f"""WITH {FRAMES}, q AS (SELECT episode_index, frame_index AS k, frame_index * 0.0625::DOUBLE AS t FROM frames)
SELECT q.episode_index, q.k, greatest(0, max(f.frame_index)) AS frame FROM q JOIN frames f ON f.episode_index = q.episode_index AND f.timestamp <= q.t + 0.00001 GROUP BY ALL""")
def robot_frame_at(spark, d):
    f = frames(spark, d).select("episode_index", "frame_index", "timestamp")
    q = f.select("episode_index", F.col("frame_index").alias("k"), (F.col("frame_index") * 0.0625).alias("timestamp"))
    marks = f.select("episode_index", "timestamp", F.col("frame_index").alias("seq"), F.col("frame_index").alias("frame"))
    return S.as_of(q, marks, "frame", tolerance=1e-5).drop("timestamp")


@query("snap_nearest", f"""WITH {EVENT_FRAMES}, q AS (SELECT episode_index, frame_index AS k, timestamp * 0.93 AS t FROM event_frames)
SELECT q.episode_index, q.k, arg_min(f.frame_index, (abs(f.timestamp - q.t), f.frame_index)) AS frame_index FROM q JOIN event_frames f USING (episode_index) GROUP BY q.episode_index, q.k""")
def snap_nearest(spark, d):
    f = event_frames(spark, d)
    q = f.select("episode_index", F.col("frame_index").alias("k"), (F.col("timestamp") * 0.93).alias("t"))
    return S.nearest_frame(q, f).drop("t")


@query("nearest_boundary", f"""WITH {FRAMES}, {MERGED}, b AS (SELECT episode_index, start_frame AS at FROM merged UNION SELECT episode_index, end_frame FROM merged), q AS (SELECT episode_index, frame_index FROM frames)
SELECT q.episode_index, q.frame_index AS frame, arg_min(b.at, (abs(b.at - q.frame_index), b.at)) AS boundary FROM q JOIN b USING (episode_index) GROUP BY ALL""")
def nearest_boundary(spark, d):
    m = S.merge_intervals(exclusions(spark, d))
    b = m.select("episode_index", F.explode(F.array("start_frame", "end_frame")).alias("frame_index")).distinct().withColumn("timestamp", F.col("frame_index").cast("double"))
    q = frames(spark, d).select("episode_index", F.col("frame_index").alias("frame"), F.col("frame_index").cast("double").alias("t"))
    return S.nearest_frame(q, b).select("episode_index", "frame", F.col("frame_index").alias("boundary")).filter("boundary IS NOT NULL")


@query("snap_transitions", f"""WITH {EPISODES}, t AS (SELECT episode_index, length, unnest([2, 3, 4, 5, 6, 7]) AS step, unnest([t2, t3, t4, t5, t6, t7]) AS frame FROM episodes WHERE length > 0)
SELECT episode_index, step, CASE WHEN frame IS NOT NULL THEN greatest(0, least(length - 1, ceil(frame * 1.25 - 0.5)::BIGINT)) END AS snapped FROM t""")
def snap_transitions(spark, d):
    """Proposed times, in frames of a clock that runs a quarter faster, as the nearest frames of the episode."""
    e = episodes(spark, d).filter("length > 0")
    t = e.select("episode_index", "length", F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"t{k}").alias("frame")) for k in range(2, 8)])))
    at = F.greatest(F.lit(0), F.least(F.col("length") - 1, F.ceil(F.col("frame") * 1.25 - F.lit(0.5))))
    return t.select("episode_index", "step", F.when(F.col("frame").isNotNull(), at).alias("snapped"))


@query("events_at", f"""WITH {EVENT_FRAMES} SELECT a.episode_index, a.frame_index, count(*) - 1 AS n_near FROM event_frames a JOIN event_frames b ON b.episode_index = a.episode_index
AND abs(trunc(b.timestamp * 1000) - trunc(a.timestamp * 1000)) <= 43200000 GROUP BY ALL""")
def events_at(spark, d):
    """Events of the episode within half a day of each; a range window in place of a band join."""
    w = per_episode((F.col("timestamp") * 1000).cast("bigint")).rangeBetween(-43_200_000, 43_200_000)
    return event_frames(spark, d).select("episode_index", "frame_index", (F.count(F.lit(1)).over(w) - 1).alias("n_near"))


@query("adjacent_episodes", f"""WITH {EPISODES} SELECT a.episode_index, b.episode_index AS neighbour FROM (SELECT episode_index, unnest([-2, -1, 1, 2]) AS off FROM episodes) a
JOIN episodes b ON b.episode_index = a.episode_index + a.off""")
def adjacent_episodes(spark, d):
    """The neighbours of every episode."""
    e = episodes(spark, d).select("episode_index")
    near = e.select("episode_index", F.explode(F.array(*[F.col("episode_index") + k for k in (-2, -1, 1, 2)])).alias("neighbour"))
    return near.join(e.select(F.col("episode_index").alias("neighbour")), "neighbour", "left_semi").select("episode_index", "neighbour")


# runs, spans, kernels

@query("value_runs", f"""WITH {FRAMES}, s AS (SELECT *, CASE WHEN lag(mode) OVER w IS DISTINCT FROM mode THEN 1 ELSE 0 END AS starts FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT episode_index, run::BIGINT AS run, min(mode) AS value, min(frame_index) AS start_frame, count(*) AS n FROM runs GROUP BY episode_index, run""")
def value_runs(spark, d):
    return S.value_runs(frames(spark, d).select("episode_index", "frame_index", "mode"), "mode")


@query("monotonic_check", f"""WITH {EVENT_FRAMES}, c AS (SELECT *, lag(timestamp) OVER (PARTITION BY episode_index ORDER BY frame_index) AS last FROM event_frames)
SELECT episode_index, count(*) AS n, bool_and(coalesce(timestamp > last, TRUE)) AS increasing, min(frame_index) = 0 AND max(frame_index) = count(*) - 1 AS contiguous FROM c GROUP BY 1""")
def monotonic_check(spark, d):
    w = per_episode("frame_index")
    c = event_frames(spark, d).withColumn("up", F.coalesce(F.col("timestamp") > F.lag("timestamp").over(w), F.lit(True)))
    n = F.count(F.lit(1))
    return c.groupBy("episode_index").agg(n.alias("n"), F.bool_and("up").alias("increasing"), ((F.min("frame_index") == 0) & (F.max("frame_index") == n - 1)).alias("contiguous"))


@query("global_offsets", f"""WITH {EPISODES} SELECT episode_index, length, coalesce(sum(length) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS from_index,
sum(length) OVER (ORDER BY episode_index ROWS UNBOUNDED PRECEDING)::BIGINT AS to_index FROM episodes""")
def global_offsets(spark, d):
    return S.global_offsets(episodes(spark, d).select("episode_index", "length"))


@query("reindex_export", f"""WITH {FRAMES}, {EPISODES}, kept AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS new FROM (SELECT DISTINCT episode_index FROM frames WHERE episode_index % 3 <> 0)),
n AS (SELECT new, k.episode_index, frame_index FROM kept k JOIN frames f ON f.episode_index = k.episode_index)
SELECT new AS episode_index, frame_index, row_number() OVER (ORDER BY new, frame_index) - 1 AS index FROM n""")
def reindex_export(spark, d):
    """Kept episodes numbered densely, and frames numbered through all of them by their episode's offset."""
    f = frames(spark, d).filter("episode_index % 3 <> 0").select("episode_index", "frame_index")
    counts = f.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    e = global_rank(S.global_offsets(counts), of_ids("episode_index"), ["episode_index"], "new")
    return f.join(e.select("episode_index", "new", "from_index"), "episode_index").select(F.col("new").alias("episode_index"), "frame_index", (F.col("from_index") + F.col("frame_index")).alias("index"))


@query("timeline_spans", f"""WITH {EPISODES}, t AS (SELECT episode_index, length, unnest([1, 2, 3, 4, 5, 6, 7]) AS step, unnest([0, t2, t3, t4, t5, t6, t7]) AS start FROM episodes
WHERE length > 0 AND 0 < t2 AND t2 < t3 AND t3 < t4 AND t4 < t5 AND t5 < t6 AND t6 < t7 AND t7 < length)
SELECT episode_index, step, start, lead(start, 1, length) OVER (PARTITION BY episode_index ORDER BY step) - start AS frames FROM t""")
def timeline_spans(spark, d):
    ok = F.expr("length > 0 AND 0 < t2 AND t2 < t3 AND t3 < t4 AND t4 < t5 AND t5 < t6 AND t6 < t7 AND t7 < length")
    marks = [F.lit(0).cast("bigint")] + [F.col(f"t{k}") for k in range(2, 8)] + [F.col("length")]
    spans = F.array(*[F.struct(F.lit(k + 1).alias("step"), marks[k].alias("start"), (marks[k + 1] - marks[k]).alias("frames")) for k in range(7)])
    return episodes(spark, d).filter(ok).select("episode_index", F.inline(spans))


_VALID = "length > 0 AND 0 < t2 AND t2 < t3 AND t3 < t4 AND t4 < t5 AND t5 < t6 AND t6 < t7 AND t7 < length"


def _phases(spark, d):
    marks = [F.lit(0).cast("bigint")] + [F.col(f"t{k}") for k in range(2, 8)] + [F.col("length")]
    phases = F.array(*[F.struct(F.lit(k + 1).alias("phase"), ((marks[k + 1] - marks[k]) / 10).alias("seconds")) for k in range(7)])
    return episodes(spark, d).filter(_VALID).select("episode_index", F.inline(phases))


PHASES = EPISODES + f""",
phases AS (SELECT episode_index, unnest([1, 2, 3, 4, 5, 6, 7]) AS phase, unnest([t2, t3 - t2, t4 - t3, t5 - t4, t6 - t5, t7 - t6, length - t7]) / 10.0::DOUBLE AS seconds FROM episodes WHERE {_VALID})
"""


@query("phase_durations", f"WITH {PHASES} SELECT episode_index, phase, {r('seconds')} AS seconds FROM phases")
def phase_durations(spark, d):
    return _phases(spark, d).withColumn("seconds", rounded(F.col("seconds")))


@query("phase_distribution", f"""WITH {PHASES} SELECT phase, count(*) AS count, {r('min(seconds)')} AS min_s, {r('quantile_cont(seconds, 0.25)')} AS p25_s, {r('quantile_cont(seconds, 0.5)')} AS median_s,
{r('quantile_cont(seconds, 0.75)')} AS p75_s, {r('max(seconds)')} AS max_s FROM phases GROUP BY phase""")
def phase_distribution(spark, d):
    p = _phases(spark, d).groupBy("phase").agg(F.count(F.lit(1)).alias("count"), F.percentile("seconds", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"))
    return p.select("phase", "count", *[rounded(F.col("q")[k]).alias(c) for k, c in enumerate(("min_s", "p25_s", "median_s", "p75_s", "max_s"))])


@query("nudge_transition", f"""WITH {EPISODES} SELECT episode_index, CASE WHEN t3 IS NOT NULL THEN greatest(coalesce(t2, 0) + 1, least(t3 + 1, coalesce(t4, length) - 1)) END AS nudged FROM episodes""")
def nudge_transition(spark, d):
    at = F.greatest(F.coalesce("t2", F.lit(0)) + 1, F.least(F.col("t3") + 1, F.coalesce("t4", "length") - 1))
    return episodes(spark, d).select("episode_index", F.when(F.col("t3").isNotNull(), at).alias("nudged"))


@query("frame_task_index", f"""WITH {EPISODES}, f AS (SELECT *, unnest(range(length)) AS frame FROM episodes WHERE {_VALID})
SELECT episode_index, frame, (t2 <= frame)::INT + (t3 <= frame)::INT + (t4 <= frame)::INT + (t5 <= frame)::INT + (t6 <= frame)::INT + (t7 <= frame)::INT AS task FROM f""")
def frame_task_index(spark, d):
    rows = episodes(spark, d).filter(_VALID).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)))
    return rows.select("episode_index", "frame", sum((F.col(f"t{k}") <= F.col("frame")).cast("int") for k in range(2, 8)).alias("task"))


@query("lane_spans", f"""WITH {ATOMS}, e AS (SELECT episode_index, max(timestamp) + 1 AS duration FROM atoms GROUP BY 1)
SELECT episode_index, style, seq, timestamp AS start, coalesce(lead(timestamp) OVER (PARTITION BY episode_index, style ORDER BY timestamp, seq), duration) AS stop
FROM atoms JOIN e USING (episode_index) WHERE style IN ('subtask', 'plan')""")
def lane_spans(spark, d):
    a = atoms(spark, d).withColumn("duration", F.max("timestamp").over(per_episode()) + 1).filter(F.col("style").isin("subtask", "plan"))
    w = Window.partitionBy("episode_index", "style").orderBy("timestamp", "seq")
    return a.select("episode_index", "style", "seq", F.col("timestamp").alias("start"), F.coalesce(F.lead("timestamp").over(w), "duration").alias("stop"))


_JOINTS = {f"j{k}": k for k in range(4)}


def _grip(spark, d):
    f = frames(spark, d)
    return S.grip_diagnostic(f, {name: element(F.col("action"), k) for name, k in _JOINTS.items()})


GRIP = FRAMES + """,
q AS (SELECT episode_index, count(*) AS n, max(timestamp) AS last, """ + ", ".join(f"quantile_cont(action[{k + 1}], 0.05) AS l{k}, quantile_cont(action[{k + 1}], 0.95) AS h{k}" for k in range(4)) + """ FROM frames GROUP BY 1),
scaled AS (SELECT f.episode_index, frame_index, timestamp, n, last, """ + ", ".join(f"(greatest(l{k}, least(h{k}, action[{k + 1}])) - l{k}) / (h{k} - l{k}) AS s{k}" for k in range(4)) + """
           FROM frames f JOIN q ON q.episode_index = f.episode_index WHERE n >= 11),
base AS (SELECT episode_index, """ + ", ".join(f"median(s{k}) AS b{k}" for k in range(4)) + """ FROM scaled WHERE timestamp < least(0.5, last) GROUP BY 1),
ap AS (SELECT s.episode_index, frame_index, n, sqrt((""" + " + ".join(f"(s{k} - b{k}) * (s{k} - b{k})" for k in range(4)) + """) / 4) AS aperture FROM scaled s JOIN base b ON b.episode_index = s.episode_index),
sm AS (SELECT *, (sum(aperture) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
       + greatest(0, 5 - frame_index) * first_value(aperture) OVER (PARTITION BY episode_index ORDER BY frame_index)
       + greatest(0, frame_index + 6 - n) * last_value(aperture) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 11 AS smoothed FROM ap),
grip AS (SELECT episode_index, frame_index, aperture, smoothed, lead(smoothed, 5) OVER w - lag(smoothed, 5) OVER w AS derivative FROM sm WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
dd AS (SELECT episode_index, frame_index, round(derivative, 9) AS d FROM grip WHERE derivative IS NOT NULL),
grasp AS (SELECT episode_index, arg_max(frame_index, (d, -frame_index)) AS grasp_frame, max(d) AS rise FROM dd GROUP BY 1),
rel AS (SELECT dd.episode_index, arg_min(frame_index, (d, frame_index)) AS release_frame, min(d) AS fall FROM dd JOIN grasp g ON g.episode_index = dd.episode_index WHERE frame_index > grasp_frame GROUP BY 1),
extrema AS (SELECT g.episode_index, grasp_frame, release_frame, CASE WHEN release_frame IS NULL THEN 'release_not_available' WHEN rise <= 0 OR fall >= 0 THEN 'invalid_derivative_sign' ELSE 'available' END AS status
            FROM grasp g LEFT JOIN rel r ON r.episode_index = g.episode_index)
"""


@query("grip_diagnostic", f"WITH {GRIP} SELECT episode_index, frame_index, {r('aperture')} AS aperture, {r('smoothed')} AS smoothed FROM grip")
def grip_diagnostic(spark, d):
    return _grip(spark, d).select("episode_index", "frame_index", rounded(F.col("aperture")).alias("aperture"), rounded(F.col("smoothed")).alias("smoothed"))


@query("grip_extrema", f"WITH {GRIP} SELECT episode_index, grasp_frame, release_frame, status FROM extrema")
def grip_extrema(spark, d):
    return S.grip_extrema(_grip(spark, d))


@query("grip_advisories", f"""WITH {GRIP} SELECT episode_index, concat_ws(',', CASE WHEN abs(grasp_frame / 10.0 - 20) > 2 THEN 'grip_grasp_disagrees_with_step_2_start' END,
CASE WHEN abs(release_frame / 10.0 - 40) > 2 THEN 'grip_release_disagrees_with_step_6_start' END) AS warnings FROM extrema WHERE status = 'available'""")
def grip_advisories(spark, d):
    e = S.grip_extrema(_grip(spark, d)).filter("status = 'available'")
    a = F.when(F.abs(F.col("grasp_frame") / 10 - 20) > 2, "grip_grasp_disagrees_with_step_2_start")
    b = F.when(F.abs(F.col("release_frame") / 10 - 40) > 2, "grip_release_disagrees_with_step_6_start")
    return e.select("episode_index", F.concat_ws(",", a, b).alias("warnings"))


PAUSES = FRAMES + """,
g AS (SELECT *, lag(mode) OVER w AS last, max(action[1]) OVER a - min(action[1]) OVER a > 20 OR max(action[3]) OVER a - min(action[3]) OVER a > 20 AS moves FROM frames
      WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index), a AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
rn AS (SELECT *, sum(CASE WHEN last IS DISTINCT FROM mode THEN 1 ELSE 0 END) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS run FROM g),
st AS (SELECT *, max(frame_index) OVER p + 1 AS stop, min(frame_index) OVER p AS head, lead(moves, 1) OVER o AS m1, lead(moves, 2) OVER o AS m2,
              bool_or(last IS NOT NULL AND ((last = 1 AND mode <> 1) OR (last <> 1 AND mode = 1))) OVER p AS sw
       FROM rn WINDOW p AS (PARTITION BY episode_index, run), o AS (PARTITION BY episode_index, run ORDER BY frame_index)),
pauses AS (SELECT episode_index, head AS start_frame, min(frame_index) AS end_frame FROM st WHERE sw AND moves AND m1 AND m2 AND frame_index + 2 <= stop - 2 GROUP BY episode_index, run, head HAVING min(frame_index) > head)
"""


def _pauses(spark, d):
    joints = [element(F.col("action"), 0), element(F.col("action"), 2)]
    return S.transition_pauses(frames(spark, d), joints, 10, move=20.0)


@query("transition_pauses", f"WITH {PAUSES} SELECT episode_index, start_frame, end_frame FROM pauses")
def transition_pauses(spark, d):
    return _pauses(spark, d)


@query("transition_filter", f"WITH {PAUSES} SELECT episode_index, count(*) AS n_pauses, sum(end_frame - start_frame)::BIGINT AS frames FROM pauses GROUP BY 1")
def transition_filter(spark, d):
    p = S.merge_intervals(_pauses(spark, d))
    return p.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n_pauses"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"))
