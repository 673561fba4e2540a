"""Operators on small fixtures with known results, and against independent implementations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import sources, streaming
from tidewell.functions import per_episode
from tidewell.operators import annotation, curation, lags, ranks, replies, scalars, sequences, trajectory
from tidewell.sources import sinks


def frames_of(spark, episodes, vector="action"):
    rows = [(e, k, k / 10, [float(x) for x in v]) for e, vs in episodes.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"episode_index bigint, frame_index bigint, timestamp double, {vector} array<double>")


def test_intervals_merge_and_complement(spark):
    x = spark.createDataFrame([(0, 5, 7), (0, 1, 3), (0, 2, 5), (1, 0, 2)], "episode_index bigint, start_frame bigint, end_frame bigint")
    assert sorted(map(tuple, sequences.merge_intervals(x).collect())) == [(0, 1, 7), (1, 0, 2)]
    f = frames_of(spark, {0: [[0]] * 8, 1: [[0]] * 3, 2: [[0]]}).select("episode_index", "frame_index")
    kept = sequences.retained_frames(f, x)
    assert sorted(map(tuple, kept.collect())) == [(0, 0), (0, 7), (1, 2), (2, 0)]
    assert sorted(map(tuple, sequences.kept_segments(kept).collect())) == [(0, 0, 1, 0), (0, 7, 8, 1), (1, 2, 3, 0), (2, 0, 1, 0)]


def test_prompt_counts_partition_the_retained_frames(spark):
    f = frames_of(spark, {0: [[0]] * 10}).filter("frame_index < 2 OR frame_index >= 5").select("episode_index", "frame_index", "timestamp")
    atoms = spark.createDataFrame([(0, 0, "assistant", "A", "subtask", 0.0, None), (0, 1, "assistant", "B", "subtask", 0.3, None)], "episode_index bigint, seq bigint, role string, content string, style string, timestamp double, camera string")
    assert {r["label"]: r["frames"] for r in annotation.prompt_distribution(f, atoms, 10).collect()} == {"A": 2, "B": 5}
    r = annotation.prompt_counts(f, atoms).collect()[0]
    assert r["unlabeled"] + r["ambiguous"] + r["labeled"] == r["retained"] == 7
    tie = atoms.union(spark.createDataFrame([(0, 2, "assistant", "C", "subtask", 0.3, None)], atoms.schema))
    assert annotation.prompt_counts(f, tie).collect()[0]["ambiguous"] == 5


@pytest.mark.parametrize(
    ("modes", "moves", "fps", "expected"),
    [
        ([1] * 5 + [3] * 35, lambda k: 0.2 if k >= 25 else 0.0, 50, [(5, 16)]),
        ([1] * 3 + [3] * 27, lambda k: 0.2 if k >= 15 else 0.0, 30, [(3, 10)]),
        ([2] * 5 + [3] * 35, lambda k: 0.2 if k >= 25 else 0.0, 50, []),
        ([1] * 3 + [3] * 8 + [1] * 19, lambda k: 1.0 if 3 <= k <= 10 else 0.0, 50, []),
    ],
)
def test_transition_pauses(spark, modes, moves, fps, expected):
    rows = [(0, k, m, moves(k)) for k, m in enumerate(modes)]
    df = spark.createDataFrame(rows, "episode_index bigint, frame_index bigint, mode int, j double")
    got = sequences.transition_pauses(df, [F.col("j")], fps)
    assert [(r["start_frame"], r["end_frame"]) for r in got.collect()] == expected


def ranked(values, share):
    """The value at a share of the ranks, between two neighbours in proportion."""
    xs = sorted(values)
    at = share * (len(xs) - 1)
    low = int(at)
    return xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low])


def grip_by_hand(joints, last):
    """Aperture and smoothed aperture, frame by frame, of joints given as lists at ten frames a second."""
    scaled = []
    for xs in joints:
        low, high = ranked(xs, 0.05), ranked(xs, 0.95)
        if high - low > 1e-6:
            scaled.append([(min(high, max(low, x)) - low) / (high - low) for x in xs])
    rest = [ranked([xs[f] for f in range(len(xs)) if f / 10 < min(0.5, last)], 0.5) for xs in scaled]
    n = len(joints[0])
    aperture = [(sum((xs[f] - r) ** 2 for xs, r in zip(scaled, rest, strict=True)) / len(scaled)) ** 0.5 for f in range(n)]
    smoothed = [sum(aperture[min(n - 1, max(0, f + k))] for k in range(-5, 6)) / 11 for f in range(n)]
    return aperture, smoothed


def test_grip_diagnostic(spark):
    """A hand that closes over frames 12 to 22 and opens over 39 to 49: it moves fastest in the middle of either."""
    shape = [max(0.0, min(1.0, (f - 11) / 11, (50 - f) / 11)) for f in range(61)]
    joints = [[x * (0.7 + 0.1 * k) for x in shape] for k in range(7)]
    df = frames_of(spark, {4: [list(v) for v in zip(*joints, strict=True)]})
    diagnostic = sequences.grip_diagnostic(df, {f"j{k}": F.col("action")[k] for k in range(7)})
    rows = diagnostic.orderBy("frame_index").collect()
    aperture, smoothed = grip_by_hand(joints, 6.0)
    assert [r["aperture"] for r in rows] == pytest.approx(aperture) and [r["smoothed"] for r in rows] == pytest.approx(smoothed)
    assert tuple(sequences.grip_extrema(diagnostic).first())[1:] == (16, 44, "available")
    assert sequences.grip_diagnostic(df, {"j0": F.col("action")[0]}).count() == 0


def test_variance_autocorrelation_and_alignment_match_numpy(spark):
    rng = np.random.default_rng(2)
    eps = {e: rng.normal(size=(n, 2)).cumsum(axis=0) for e, n in enumerate((24, 31, 40))}
    df = frames_of(spark, {e: v.tolist() for e, v in eps.items()})
    got = {(r["bin"], r["dim"]): r["variance"] for r in trajectory.cross_episode_variance(df, 2, 50).collect()}
    for b in range(50):
        rows = np.array([v[min(int(np.floor(b / 49 * (len(v) - 1) + 0.5)), len(v) - 1)] for v in eps.values()])
        for k in range(2):
            assert got[b, k] == pytest.approx((rows[:, k] ** 2).mean() - rows[:, k].mean() ** 2)
    acf = {(r["dim"], r["lag"]): r["acf"] for r in trajectory.autocorrelation(df, 2).collect()}
    assert max(lag for _, lag in acf) == 12
    for (k, lag), v in acf.items():
        each = []
        for x in eps.values():
            c = x[:, k] - x[:, k].mean()
            each.append((c[:-lag] * c[lag:]).sum() / (c * c).sum())
        assert v == pytest.approx(np.mean(each))
    shifted = df.withColumn("state", F.coalesce(F.lag("action", 3).over(per_episode("frame_index")), F.array(F.lit(0.0), F.lit(0.0))))
    peak = trajectory.alignment(shifted, [(0, 0)]).orderBy(F.col("corr").desc()).first()
    assert peak["lag"] == 3


def test_activity_takes_the_ranked_step(spark):
    values = [[0.0]] * 19 + [[1.0]] + [[1.0]]
    long = trajectory.long_form(frames_of(spark, {0: values}), 1)
    steps = sorted(abs(b[0] - a[0]) for a, b in zip(values, values[1:], strict=False))
    expected = steps[int(len(steps) * 0.95)] >= 0.001
    assert trajectory.activity_map(long).collect()[0]["active"] == expected


def test_even_sample_equals_its_rule(spark):
    df = frames_of(spark, {e: [[0]] * n for e, n in enumerate((1, 2, 7, 10, 11, 23, 100))})
    got = {}
    for r in trajectory.even_sample(df, 10).collect():
        got.setdefault(r["episode_index"], set()).add(r["frame_index"])
    for e, n in enumerate((1, 2, 7, 10, 11, 23, 100)):
        want = set(range(n)) if n <= 10 else {int(np.floor(i * (n - 1) / 9 + 0.5)) for i in range(10)}
        assert got[e] == want


def test_as_of_and_nearest_ties(spark):
    f = frames_of(spark, {0: [[0]] * 5}).select("episode_index", "frame_index", "timestamp")
    marks = spark.createDataFrame([(0, 0, 0.1, "a"), (0, 1, 0.1, "b"), (0, 2, 0.35, "c")], "episode_index bigint, seq bigint, timestamp double, v string")
    assert [r["v"] for r in sequences.as_of(f, marks, "v").orderBy("frame_index").collect()] == [None, "b", "b", "b", "c"]
    points = spark.createDataFrame([(0, 0.25), (0, -3.0), (0, 9.0)], "episode_index bigint, t double")
    half = f.withColumn("timestamp", F.col("frame_index") / 2)
    assert {r["t"]: r["frame_index"] for r in sequences.nearest_frame(points, half).collect()} == {0.25: 0, -3.0: 0, 9.0: 4}


def test_boundary_errors(spark):
    rows = [(0, 0, "draft", 1, 2, 3, 4, 5, 6), (1, 50, "draft", 1, 2, 2, 4, 3, 60), (2, 50, "pending", 9, 8, 7, 6, 5, 4), (3, 50, "approved_keep", None, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "episode_index bigint, length bigint, review_state string, " + ", ".join(f"{c} bigint" for c in curation.STEPS))
    got = sorted((r["episode_index"], r["code"], r["step"]) for r in curation.boundary_errors(df).collect() if r["step"] is not None)
    codes = {e: sorted(r["code"] for r in curation.boundary_errors(df).collect() if r["episode_index"] == e) for e in range(4)}
    assert got == [(1, "non_increasing_transitions", 4), (1, "non_increasing_transitions", 6), (1, "zero_length_phase", 4)]
    assert codes[0] == ["incomplete_coverage", "zero_length_episode"] and codes[2] == [] and codes[3] == ["incomplete_coverage", "out_of_range_transition"]
    assert "incomplete_coverage" in codes[1] and "out_of_range_transition" in codes[1]


def test_closure_leaves_cycles_out(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (8, 9), (9, 8)], "child bigint, parent bigint")
    assert sorted(map(tuple, curation.closure(edges).collect())) == [(2, 1, 1), (3, 1, 2), (4, 1, 3)]


def test_closure_of_a_long_chain(spark):
    edges = [(k + 1, k) for k in range(1000)] + [(5001, 5002), (5002, 5001), (5003, 5001)]
    got = {r["child"]: (r["root"], r["depth"]) for r in curation.closure(spark.createDataFrame(edges, "child bigint, parent bigint")).collect()}
    assert got == {k: (0, k) for k in range(1, 1001)}


def test_updates_by_revision(spark):
    state = spark.createDataFrame([(1, 4, "draft", "x"), (2, 0, "pending", "y"), (3, 7, "draft", "z")], "k bigint, revision bigint, state string, other string")
    updates = spark.createDataFrame([(1, 4, "approved", 10), (1, 4, "rejected", 11), (2, 1, "draft", 12), (9, 0, "draft", 13), (3, 6, "a", 14), (3, 7, "b", 15)], "k bigint, expected bigint, state string, at bigint")
    after, tried = curation.compare_and_set(state, updates, "k", ["state"], ["at"])
    assert sorted(map(tuple, after.collect())) == [(1, 5, "approved", "x"), (2, 0, "pending", "y"), (3, 8, "b", "z")]
    assert {r["at"]: r["outcome"] for r in tried.collect()} == {10: "updated", 11: "stale", 12: "stale", 13: "missing", 14: "stale", 15: "updated"}


def worker_tables(spark):
    import datetime as dt

    soon, gone = dt.datetime(2026, 1, 1, 0, 3), dt.datetime(2025, 12, 31)
    jobs = [(1, "w", "running", soon), (2, "w", "running", gone), (3, "v", "running", soon), (4, "w", "cancel_requested", soon), (5, "w", "completed", soon), (6, "w", "running", soon), (7, "w", "running", soon), (8, "w", "running", soon)]
    tries = [(1, 10, 5, 0, "queued", None), (1, 11, 2, 1, "retryable", None), (1, 12, 2, 0, "retryable", None), (2, 20, 1, 0, "queued", None), (3, 30, 1, 0, "succeeded", None), (4, 40, 1, 0, "manual_only", None)]
    tries += [(6, 60, 1, 0, "leased", gone), (6, 61, 0, 0, "succeeded", None), (7, 70, 1, 0, "requesting", soon), (7, 71, 0, 0, "queued", None), (8, 80, 0, 0, "manual_only", None), (8, 81, 1, 0, "succeeded", None)]
    now = F.lit(dt.datetime(2026, 1, 1))
    return spark.createDataFrame(jobs, "job bigint, owner string, state string, lease_expires_at timestamp"), spark.createDataFrame(tries, "job bigint, id bigint, episode bigint, attempt_number bigint, state string, lease_expires_at timestamp"), now


def test_claims_and_ends_of_jobs(spark):
    """Order by episode, attempt, id; an expired lease is free again; a live one, a lost job and a cancelled one give nothing."""
    jobs, tries, now = worker_tables(spark)
    assert {r["job"]: r["attempt"] for r in curation.claim_next(jobs, tries, now).collect()} == {1: 12, 6: 60}
    ends = {r["job"]: r["status"] for r in curation.finalize_jobs(jobs, tries, F.lit("w"), now).collect()}
    assert ends == {1: "open", 2: "lost", 3: "lost", 4: "open", 5: "lost", 6: "open", 7: "open", 8: "completed_with_failures"}
    states = {r["job"]: (r["state"], r["error"] is None) for r in curation.recover_jobs(jobs).collect()}
    assert states[1] == ("interrupted", False) and states[4] == ("cancel_requested", True) and states[5] == ("completed", True)


def test_reviews_stand_for_current_digests(spark):
    rows = [(1, "t", "a", "a", "x", "x"), (2, "t", "a", "b", "x", "x"), (3, None, "a", "a", "x", "x"), (4, "t", "a", "a", "none", None), (5, "t", "a", "a", "x", None)]
    df = spark.createDataFrame([(*r, "none") for r in rows], "k int, reviewed_at string, annotations string, reviewed_annotations string, exclusions string, reviewed_exclusions string, no_exclusions string")
    assert {r["k"]: r["status"] for r in curation.review_status(df).collect()} == {1: "reviewed", 2: "unreviewed", 3: "unreviewed", 4: "reviewed", 5: "unreviewed"}


def test_replies_are_parsed_strictly(spark):
    cases = {
        '  {"a": 1}\n': "ok", "<think>why {</think>\n{}": "ok", "<think>{}": "unterminated_think", '{"a":1}{"b":2}': "trailing_text", "{} x": "trailing_text", "{bad}": "invalid_json", "": "invalid_json",
        '{"a":{"b":1,"b":1}}': "duplicate_member", '{"a":Infinity}': "nonfinite_number", "[{}]": "not_an_object", '"x"': "not_an_object", "x<think></think>{}": "invalid_json", "[" * 100_000: "too_deep",
    }
    df = spark.createDataFrame([*[(k,) for k in cases], (None,)], "t string")
    got = {r["t"]: r["p"]["status"] for r in df.select("t", replies.parse_reply("t").alias("p")).collect()}
    assert got == cases | {None: "missing"}


def test_contract_of_segments(spark):
    def reply(times, status=None, complete=True, missing=(), doubts=(), duration=70.0):
        return (duration, complete, list(missing), list(doubts), [(k + 1, (status or {}).get(k + 1, "completed"), a, b, 0.5) for k, (a, b) in enumerate(times)])

    good = [(10.0 * k, 10.0 * k + 10) for k in range(7)]
    change = lambda k, t: [*good[:k], t, *good[k + 1 :]]
    cases = [
        (reply(good), []), (reply(good, duration=70.4), []), (reply(good, duration=71.0), ["early_end"]), (reply(good, duration=float("nan")), ["duration"]),
        (reply(change(0, (0.3, 10.0))), ["late_start"]), (reply(change(2, (20.6, 30.0))), ["not_adjacent:2-3"]), (reply(change(2, (31.0, 30.0)))[0:5], ["out_of_bounds:3", "starts_not_rising", "not_adjacent:2-3"]),
        (reply(change(3, (None, None)), {4: "not_observed"}), ["missing_steps", "episode_complete", "no_uncertainty"]),
        (reply(change(3, (None, None)), {4: "not_observed"}, False, [4], ["hand hidden"]), []),
        (reply(change(3, (30.0, 35.0)), {4: "partial"}, False, [4], ["hand hidden"]), []),
        (reply(change(3, (30.0, float("inf")))), ["not_finite:4"]), (reply(good, complete=False), ["episode_complete"]),
    ]
    schema = "duration double, episode_complete boolean, missing_steps array<int>, uncertainties array<string>, segments array<struct<step:int,status:string,start_s:double,end_s:double,confidence:double>>"
    df = spark.createDataFrame([(k, *row) for k, (row, _) in enumerate(cases)], f"k int, {schema}")
    got = {r["k"]: sorted(r["errors"]) for r in replies.contract_errors(df).collect()}
    for k, (row, want) in enumerate(cases):
        assert got[k] == sorted([*want, "out_of_bounds:7"] if row[0] != row[0] else want) or (row[0] != row[0] and "duration" in got[k]), k


def test_fields_that_errors_allow_to_repair(spark):
    start, end = [0.0, 5.0, -1.0, 9.0, None, 1.0, 2.0], [1.0, 4.0, 4.0, 99.0, None, 2.0, 3.0]
    bounds = "step {} must satisfy 0 <= start_s < end_s <= duration_s 10.0"
    cases = {bounds.format(2): ([], [2]), bounds.format(3): ([3], []), bounds.format(4): ([], [4]), bounds.format(5): ([5], [5]), "complete steps 2 and 3 must be adjacent within 0.5 seconds": ([3], [2]), "other": ([], [])}
    df = spark.createDataFrame([(k, start, end) for k in cases], "e string, s array<double>, t array<double>")
    got = {r["e"]: (r["f"]["starts"], r["f"]["ends"]) for r in df.select("e", replies.repair_fields(F.col("e"), F.col("s"), F.col("t"), F.lit(10.0)).alias("f")).collect()}
    assert got == cases


def test_names_secrets_and_answers(spark):
    names = {"set-1.0_b": True, "a": True, "-a": False, "a b": False, "a..b": False, "x" * 80: True, "x" * 81: False, "frozen": False, "manifest.json": False, "ab\n": False, "": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["v"] for r in df.select("n", replies.valid_name(F.col("n")).alias("v")).collect()} == names
    text = spark.sql("SELECT 'key abc and abcdef' AS t").select(replies.redact(F.col("t"), F.array(F.lit("abc"), F.lit("abcdef"), F.lit("")))).first()[0]
    assert text == "key [REDACTED] and [REDACTED]"
    assert replies.redact_deep({"a": ["xabc", 1, {"b": "abcdef"}]}, ["abc", "abcdef"]) == {"a": ["x[REDACTED]", 1, {"b": "[REDACTED]"}]}
    kinds = {'{"point_format":"","point":[1]}': None, '{"point_format":"xy","point":[1]}': "keypoint", '{"count":2.5,"label":"x"}': "count", '{"attribute":"a","value":0}': "attribute", '{"detections":[],"count":1}': "bbox", "3": None}
    df = spark.createDataFrame([(n,) for n in kinds], "n string")
    assert {r["n"]: r["k"] for r in df.select("n", replies.answer_kind(F.col("n")).alias("k")).collect()} == kinds


def test_units_colors_and_times(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.to_radians(F.lit(2048.0), F.lit(4000.0))) == 0 and one(scalars.to_radians(F.lit(3072.0), F.lit(4000.0))) == pytest.approx(np.pi / 2)
    assert one(scalars.to_radians(F.lit(180.0), F.lit(180.0))) == pytest.approx(np.pi) and one(scalars.to_radians(F.lit(3.0), F.lit(3.0))) == 3
    assert [one(scalars.color_slot(F.lit(t))) for t in (-1.0, 0.0, 0.0019, 0.002, 0.5, 1.0, 9.0)] == [0, 0, 0, 1, 128, 255, 255]
    assert one(scalars.color(F.lit(0.9), [(0, 0, 0), (9, 8, 7)])) == [9, 8, 7]
    assert [one(scalars.total_time(F.lit(n), F.lit(30))) for n in (30 * 59, 30 * 61, 30 * 3600, 30 * 7325)] == ["0m", "1m", "1h 0m", "2h 2m"]


def test_verdicts_on_velocity_and_speed(spark):
    def verdict(*rows):
        return tuple(trajectory.velocity_verdict(spark.createDataFrame([(*r, False, False) if len(r) == 2 else r for r in rows], "name string, std double, inactive boolean, discrete boolean")).first())

    assert verdict(("a", 1.0, True, False)) == ("N/A", 0, 0, 0, 0, 1)
    assert verdict(("a", 0.1), ("b", 0.2), ("left_Gripper", 1.0)) == ("Smooth", 2, 0, 0, 1, 0)
    assert verdict(("a", 0.1), ("b", 0.9), ("c", 1.0)) == ("Moderate", 1, 0, 2, 0, 0)
    assert verdict(("a", 0.5), ("b", 0.9), ("c", 1.0), ("d", 0.95)) == ("Jerky", 0, 1, 3, 0, 0)
    scores = lambda xs: spark.createDataFrame(list(enumerate(xs)), "episode_index bigint, movement double")
    got = trajectory.speed_variance(scores([1.0, 1.0, 2.0, 3.5])).first()
    assert got["median"] == 2.0 and got["verdict"] == "High variance" and got["bins"] == 2
    assert trajectory.speed_variance(scores([10.0, 13.0, 16.0])).first()["verdict"] == "Consistent"
    assert trajectory.speed_variance(scores([5.0, 7.0, 10.0])).first()["verdict"] == "Moderate variance"
    assert [tuple(r) for r in trajectory.speed_ranks(scores([9.5, 0.5, 9.25])).orderBy("rank").collect()] == [(1, 0.5), (2, 9.25), (3, 9.5)]


def test_lag_sums_over_chunks(spark):
    """Chunks of 16 frames give what whole episodes give."""
    rng = np.random.default_rng(8)
    eps = {e: rng.normal(size=(n, 2)) for e, n in enumerate((5, 16, 17, 50))}
    rows = [(e, t, len(v), v[t].tolist(), (v[t] ** 2).tolist()) for e, v in eps.items() for t in range(len(v))]
    df = spark.createDataFrame(rows, "episode_index bigint, t bigint, n bigint, xs array<double>, ys array<double>")
    got = {(r["episode_index"], r["pair"], r["lag"]): (r["xy"], r["xx"], r["yy"]) for r in lags.lag_sums(df, 2, -7, 7, chunk=16).collect()}
    for (e, k, lag), sums in got.items():
        x, y = eps[e][:, k], eps[e][:, k] ** 2
        pairs = [(x[t], y[t + lag]) for t in range(len(x)) if 0 <= t + lag < len(x)]
        assert sums == pytest.approx((sum(a * b for a, b in pairs), sum(a * a for a, _ in pairs), sum(b * b for _, b in pairs)))
    assert len(got) == 4 * 2 * 15


def test_global_ranks_and_bucket_digest(spark):
    import hashlib

    df = spark.createDataFrame([(k * 37 % 1000, f"v{k}") for k in range(1000)], "k bigint, v string")
    ranked_ = {r["k"]: r["rank"] for r in ranks.global_rank(df, ranks.of_ids("k", 64), ["k"]).collect()}
    assert ranked_ == {k: k for k in range(1000)}
    lines = {r["k"]: r["v"] for r in df.collect()}
    parts = [hashlib.sha256(",".join(lines[k] for k in range(b, min(b + 64, 1000))).encode()).hexdigest() for b in range(0, 1000, 64)]
    got = curation.bucket_digest(df, "k", F.col("v"), ranks.of_ids("k", 64)).first()
    assert tuple(got) == (hashlib.sha256(",".join(parts).encode()).hexdigest(), 1000)


def test_pooled_stats(spark):
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=n) for n in (3, 10, 50)]
    df = spark.createDataFrame([(0, len(p), float(p.mean()), float(p.std()), float(p.min()), float(p.max())) for p in parts], "k int, n bigint, mean double, std double, min double, max double")
    r = curation.pooled_stats(df, ["k"]).collect()[0]
    x = np.concatenate(parts)
    assert (r["n"], r["mean"], r["std"]) == (63, pytest.approx(x.mean()), pytest.approx(x.std()))


def test_scale_groups(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 5.0), (1, "b", 2.0, 90.0), (2, "c", 1000.0, 5e6), (3, "d", 3.0, 3.0)], "position int, series string, lo double, hi double")
    assert scalars.scale_groups(df) == [["a", "b"], ["c"], ["d"]]


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "set"
    (root / "meta").mkdir(parents=True)
    info = {"codebase_version": "v3.1", "fps": 10, "features": {"action": {"dtype": "float32", "shape": [2], "names": {"motors": ["a", "b"]}}, "cam": {"dtype": "video", "shape": [3, 4, 4]}, "n": {"dtype": "uint64", "shape": [1]}}}
    (root / "meta/info.json").write_text(json.dumps(info))
    cache = sources.InfoCache()
    assert cache.get(spark, str(root))["fps"] == 10
    s = sources.schema(info["features"])
    assert s.simpleString() == "struct<action:array<float>,n:decimal(20,0)>" and s["action"].metadata["names"] == ["a", "b"]
    assert sources.chartable(info["features"]) == ["action", "n"]
    (root / "meta/info.json").write_text(json.dumps(info | {"codebase_version": "v1.0"}))
    assert cache.get(spark, str(root))["codebase_version"] == "v3.1"
    with pytest.raises(ValueError, match="version"):
        sources.read_info(spark, str(root))
    f = frames_of(spark, {3: [[0, 1]] * 6, 7: [[2, 3]] * 4})
    x = spark.createDataFrame([(3, 1, 3)], "episode_index bigint, start_frame bigint, end_frame bigint")
    sinks.write_clipped(f, x, str(root / "data"))
    got = sorted((r["episode_index"], r["frame_index"], r["index"]) for r in sources.read_frames(spark, str(root)).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6), (1, 3, 7)]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_frames(f, str(root / "data"))
    assert sources.read_frames(spark, str(root), [1], ["frame_index", "nothing"]).columns == ["frame_index"]
    sinks.write_jsonl(spark.sql("SELECT 2 AS b, 1 AS a"), str(tmp_path / "j"))
    sinks.write_csv(spark.sql("SELECT 2 AS b, 'x' AS a"), str(tmp_path / "c"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":1,"b":2}']
    assert [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["2,x"]


def test_ignored_columns_size_and_cameras():
    features = {"a": {"dtype": "float32", "shape": [2]}, "m": {"dtype": "float64", "shape": [3, 3]}, "cam": {"dtype": "video", "shape": [480, 640, 3]}, "s": {"dtype": "string", "shape": [1, 1]}}
    assert sources.ignored_columns(features) == ["m"]
    assert sources.size_and_cameras({"features": features, "data_files_size_in_mb": 1.24, "video_files_size_in_mb": 2.01}) == {"dataset_size_mb": 3.3, "cameras": [{"name": "cam", "height": 480, "width": 640}]}
    assert sources.size_and_cameras({}) == {"dataset_size_mb": 0.0, "cameras": []}


def test_atoms_are_extracted_from_rows(spark):
    """The first row's list, events at their row's time, equal atoms once, those without a role dropped, in order."""
    a, b, e = ("user", "x", "plan", 2.0, None), ("user", "x", "subtask", 2.0, None), ("user", "q", "vqa", None, "front")
    rows = [(1, 0, 0.0, [a, b, (None, "y", "plan", 0.0, None)], [e, e]), (1, 1, 0.5, [("user", "other", "plan", 0.0, None)], [e, ("user", "q", "vqa", 0.25, "front")]), (2, 3, 1.0, None, None)]
    atom = "array<struct<role:string,content:string,style:string,timestamp:double,camera:string>>"
    df = spark.createDataFrame(rows, f"episode_index bigint, frame_index bigint, timestamp double, language_persistent {atom}, language_events {atom}")
    got = sorted(map(tuple, annotation.extract(df).collect()), key=lambda r: r[1])
    want = [("user", "q", "vqa", 0.0, "front"), ("user", "q", "vqa", 0.25, "front"), ("user", "q", "vqa", 0.5, "front"), a, b]
    assert got == [(1, k, *x) for k, x in enumerate(want)]


def test_leases_follow_a_stream(spark, tmp_path):
    src = tmp_path / "claims"
    claims = spark.createDataFrame([(1, "a", 0.0), (1, "b", 10.0), (1, "a", 100.0), (1, "b", 281.0)], "job bigint, owner string, at double")
    claims.coalesce(1).write.parquet(str(src))
    stream = streaming.leases(spark.readStream.schema(claims.schema).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [(r["owner"], r["status"]) for r in spark.table("leases").collect()] == [("a", "granted"), ("b", "refused"), ("a", "renewed"), ("b", "reclaimed")]
    finally:
        q.stop()
