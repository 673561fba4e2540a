"""Curation: boundary checks, review state, predictions, jobs, provenance, inventories.

A violation is a row, not an exception: a distributed run reports all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.lineage import cut

# The transitions' columns, the edges of a job's states, states of attempts that are open, and of leases.
STEPS = tuple(f"t{k}" for k in range(2, 8))
JOB_EDGES = (
    ("queued", "running"), ("queued", "cancelled"), ("running", "cancel_requested"), ("running", "completed"),
    ("running", "completed_with_failures"), ("running", "failed"), ("cancel_requested", "cancelled"),
)
OPEN_ATTEMPTS = ("queued", "retryable", "leased", "requesting")
LEASED = ("leased", "requesting")


def boundary_errors(episodes: DataFrame) -> DataFrame:
    """``episode_index, code, step``: every error of an episode's six transitions."""
    t = [F.col(c) for c in STEPS]
    length, state = F.col("length"), F.col("review_state")
    empty, active = length <= 0, state.isin("draft", "approved_keep")
    none = F.lit(None).cast("int")

    def error(code: str, step: int | None = None) -> Column:
        return F.struct(F.lit(code).alias("code"), (none if step is None else F.lit(step)).alias("step"))

    missing = reduce(lambda a, b: a | b, [x.isNull() for x in t])
    outside = missing | reduce(lambda a, b: a | b, [F.coalesce((x <= 0) | (x >= length), F.lit(False)) for x in t])
    found = [F.when(missing, error("incomplete_coverage")), F.when(outside, error("out_of_range_transition"))]
    for k, (a, b) in enumerate(zip(t, t[1:], strict=False), start=3):
        found += [F.when(b <= a, error("non_increasing_transitions", k)), F.when(b == a, error("zero_length_phase", k))]
    rows = F.array_compact(F.array(*found))
    rows = F.when((F.size(rows) > 0) & ~missing, F.concat(rows, F.array(error("incomplete_coverage")))).otherwise(rows)
    rows = F.when(empty, F.array(error("zero_length_episode"), error("incomplete_coverage"))).when(active, rows)
    return episodes.select("episode_index", F.inline(rows))


def transitions_valid(complete: bool = True) -> Column:
    """Whether the six transitions are in range and strictly increasing; gaps are allowed unless ``complete``."""
    t = F.array(*STEPS)
    known = F.array_compact(t)
    rising = F.forall(F.zip_with(F.slice(known, F.lit(1), F.size(known) - 1), F.slice(known, F.lit(2), F.size(known) - 1), lambda a, b: b > a), lambda x: x)
    ok = F.forall(known, lambda x: (x > 0) & (x < F.col("length"))) & F.when(F.size(known) > 1, rising).otherwise(F.lit(True))
    return ok & (F.size(known) == len(STEPS)) if complete else ok


def closure(edges: DataFrame) -> DataFrame:
    """``child, root, depth`` over single-parent edges (``child, parent``); nodes on a cycle, or above one, are left out.

    Paths double in each round, and each round is written, so no plan grows. As no path has more steps than there are
    edges, that many doublings end every one that has an end; rounds stop when none is left to lengthen.
    """
    paths = cut(edges.select("child", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    inner = edges.select(F.col("child").alias("root"))
    for _ in range(max(1, paths.count().bit_length())):
        if paths.join(inner, "root", "left_semi").isEmpty():
            break
        up = paths.select(F.col("child").alias("mid"), F.col("root").alias("top"), F.col("depth").alias("more"))
        paths = cut(paths.join(up, F.col("root") == F.col("mid"), "left").select("child", F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return paths.join(inner, "root", "left_anti").select("child", "root", "depth")


def compare_and_set(state: DataFrame, updates: DataFrame, key: str, values: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``state`` after ``updates``, and ``updates`` with ``outcome``: updated, stale or missing.

    ``state`` has ``key, revision, values``; an update names the revision that it has seen as ``expected`` and takes
    effect only if that is the current one, which it raises by one. Of several for one key the first in ``order`` counts.
    """
    now = state.select(key, F.col("revision").alias("s_now"))
    tried = updates.join(now, key, "left").withColumn("s_fits", F.col("s_now").eqNullSafe(F.col("expected")) & F.col("s_now").isNotNull())
    tried = tried.withColumn("s_k", F.row_number().over(Window.partitionBy(key, "s_fits").orderBy(*order)))
    wins = F.col("s_fits") & (F.col("s_k") == 1)
    outcome = F.when(F.col("s_now").isNull(), "missing").when(wins, "updated").otherwise("stale")
    tried = tried.withColumn("outcome", outcome)
    new = tried.filter("outcome = 'updated'").select(key, *[F.col(v).alias(f"s_{v}") for v in values], F.lit(True).alias("s_hit"))
    after = state.join(new, key, "left")
    columns = [F.when(F.col("s_hit"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) if c in values else (F.col("revision") + F.coalesce(F.col("s_hit"), F.lit(False)).cast("bigint")).alias(c) if c == "revision" else F.col(c) for c in state.columns]
    return after.select(*columns), tried.drop("s_now", "s_fits", "s_k")


def live(lease: Column, now: Column) -> Column:
    return F.coalesce(lease > now, F.lit(False))


def claim_next(jobs: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """``job, attempt`` that each running job with a live lease may claim next.

    Attempts whose lease has expired count as retryable. A job with an attempt under a live lease claims none; else the
    first queued or retryable one by episode, attempt number and id.
    """
    stale = F.col("state").isin(*LEASED) & ~live(F.col("lease_expires_at"), now)
    rows = attempts.withColumn("state", F.when(stale, "retryable").otherwise(F.col("state")))
    free = F.col("state").isin("queued", "retryable")
    per = rows.groupBy("job").agg(F.count_if(F.col("state").isin(*LEASED)).alias("busy"), F.min_by(F.when(free, F.col("id")), F.when(free, F.struct("episode", "attempt_number", "id"))).alias("attempt"))
    ready = jobs.filter((F.col("state") == "running") & live(F.col("lease_expires_at"), now)).select("job")
    return per.filter("busy = 0 AND attempt IS NOT NULL").join(ready, "job", "left_semi").select("job", "attempt")


def finalize_jobs(jobs: DataFrame, attempts: DataFrame, owner: Column, now: Column) -> DataFrame:
    """``job, status``: lost where the owner has no live lease on a running job, open while work or a cancellation is left, else how it ends."""
    per = attempts.groupBy("job").agg(F.count_if(F.col("state").isin(*OPEN_ATTEMPTS)).alias("open"), F.count_if(F.col("state") == "manual_only").alias("manual"))
    rows = jobs.join(per, "job", "left")
    held = (F.col("owner") == owner) & F.col("state").isin("running", "cancel_requested") & live(F.col("lease_expires_at"), now)
    status = (
        F.when(~F.coalesce(held, F.lit(False)), "lost").when((F.col("state") == "cancel_requested") | (F.coalesce("open", F.lit(0)) > 0), "open")
        .when(F.coalesce("manual", F.lit(0)) > 0, "completed_with_failures").otherwise("completed")
    )
    return rows.select("job", status.alias("status"))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """``jobs`` after a restart: queued and running ones are interrupted."""
    hit = F.col("state").isin("queued", "running")
    return jobs.withColumn("error", F.when(hit, "Worker restarted; resume unfinished episodes explicitly")).withColumn("state", F.when(hit, "interrupted").otherwise(F.col("state")))


def review_status(reviews: DataFrame) -> DataFrame:
    """``reviews`` with ``status``: reviewed if a review stands for the current digests of annotations and exclusions.

    A review that names no exclusions stands for none, ``no_exclusions``.
    """
    fresh = F.col("reviewed_at").isNotNull() & (F.col("reviewed_annotations") == F.col("annotations")) & (F.coalesce("reviewed_exclusions", "no_exclusions") == F.col("exclusions"))
    return reviews.withColumn("status", F.when(F.coalesce(fresh, F.lit(False)), "reviewed").otherwise("unreviewed"))


def bucket_digest(rows: DataFrame, order: str, line: Column, bucket: Column) -> DataFrame:
    """One row, ``digest, n``: SHA-256 of the digests of ``bucket``s in their order, each of its lines in ``order``.

    A task digests a bucket, and one the digests of all, in place of one task that holds every line.
    """
    parts = rows.select(bucket.alias("s_bucket"), F.struct(F.col(order).alias("k"), line.alias("s")).alias("s_row")).groupBy("s_bucket")
    parts = parts.agg(F.array_sort(F.collect_list("s_row")).alias("s"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(F.struct("s_bucket", F.sha2(F.array_join(F.transform("s", lambda x: x["s"]), ","), 256).alias("d")).alias("p"), "n")
    whole = parts.agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("n").alias("n"))
    return whole.select(F.sha2(F.array_join(F.transform("p", lambda x: x["d"]), ","), 256).alias("digest"), F.coalesce("n", F.lit(0)).alias("n"))


def illegal_transitions(log: DataFrame, edges=JOB_EDGES) -> DataFrame:
    """Rows of ``log`` (``prev, next``) that no edge of the state graph allows."""
    allowed = log.sparkSession.createDataFrame(list(edges), "prev string, next string")
    return log.join(F.broadcast(allowed), ["prev", "next"], "left_anti")


def pooled_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, mean, std, min, max`` from parts with ``n, mean, std, min, max``: population statistics of the whole."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    square = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / total
    return parts.groupBy(*keys).agg(total.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"))


def diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed or changed between two inventories; one full outer join."""
    l, r = left.select(key, F.col(value).alias("s_l"), F.lit(True).alias("s_in")), right.select(key, F.col(value).alias("s_r"), F.lit(True).alias("s_to"))
    out = l.join(r, key, "full")
    change = F.when(F.col("s_to").isNull(), "added").when(F.col("s_in").isNull(), "removed").when(~F.col("s_l").eqNullSafe(F.col("s_r")), "changed")
    return out.select(key, change.alias("change")).filter("change IS NOT NULL")
