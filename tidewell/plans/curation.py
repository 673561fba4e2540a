"""Queries: curation, validation, jobs, rewriting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import curation as C
from tidewell.operators import replies as P
from tidewell.operators import sequences as S
from tidewell.operators import trajectory as T
from tidewell.operators.ranks import global_rank, of_ids
from tidewell.plans.registry import query
from tidewell.plans.views import EPISODES, FRAMES, LONG, episodes, frames, r, read, rounded

VALID = "length > 0 AND 0 < t2 AND t2 < t3 AND t3 < t4 AND t4 < t5 AND t5 < t6 AND t6 < t7 AND t7 < length"
_T = "[t2, t3, t4, t5, t6, t7]"

ERRORS = EPISODES + f""",
checked AS (SELECT *, t2 IS NULL OR t3 IS NULL OR t4 IS NULL OR t5 IS NULL OR t6 IS NULL OR t7 IS NULL AS missing FROM episodes WHERE length > 0 AND review_state IN ('draft', 'approved_keep')),
steps AS (SELECT episode_index, unnest([3, 4, 5, 6, 7])::INT AS step, unnest([t2, t3, t4, t5, t6]) AS a, unnest([t3, t4, t5, t6, t7]) AS b FROM checked),
e1 AS (SELECT episode_index, 'incomplete_coverage' AS code, NULL::INT AS step FROM checked WHERE missing
  UNION ALL SELECT episode_index, 'out_of_range_transition', NULL FROM checked WHERE missing OR len(list_filter({_T}, lambda x: x <= 0 OR x >= length)) > 0
  UNION ALL SELECT episode_index, 'non_increasing_transitions', step FROM steps WHERE b <= a
  UNION ALL SELECT episode_index, 'zero_length_phase', step FROM steps WHERE b = a),
errors AS (SELECT * FROM e1 UNION ALL SELECT DISTINCT episode_index, 'incomplete_coverage', NULL::INT FROM e1 WHERE episode_index NOT IN (SELECT episode_index FROM e1 WHERE code = 'incomplete_coverage')
  UNION ALL SELECT episode_index, unnest(['zero_length_episode', 'incomplete_coverage']), NULL FROM episodes WHERE length <= 0)
"""


@query("boundary_errors", f"WITH {ERRORS} SELECT episode_index, code, step FROM errors")
def boundary_errors(spark, d):
    return C.boundary_errors(episodes(spark, d))


@query("audit_report", f"WITH {ERRORS} SELECT code, count(*) AS n, count(DISTINCT episode_index) AS episodes FROM errors GROUP BY code UNION ALL SELECT 'state:' || review_state, count(*), count(*) FILTER (WHERE length > 0) FROM episodes GROUP BY review_state")
def audit_report(spark, d):
    e = episodes(spark, d)
    errors = C.boundary_errors(e).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("episode_index").alias("episodes"))
    states = e.groupBy(F.concat(F.lit("state:"), "review_state").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") > 0).alias("episodes"))
    return errors.unionByName(states)


@query("transition_validate", f"""WITH {EPISODES}, k AS (SELECT episode_index, length, list_filter({_T}, lambda x: x IS NOT NULL) AS ts FROM episodes)
SELECT episode_index, CASE WHEN len(ts) < 6 THEN 'incomplete' WHEN length < 7 THEN 'too_short' WHEN len(list_filter(ts, lambda x: x <= 0 OR x >= length)) > 0 THEN 'out_of_range'
WHEN NOT (ts[1] < ts[2] AND ts[2] < ts[3] AND ts[3] < ts[4] AND ts[4] < ts[5] AND ts[5] < ts[6]) THEN 'not_increasing' ELSE 'ok' END AS reason FROM k""")
def transition_validate(spark, d):
    known = F.array_compact(F.array(*C.STEPS))
    rising = C.transitions_valid(complete=False)
    outside = F.exists(known, lambda x: (x <= 0) | (x >= F.col("length")))
    reason = F.when(F.size(known) < 6, "incomplete").when(F.col("length") < 7, "too_short").when(outside, "out_of_range").when(~rising, "not_increasing").otherwise("ok")
    return episodes(spark, d).select("episode_index", reason.alias("reason"))


@query("decision_warnings", f"""WITH {EPISODES} SELECT episode_index, concat_ws(',', CASE WHEN review_state IN ('draft', 'approved_keep') AND NOT coalesce({VALID}, FALSE) THEN review_state || '_transition_frames_invalid' END,
CASE WHEN review_state LIKE 'approved%' AND reviewer IS NULL THEN 'approval_reviewer_missing' END, CASE WHEN review_state LIKE 'approved%' AND revision <> 3 THEN 'approval_revision_mismatch' END,
CASE WHEN review_state = 'draft' AND reviewer IS NOT NULL THEN 'draft_approval_fields_stale' END) AS warnings FROM episodes WHERE review_state <> 'pending'""")
def decision_warnings(spark, d):
    state, ok = F.col("review_state"), F.coalesce(F.expr(VALID), F.lit(False))
    approved = state.startswith("approved")
    found = [
        F.when(state.isin("draft", "approved_keep") & ~ok, F.concat(state, F.lit("_transition_frames_invalid"))),
        F.when(approved & F.col("reviewer").isNull(), "approval_reviewer_missing"),
        F.when(approved & (F.col("revision") != 3), "approval_revision_mismatch"),
        F.when((state == "draft") & F.col("reviewer").isNotNull(), "draft_approval_fields_stale"),
    ]
    return episodes(spark, d).filter(state != "pending").select("episode_index", F.concat_ws(",", *found).alias("warnings"))


@query("approval_issues", f"WITH {EPISODES} SELECT episode_index, (reviewer IS NULL)::INT + (NOT coalesce({VALID}, FALSE))::INT + (revision = 0)::INT AS n_issues FROM episodes WHERE review_state = 'draft'")
def approval_issues(spark, d):
    e = episodes(spark, d).filter("review_state = 'draft'")
    n = F.col("reviewer").isNull().cast("int") + (~F.coalesce(F.expr(VALID), F.lit(False))).cast("int") + (F.col("revision") == 0).cast("int")
    return e.select("episode_index", n.alias("n_issues"))


@query("export_approval", f"WITH {EPISODES} SELECT episode_index FROM episodes WHERE review_state = 'approved_keep' AND reviewer IS NOT NULL AND {VALID}")
def export_approval(spark, d):
    return episodes(spark, d).filter("review_state = 'approved_keep' AND reviewer IS NOT NULL").filter(VALID).select("episode_index")


@query("approval_snapshot", f"""WITH {EPISODES}, p AS (SELECT episode_index // 4096 AS b, sha256(string_agg(episode_index || ':' || reviewer || ':' || revision, ',' ORDER BY episode_index)) AS d, count(*) AS n
FROM episodes WHERE review_state = 'approved_keep' AND reviewer IS NOT NULL AND {VALID} GROUP BY 1) SELECT sha256(coalesce(string_agg(d, ',' ORDER BY b), '')) AS digest, coalesce(sum(n), 0)::BIGINT AS n FROM p""")
def approval_snapshot(spark, d):
    rows = episodes(spark, d).filter("review_state = 'approved_keep' AND reviewer IS NOT NULL").filter(VALID)
    return C.bucket_digest(rows, "episode_index", F.concat_ws(":", "episode_index", "reviewer", "revision"), of_ids("episode_index"))


@query("review_state_counts", f"WITH {EPISODES}, s AS (SELECT unnest(['pending', 'draft', 'approved_keep', 'approved_reject', 'superseded']) AS review_state) SELECT s.review_state, count(e.episode_index) AS n FROM s LEFT JOIN episodes e USING (review_state) GROUP BY 1")
def review_state_counts(spark, d):
    s = spark.sql("SELECT explode(array('pending', 'draft', 'approved_keep', 'approved_reject', 'superseded')) AS review_state")
    n = episodes(spark, d).groupBy("review_state").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(s).join(n, "review_state", "left").select("review_state", F.coalesce("n", F.lit(0)).alias("n"))


@query("review_transitions", f"""WITH {EPISODES}, log AS (SELECT group_id, episode_index, review_state AS next, lag(review_state) OVER (PARTITION BY group_id ORDER BY updated_at, episode_index) AS prev FROM episodes)
SELECT prev, next, count(*) AS n, (prev, next) IN (('pending', 'draft'), ('draft', 'approved_keep'), ('draft', 'approved_reject'), ('approved_keep', 'draft'), ('approved_reject', 'draft'), ('pending', 'approved_reject')) AS allowed FROM log WHERE prev IS NOT NULL GROUP BY ALL""")
def review_transitions(spark, d):
    w = Window.partitionBy("group_id").orderBy("updated_at", "episode_index")
    log = episodes(spark, d).select(F.lag("review_state").over(w).alias("prev"), F.col("review_state").alias("next")).filter("prev IS NOT NULL")
    allowed = [("pending", "draft"), ("draft", "approved_keep"), ("draft", "approved_reject"), ("approved_keep", "draft"), ("approved_reject", "draft"), ("pending", "approved_reject")]
    return log.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.concat_ws(">", "prev", "next").isin([f"{a}>{b}" for a, b in allowed]))


JOBS = """
log AS (SELECT o_custkey AS job, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'queued' WHEN '2-HIGH' THEN 'running' WHEN '3-MEDIUM' THEN 'completed' WHEN '4-NOT SPECIFIED' THEN 'failed' ELSE 'cancelled' END AS state, o_orderdate AS stamp FROM orders)
"""


def jobs(spark, d):
    o = read(spark, d, "orders")
    p = F.col("o_orderpriority")
    state = F.when(p == "1-URGENT", "queued").when(p == "2-HIGH", "running").when(p == "3-MEDIUM", "completed").when(p == "4-NOT SPECIFIED", "failed").otherwise("cancelled")
    return o.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("k"), state.alias("state"), F.col("o_orderdate").alias("stamp"))


@query("illegal_transitions", f"""WITH {JOBS}, s AS (SELECT lag(state) OVER (PARTITION BY job ORDER BY stamp, k) AS prev, state AS next FROM log)
SELECT prev, next, count(*) AS n FROM s WHERE prev IS NOT NULL AND (prev, next) NOT IN (('queued', 'running'), ('queued', 'cancelled'), ('running', 'completed'), ('running', 'completed_with_failures'), ('running', 'cancel_requested'), ('running', 'failed'), ('cancel_requested', 'cancelled')) GROUP BY ALL""")
def illegal_transitions(spark, d):
    w = Window.partitionBy("job").orderBy("stamp", "k")
    log = jobs(spark, d).select(F.lag("state").over(w).alias("prev"), F.col("state").alias("next")).filter("prev IS NOT NULL")
    return C.illegal_transitions(log).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


@query("job_summary", f"WITH {JOBS} SELECT state, count(*) AS n, count(DISTINCT job) AS jobs FROM log GROUP BY state")
def job_summary(spark, d):
    return jobs(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job").alias("jobs"))


ATTEMPTS = """
att AS (SELECT o_custkey AS job, o_orderkey AS id, o_orderkey % 50 AS episode, o_orderkey % 3 AS attempt_number,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'queued' WHEN '2-HIGH' THEN 'retryable' WHEN '3-MEDIUM' THEN 'succeeded' WHEN '4-NOT SPECIFIED' THEN 'manual_only' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'leased' ELSE 'requesting' END END AS state,
  o_orderdate + INTERVAL 180 SECOND AS lease_expires_at FROM orders),
owned AS (SELECT job, 'worker-' || (job % 3) AS owner, CASE WHEN job % 7 = 0 THEN 'cancel_requested' WHEN job % 11 = 0 THEN 'completed' ELSE 'running' END AS state, max(lease_expires_at) AS lease_expires_at FROM att GROUP BY job)
"""
NOW = "1996-01-01"


def attempts(spark, d):
    """``job, id, episode, attempt_number, state, lease_expires_at``: orders as attempts of their customer's job."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    leased = F.when(k % 2 == 0, "leased").otherwise("requesting")
    state = F.when(p == "1-URGENT", "queued").when(p == "2-HIGH", "retryable").when(p == "3-MEDIUM", "succeeded").when(p == "4-NOT SPECIFIED", "manual_only").otherwise(leased)
    return read(spark, d, "orders").select(F.col("o_custkey").alias("job"), k.alias("id"), (k % 50).alias("episode"), (k % 3).alias("attempt_number"), state.alias("state"), (F.col("o_orderdate") + F.expr("INTERVAL 180 SECOND")).alias("lease_expires_at"))


def owned_jobs(spark, d):
    state = F.when(F.col("job") % 7 == 0, "cancel_requested").when(F.col("job") % 11 == 0, "completed").otherwise("running")
    return attempts(spark, d).groupBy("job").agg(F.max("lease_expires_at").alias("lease_expires_at")).select("job", F.concat(F.lit("worker-"), F.col("job") % 3).alias("owner"), state.alias("state"), "lease_expires_at")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("finalize_jobs", f"""WITH {ATTEMPTS}, c AS (SELECT job, count(*) FILTER (WHERE state IN ('queued', 'retryable', 'leased', 'requesting')) AS open, count(*) FILTER (WHERE state = 'manual_only') AS manual FROM att GROUP BY job)
SELECT job, CASE WHEN NOT (owner = 'worker-1' AND state IN ('running', 'cancel_requested') AND lease_expires_at > TIMESTAMP '{NOW}') THEN 'lost' WHEN state = 'cancel_requested' OR open > 0 THEN 'open'
WHEN manual > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM owned JOIN c USING (job)""")
def finalize_jobs(spark, d):
    return C.finalize_jobs(owned_jobs(spark, d), attempts(spark, d), F.lit("worker-1"), _now())


@query("claim_next", f"""WITH {ATTEMPTS}, a AS (SELECT *, CASE WHEN state IN ('leased', 'requesting') AND lease_expires_at <= TIMESTAMP '{NOW}' THEN 'retryable' ELSE state END AS now_state FROM att),
free AS (SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY episode, attempt_number, id) AS k FROM a WHERE now_state IN ('queued', 'retryable'))
SELECT job, id AS attempt FROM free WHERE k = 1 AND job NOT IN (SELECT job FROM a WHERE now_state IN ('leased', 'requesting')) AND job IN (SELECT job FROM owned WHERE state = 'running' AND lease_expires_at > TIMESTAMP '{NOW}')""")
def claim_next(spark, d):
    return C.claim_next(owned_jobs(spark, d), attempts(spark, d), _now())


@query("compare_and_set", f"""WITH {EPISODES}, u AS (SELECT o_custkey AS episode_index, o_orderkey AS id, o_orderkey % 5 AS expected FROM orders),
t AS (SELECT u.*, e.revision, row_number() OVER (PARTITION BY u.episode_index, e.revision IS NOT NULL AND e.revision = expected ORDER BY id) AS k FROM u LEFT JOIN episodes e USING (episode_index))
SELECT CASE WHEN revision IS NULL THEN 'missing' WHEN revision = expected AND k = 1 THEN 'updated' ELSE 'stale' END AS outcome, count(*) AS n, coalesce(sum(CASE WHEN revision = expected AND k = 1 THEN id END), 0)::BIGINT AS ids FROM t GROUP BY 1""")
def compare_and_set(spark, d):
    """Updates of episodes by the revision that they have seen: the first that fits counts, others are stale."""
    updates = read(spark, d, "orders").select(F.col("o_custkey").alias("episode_index"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("expected"), F.lit("draft").alias("review_state"))
    _, tried = C.compare_and_set(episodes(spark, d).select("episode_index", "revision", "review_state"), updates, "episode_index", ["review_state"], ["id"])
    return tried.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == "updated", F.col("id"))), F.lit(0)).alias("ids"))


@query("recent_errors", f"WITH {JOBS} SELECT job, k, stamp FROM log WHERE state = 'failed' ORDER BY stamp DESC, k DESC LIMIT 20")
def recent_errors(spark, d):
    return jobs(spark, d).filter("state = 'failed'").orderBy(F.col("stamp").desc(), F.col("k").desc()).limit(20).select("job", "k", "stamp")


@query("latest_run", f"WITH {JOBS} SELECT job, arg_max(k, (stamp, -k)) AS run FROM log GROUP BY job")
def latest_run(spark, d):
    return jobs(spark, d).groupBy("job").agg(F.max_by("k", F.struct("stamp", -F.col("k"))).alias("run"))


@query("retry_selection", f"WITH {JOBS} SELECT job, count(*) + 1 AS attempt_number FROM log WHERE job IN (SELECT job FROM log GROUP BY job HAVING arg_max(state, (stamp, k)) IN ('failed', 'cancelled')) GROUP BY job")
def retry_selection(spark, d):
    last = jobs(spark, d).groupBy("job").agg(F.max_by("state", F.struct("stamp", "k")).alias("state"), (F.count(F.lit(1)) + 1).alias("attempt_number"))
    return last.filter(F.col("state").isin("failed", "cancelled")).select("job", "attempt_number")


@query("cancel_attempts", f"WITH {JOBS}, c AS (SELECT job, bool_or(state = 'running') AS running FROM log GROUP BY job) SELECT k, CASE WHEN state IN ('queued', 'running') AND NOT running THEN 'cancelled' ELSE state END AS state, running AND state = 'running' AS cancel_requested FROM log JOIN c USING (job)")
def cancel_attempts(spark, d):
    running = F.bool_or(F.col("state") == "running").over(Window.partitionBy("job"))
    rows = jobs(spark, d).withColumn("running", running)
    state = F.when(F.col("state").isin("queued", "running") & ~F.col("running"), "cancelled").otherwise(F.col("state"))
    return rows.select("k", state.alias("state"), (F.col("running") & (F.col("state") == "running")).alias("cancel_requested"))


@query("recover_jobs", f"WITH {JOBS} SELECT k, CASE WHEN state IN ('queued', 'running') THEN 'interrupted' ELSE state END AS state, CASE WHEN state IN ('queued', 'running') THEN 'Worker restarted; resume unfinished episodes explicitly' END AS error FROM log")
def recover_jobs(spark, d):
    return C.recover_jobs(jobs(spark, d)).select("k", "state", "error")


@query("lease_expiry", f"WITH {JOBS} SELECT k, stamp + INTERVAL 180 SECOND AS expires_at, stamp + INTERVAL 180 SECOND <= (SELECT max(stamp) FROM log) AS expired FROM log WHERE state = 'running'")
def lease_expiry(spark, d):
    j = jobs(spark, d)
    now = F.broadcast(j.agg(F.max("stamp").alias("now")))
    until = F.col("stamp") + F.expr("INTERVAL 180 SECOND")
    return j.filter("state = 'running'").crossJoin(now).select("k", until.alias("expires_at"), (until <= F.col("now")).alias("expired"))


@query("job_attempts", f"WITH {JOBS} SELECT job, unnest(range(1, least(count(*), 3) + 1)) AS attempt FROM log GROUP BY job")
def job_attempts(spark, d):
    n = jobs(spark, d).groupBy("job").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("n"))
    return n.select("job", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("attempt"))


@query("batch_status", f"WITH {JOBS} SELECT count(*) AS attempts, count(*) FILTER (WHERE state = 'completed') AS completed, count(DISTINCT job) FILTER (WHERE state = 'completed') AS covered FROM log")
def batch_status(spark, d):
    done = F.col("state") == "completed"
    return jobs(spark, d).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(done).alias("completed"), F.count_distinct(F.when(done, F.col("job"))).alias("covered"))


@query("retryable_exchange", "SELECT o_orderkey AS k, 400 + o_orderkey % 120 AS status, (400 + o_orderkey % 120) IN (408, 429) OR (400 + o_orderkey % 120) BETWEEN 500 AND 599 AS retryable FROM orders")
def retryable_exchange(spark, d):
    s = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (400 + F.col("o_orderkey") % 120).alias("status"))
    return s.withColumn("retryable", F.col("status").isin(408, 429) | F.col("status").between(500, 599))


@query("active_proposal", f"""WITH {JOBS} SELECT c.c_custkey AS customer, l.k, n.n_name AS dataset FROM log l JOIN customer c ON c.c_custkey = l.job JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE l.state = 'running'""")
def active_proposal(spark, d):
    n = F.broadcast(read(spark, d, "nation"))
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return jobs(spark, d).filter("state = 'running'").join(c, F.col("job") == F.col("c_custkey")).select(F.col("c_custkey").alias("customer"), "k", F.col("n_name").alias("dataset"))


@query("approval_events", f"WITH {EPISODES} SELECT episode_index, row_number() OVER (ORDER BY updated_at, episode_index) AS position FROM episodes WHERE review_state LIKE 'approved%'")
def approval_events(spark, d):
    e = episodes(spark, d).filter(F.col("review_state").startswith("approved"))
    ranked = global_rank(e, F.to_date("updated_at"), ["updated_at", "episode_index"])
    return ranked.select("episode_index", (F.col("rank") + 1).alias("position"))


@query("audit_log", f"WITH {EPISODES} SELECT group_id, episode_index, row_number() OVER (PARTITION BY group_id ORDER BY updated_at, episode_index) AS event_no, lag(review_state, 1, 'none') OVER (PARTITION BY group_id ORDER BY updated_at, episode_index) AS before_state, review_state AS after_state FROM episodes")
def audit_log(spark, d):
    w = Window.partitionBy("group_id").orderBy("updated_at", "episode_index")
    return episodes(spark, d).select("group_id", "episode_index", F.row_number().over(w).cast("bigint").alias("event_no"), F.lag("review_state", 1, "none").over(w).alias("before_state"), F.col("review_state").alias("after_state"))


@query("prompt_migration", f"WITH {EPISODES} SELECT episode_index, CASE WHEN review_state = 'approved_keep' THEN 'draft' ELSE review_state END AS review_state, CASE WHEN review_state <> 'approved_keep' THEN reviewer END AS reviewer, revision + (review_state = 'approved_keep')::INT AS revision FROM episodes")
def prompt_migration(spark, d):
    kept = F.col("review_state") == "approved_keep"
    return episodes(spark, d).select("episode_index", F.when(kept, "draft").otherwise(F.col("review_state")).alias("review_state"), F.when(~kept, F.col("reviewer")).alias("reviewer"), (F.col("revision") + kept.cast("int")).alias("revision"))


@query("snapshot_gate", f"WITH {EPISODES} SELECT group_id, CASE WHEN count(*) FILTER (WHERE review_state = 'approved_keep') = 0 THEN 'no_approved_episodes' WHEN count(*) FILTER (WHERE review_state IN ('pending', 'draft')) > 0 THEN 'unreviewed_episodes' WHEN min(length) <= 0 THEN 'empty_episode' ELSE 'ready' END AS gate FROM episodes GROUP BY 1")
def snapshot_gate(spark, d):
    state = F.col("review_state")
    gate = F.when(F.count_if(state == "approved_keep") == 0, "no_approved_episodes").when(F.count_if(state.isin("pending", "draft")) > 0, "unreviewed_episodes").when(F.min("length") <= 0, "empty_episode").otherwise("ready")
    return episodes(spark, d).groupBy("group_id").agg(gate.alias("gate"))


@query("keep_remaining", f"WITH {EPISODES} SELECT CASE WHEN review_state = 'pending' THEN 'keep' WHEN review_state = 'approved_reject' THEN 'delete' ELSE 'keep' END AS decision, review_state, count(*) AS n FROM episodes GROUP BY ALL")
def keep_remaining(spark, d):
    decision = F.when(F.col("review_state") == "approved_reject", "delete").otherwise("keep")
    return episodes(spark, d).groupBy(decision.alias("decision"), "review_state").agg(F.count(F.lit(1)).alias("n"))


@query("workflow_counts", f"WITH {EPISODES} SELECT count(*) FILTER (WHERE review_state <> 'approved_reject') AS kept, count(*) FILTER (WHERE review_state = 'approved_reject') AS deleted, count(*) FILTER (WHERE review_state IN ('pending', 'draft')) AS unreviewed FROM episodes")
def workflow_counts(spark, d):
    s = F.col("review_state")
    return episodes(spark, d).agg(F.count_if(s != "approved_reject").alias("kept"), F.count_if(s == "approved_reject").alias("deleted"), F.count_if(s.isin("pending", "draft")).alias("unreviewed"))


@query("group_counts", f"WITH {EPISODES} SELECT count(*) AS groups, count(*) FILTER (WHERE w) AS awaiting, count(*) FILTER (WHERE p) AS published FROM (SELECT group_id, bool_or(review_state = 'draft') AS w, bool_and(review_state = 'approved_keep') AS p FROM episodes GROUP BY 1)")
def group_counts(spark, d):
    s = F.col("review_state")
    g = episodes(spark, d).groupBy("group_id").agg(F.bool_or(s == "draft").alias("w"), F.bool_and(s == "approved_keep").alias("p"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if("w").alias("awaiting"), F.count_if("p").alias("published"))


_RATE = r("count(*) FILTER (WHERE review_state LIKE 'approved%') / count(*)::DOUBLE")


@query("run_summary", f"WITH {EPISODES} SELECT chunk, count(*) AS episodes, count(*) FILTER (WHERE review_state LIKE 'approved%') AS reviewed, {_RATE} AS review_rate, sum(length)::BIGINT AS frames FROM episodes GROUP BY chunk")
def run_summary(spark, d):
    n, done = F.count(F.lit(1)), F.count_if(F.col("review_state").startswith("approved"))
    return episodes(spark, d).groupBy("chunk").agg(n.alias("episodes"), done.alias("reviewed"), rounded(done / n).alias("review_rate"), F.sum("length").alias("frames"))


_TEXT = "concat_ws(',', t2, t3, t4, t5, t6, t7)"


@query("review_status", f"""WITH {EPISODES}, v AS (SELECT *, sha256({_TEXT}) AS now, sha256({_TEXT} || CASE WHEN revision = 0 THEN '!' ELSE '' END) AS then_, sha256(CASE WHEN episode_index % 10 = 5 THEN '[1,2)' ELSE '' END) AS clip,
CASE WHEN episode_index % 4 <> 0 THEN sha256(CASE WHEN episode_index % 20 = 5 THEN '[1,2)' ELSE '' END) END AS clip_then FROM episodes)
SELECT episode_index, CASE WHEN reviewer IS NOT NULL AND now = then_ AND coalesce(clip_then, sha256('')) = clip THEN 'reviewed' ELSE 'unreviewed' END AS status FROM v""")
def review_status(spark, d):
    k, text = F.col("episode_index"), F.concat_ws(",", *C.STEPS)
    clip = lambda c: F.sha2(F.when(c, "[1,2)").otherwise(""), 256)
    rows = episodes(spark, d).select(
        "episode_index", F.when(F.col("reviewer").isNotNull(), F.col("updated_at")).alias("reviewed_at"), F.sha2(text, 256).alias("annotations"),
        F.sha2(F.concat(text, F.when(F.col("revision") == 0, "!").otherwise("")), 256).alias("reviewed_annotations"), clip(k % 10 == 5).alias("exclusions"),
        F.when(k % 4 != 0, clip(k % 20 == 5)).alias("reviewed_exclusions"), F.sha2(F.lit(""), 256).alias("no_exclusions"),
    )
    return C.review_status(rows).select("episode_index", "status")


@query("review_evidence", f"WITH {EPISODES} SELECT episode_index, CASE WHEN length = 0 THEN NULL ELSE reviewer IS NOT NULL AND review_state LIKE 'approved%' END AS reviewed FROM episodes")
def review_evidence(spark, d):
    """Three-valued: null where there is nothing to review."""
    done = F.col("reviewer").isNotNull() & F.col("review_state").startswith("approved")
    return episodes(spark, d).select("episode_index", F.when(F.col("length") != 0, done).alias("reviewed"))


@query("review_snapshot", f"WITH {EPISODES} SELECT group_id, sha256(string_agg(episode_index || '=' || review_state, ';' ORDER BY episode_index)) AS digest FROM episodes GROUP BY 1")
def review_snapshot(spark, d):
    line = F.struct("episode_index", F.concat_ws("=", "episode_index", "review_state").alias("s"))
    g = episodes(spark, d).groupBy("group_id").agg(F.array_sort(F.collect_list(line)).alias("s"))
    return g.select("group_id", F.sha2(F.array_join(F.transform("s", lambda x: x["s"]), ";"), 256).alias("digest"))


@query("bulk_review_gate", f"WITH {EPISODES} SELECT episode_index, CASE WHEN t2 IS NULL THEN 'missing_atoms' ELSE 'unreadable' END AS violation FROM episodes WHERE review_state <> 'approved_reject' AND (t2 IS NULL OR length = 0)")
def bulk_review_gate(spark, d):
    e = episodes(spark, d).filter("review_state <> 'approved_reject' AND (t2 IS NULL OR length = 0)")
    return e.select("episode_index", F.when(F.col("t2").isNull(), "missing_atoms").otherwise("unreadable").alias("violation"))


@query("evidence_issues", f"WITH {EPISODES} SELECT episode_index, 'missing_contact_sheet' AS issue FROM episodes WHERE review_state LIKE 'approved%' AND episode_index NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def evidence_issues(spark, d):
    seen = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("episode_index"))
    e = episodes(spark, d).filter(F.col("review_state").startswith("approved"))
    return e.join(seen, "episode_index", "left_anti").select("episode_index", F.lit("missing_contact_sheet").alias("issue"))


@query("boundary_mae", f"WITH {EPISODES} SELECT episode_index, CASE WHEN t2 IS NULL OR t3 IS NULL THEN 'topology_mismatch' ELSE 'matched' END AS status, CASE WHEN t2 IS NOT NULL AND t3 IS NOT NULL THEN {r('(abs(t2 - 5) + abs(t3 - 9)) / 2.0')} END AS mae FROM episodes")
def boundary_mae(spark, d):
    """Reviewed transitions against a fixed proposal; lists of unlike length are never paired."""
    own = F.array_compact(F.array("t2", "t3"))
    want = F.array(F.lit(5), F.lit(9))
    same = F.size(own) == F.size(want)
    gaps = F.zip_with(own, want, lambda a, b: F.abs(a - b))
    mae = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0))) / 2
    return episodes(spark, d).select("episode_index", F.when(same, "matched").otherwise("topology_mismatch").alias("status"), F.when(same, rounded(mae)).alias("mae"))


@query("prediction_summary", f"""WITH {JOBS}, a AS (SELECT job, arg_min(state, (stamp, k)) AS first_pass, arg_max(state, (stamp, k)) AS latest FROM log GROUP BY job)
SELECT pass, count(*) AS reviewed, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state IN ('queued', 'running')) AS missing, count(*) FILTER (WHERE state = 'completed') AS eligible
FROM (SELECT 'first_pass' AS pass, first_pass AS state FROM a UNION ALL SELECT 'latest', latest FROM a) GROUP BY pass""")
def prediction_summary(spark, d):
    a = jobs(spark, d).groupBy("job").agg(F.min_by("state", F.struct("stamp", "k")).alias("first_pass"), F.max_by("state", F.struct("stamp", "k")).alias("latest"))
    s = a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("pass"), F.col(c).alias("state")) for c in ("first_pass", "latest")])))
    n = lambda *x: F.count_if(F.col("state").isin(*x))
    return s.groupBy("pass").agg(F.count(F.lit(1)).alias("reviewed"), n("failed").alias("failed"), n("queued", "running").alias("missing"), n("completed").alias("eligible"))


@query("provenance_closure", """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey // 2 > 0), w AS (SELECT child, parent AS root, 1 AS depth FROM e UNION ALL SELECT w.child, e.parent, depth + 1 FROM w JOIN e ON e.child = w.root)
SELECT child, root, depth FROM w WHERE root NOT IN (SELECT child FROM e)""")
def provenance_closure(spark, d):
    e = read(spark, d, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent")).filter("parent > 0")
    return C.closure(e)


@query("inventory_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 3) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 10 <> 7) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL")
def inventory_diff(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    other = o.filter("k % 10 <> 7").withColumn("v", F.when(F.col("k") % 9 == 0, "X").otherwise(F.col("v")))
    return C.diff(o.filter("k % 10 <> 3"), other, "k", "v")


@query("source_drift", f"WITH {EPISODES} SELECT coalesce(e.episode_index, l.k) AS episode_index, CASE WHEN l.k IS NULL THEN 'added' WHEN e.episode_index IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT episode_index, length FROM episodes WHERE episode_index % 8 <> 1) e FULL JOIN (SELECT l_orderkey AS k, count(*) * 10 + (l_orderkey % 5 = 0)::INT AS length FROM lineitem GROUP BY l_orderkey) l ON l.k = e.episode_index WHERE e.length IS DISTINCT FROM l.length OR l.k IS NULL OR e.episode_index IS NULL")
def source_drift(spark, d):
    live = episodes(spark, d).filter("episode_index % 8 <> 1").select("episode_index", "length")
    imported = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode_index")).agg((F.count(F.lit(1)) * 10).alias("n"))
    imported = imported.select("episode_index", (F.col("n") + (F.col("episode_index") % 5 == 0).cast("int")).alias("length"))
    return C.diff(live, imported, "episode_index", "length")


@query("collected_vs_reported", "SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS collected, (SELECT count(*) FROM orders) AS reported, CASE WHEN (SELECT count(DISTINCT l_orderkey) FROM lineitem) = (SELECT count(*) FROM orders) THEN 'Ready' ELSE 'Updating' END AS state")
def collected_vs_reported(spark, d):
    a = read(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("collected"))
    b = read(spark, d, "orders").agg(F.count(F.lit(1)).alias("reported"))
    return a.crossJoin(b).withColumn("state", F.when(F.col("collected") == F.col("reported"), "Ready").otherwise("Updating"))


@query("episode_count_check", f"WITH {EPISODES}, f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT episode_index, length, coalesce(n, 0) AS n_frames FROM episodes LEFT JOIN f ON l_orderkey = episode_index WHERE length <> coalesce(n, 0)")
def episode_count_check(spark, d):
    f = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode_index")).agg(F.count(F.lit(1)).alias("n"))
    rows = episodes(spark, d).select("episode_index", "length").join(f, "episode_index", "left").withColumn("n_frames", F.coalesce("n", F.lit(0)))
    return rows.filter("length <> n_frames").drop("n")


@query("episode_uniqueness", "SELECT l_orderkey AS episode_index, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def episode_uniqueness(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode_index"), "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("l_linenumber")


@query("structure_validate", f"""WITH {FRAMES} SELECT episode_index, bool_and(frame_index >= 0 AND isfinite(timestamp)) AS finite, max(frame_index) + 1 = count(*) AS contiguous, bool_and(abs(timestamp - frame_index / 10.0) <= 0.0001 + 0.00001 * abs(frame_index / 10.0)) AS aligned, bool_and(len(action) = 4) AS width_ok FROM frames GROUP BY 1""")
def structure_validate(spark, d):
    t = F.col("frame_index") / 10
    aligned = F.abs(F.col("timestamp") - t) <= 1e-4 + 1e-5 * F.abs(t)
    return frames(spark, d).groupBy("episode_index").agg(F.bool_and((F.col("frame_index") >= 0) & ~F.isnan("timestamp")).alias("finite"), (F.max("frame_index") + 1 == F.count(F.lit(1))).alias("contiguous"), F.bool_and(aligned).alias("aligned"), F.bool_and(F.size("action") == 4).alias("width_ok"))


@query("alignment_check", f"WITH {FRAMES} SELECT episode_index, count(*) FILTER (WHERE abs(timestamp * 1.001 - frame_index / 10.0) <= 0.05) AS aligned, count(*) AS n FROM frames GROUP BY 1")
def alignment_check(spark, d):
    ok = F.abs(F.col("timestamp") * 1.001 - F.col("frame_index") / 10) <= 0.05
    return frames(spark, d).groupBy("episode_index").agg(F.count_if(ok).alias("aligned"), F.count(F.lit(1)).alias("n"))


@query("structural_gates", f"WITH {EPISODES} SELECT gate, count(*) FILTER (WHERE NOT ok) AS violations FROM (SELECT 'nonempty' AS gate, length > 0 AS ok FROM episodes UNION ALL SELECT 'seven_runs', coalesce({VALID}, FALSE) FROM episodes UNION ALL SELECT 'reviewer', reviewer IS NOT NULL FROM episodes) GROUP BY gate")
def structural_gates(spark, d):
    gates = {"nonempty": F.col("length") > 0, "seven_runs": F.coalesce(F.expr(VALID), F.lit(False)), "reviewer": F.col("reviewer").isNotNull()}
    rows = episodes(spark, d).select(F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("ok")) for k, v in gates.items()])))
    return rows.groupBy("gate").agg(F.count_if(~F.col("ok")).alias("violations"))


@query("export_gate", f"WITH {EPISODES} SELECT group_id, count(*) FILTER (WHERE review_state <> 'approved_reject') AS retained, count(*) FILTER (WHERE review_state IN ('pending', 'draft')) AS unreviewed, count(*) FILTER (WHERE review_state <> 'approved_reject') > 0 AND count(*) FILTER (WHERE review_state IN ('pending', 'draft')) = 0 AS publishable FROM episodes GROUP BY 1")
def export_gate(spark, d):
    s = F.col("review_state")
    kept, open_ = F.count_if(s != "approved_reject"), F.count_if(s.isin("pending", "draft"))
    return episodes(spark, d).groupBy("group_id").agg(kept.alias("retained"), open_.alias("unreviewed"), ((kept > 0) & (open_ == 0)).alias("publishable"))


@query("delete_episodes", f"WITH {EPISODES} SELECT episode_index AS source, row_number() OVER (ORDER BY episode_index) - 1 AS episode_index FROM episodes WHERE review_state <> 'approved_reject'")
def delete_episodes(spark, d):
    kept = episodes(spark, d).select("episode_index", "review_state").filter("review_state <> 'approved_reject'").withColumn("length", F.lit(1))
    return S.global_offsets(kept).select(F.col("episode_index").alias("source"), F.col("from_index").alias("episode_index"))


@query("build_export", f"WITH {EPISODES}, k AS (SELECT * FROM episodes WHERE {VALID} AND review_state = 'approved_keep') SELECT row_number() OVER (ORDER BY episode_index) - 1 AS episode_index, episode_index AS source, sum(length) OVER (ORDER BY episode_index ROWS UNBOUNDED PRECEDING)::BIGINT - length AS from_index, length FROM k")
def build_export(spark, d):
    k = episodes(spark, d).filter(VALID).filter("review_state = 'approved_keep'").select("episode_index", "length")
    number = S.global_offsets(k.select("episode_index", F.lit(1).alias("length"))).select("episode_index", F.col("from_index").alias("new"))
    return S.global_offsets(k).join(number, "episode_index").select(F.col("new").alias("episode_index"), F.col("episode_index").alias("source"), "from_index", "length")


@query("episode_statistics", f"WITH {LONG} SELECT episode_index, dim, count(*) AS count, {r('min(v)')} AS min, {r('max(v)')} AS max, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std FROM long GROUP BY ALL")
def episode_statistics(spark, d):
    long = T.long_form(frames(spark, d), 4)
    out = long.groupBy("episode_index", "dim").agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.select("episode_index", "dim", "count", *[rounded(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")])


@query("pooled_stats", f"WITH {LONG} SELECT dim, count(*)::BIGINT AS n, {r('avg(v)')} AS mean, {r('stddev_pop(v)', 3)} AS std, {r('min(v)')} AS min, {r('max(v)')} AS max FROM long GROUP BY dim")
def pooled_stats(spark, d):
    long = T.long_form(frames(spark, d), 4)
    parts = long.groupBy("episode_index", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    out = C.pooled_stats(parts, ["dim"])
    return out.select("dim", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std"), 3).alias("std"), rounded(F.col("min")).alias("min"), rounded(F.col("max")).alias("max"))


SEGMENTS = EPISODES + """,
seg AS (SELECT episode_index, length / 10.0::DOUBLE AS duration, unnest([1, 2, 3, 4, 5, 6, 7]) AS step, unnest([0, t2, t3, t4, t5, t6, t7]) / 10.0::DOUBLE AS s, unnest([t2, t3, t4, t5, t6, t7, length]) / 10.0::DOUBLE AS e FROM episodes WHERE length > 0),
g AS (SELECT *, s IS NULL AS gone, s IS NOT NULL AND e IS NULL AS bad, s IS NOT NULL AND e IS NOT NULL AS timed FROM seg),
w AS (SELECT *, lag(s) OVER p AS before_s, lag(e) OVER p AS before_e, lag(step) OVER p AS before_step, count(*) OVER p2 AS n_timed FROM g WHERE timed WINDOW p AS (PARTITION BY episode_index ORDER BY step), p2 AS (PARTITION BY episode_index)),
f AS (SELECT episode_index, bool_or(gone) AS open FROM g GROUP BY 1),
codes AS (
  SELECT episode_index, 'not_finite:' || step AS code FROM g WHERE bad
  UNION ALL SELECT episode_index, 'out_of_bounds:' || step FROM w WHERE NOT (0 <= s AND s < e AND e <= duration)
  UNION ALL SELECT episode_index, 'missing_steps' FROM f WHERE open
  UNION ALL SELECT episode_index, 'episode_complete' FROM f WHERE open
  UNION ALL SELECT episode_index, 'no_uncertainty' FROM f WHERE open
  UNION ALL SELECT DISTINCT episode_index, 'starts_not_rising' FROM w WHERE s <= before_s
  UNION ALL SELECT episode_index, 'early_end' FROM w JOIN f USING (episode_index) WHERE NOT open AND n_timed = 7 AND step = 7 AND abs(e - duration) > 0.5
  UNION ALL SELECT episode_index, 'not_adjacent:' || before_step || '-' || step FROM w JOIN f USING (episode_index) WHERE NOT open AND n_timed = 7 AND abs(before_e - s) > 0.5)
"""


@query("contract_validate", f"WITH {SEGMENTS} SELECT code, count(*) AS n, count(DISTINCT episode_index) AS episodes FROM codes GROUP BY code")
def contract_validate(spark, d):
    """Replies that claim to be complete, one for each episode with frames: a step without a start was not observed."""
    t = [F.lit(0).cast("bigint")] + [F.col(c) for c in C.STEPS] + [F.col("length")]
    second = lambda c: (c / 10).cast("double")
    segments = [F.struct(F.lit(k + 1).alias("step"), F.when(t[k].isNull(), "not_observed").otherwise("completed").alias("status"), second(t[k]).alias("start_s"), second(t[k + 1]).alias("end_s"), F.lit(0.9).alias("confidence")) for k in range(7)]
    rows = episodes(spark, d).filter("length > 0").select(
        "episode_index", second(F.col("length")).alias("duration"), F.lit(True).alias("episode_complete"), F.array().cast("array<int>").alias("missing_steps"),
        F.array().cast("array<string>").alias("uncertainties"), F.array(*segments).alias("segments"),
    )
    codes = P.contract_errors(rows).select("episode_index", F.explode("errors").alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("episode_index").alias("episodes"))


@query("generation_merge", f"WITH {EPISODES} SELECT episode_index, CASE WHEN length > 0 AND t2 IS NOT NULL THEN coalesce(t2 + 1, t2) ELSE t2 END AS t2, length > 0 AND t2 IS NOT NULL AS replaced FROM episodes")
def generation_merge(spark, d):
    """New values where the generation is valid; a failed one keeps the original."""
    e = episodes(spark, d).select("episode_index", "length", "t2")
    valid = (F.col("length") > 0) & F.col("t2").isNotNull()
    return e.select("episode_index", F.when(valid, F.col("t2") + 1).otherwise(F.col("t2")).alias("t2"), valid.alias("replaced"))


@query("flagged_semi", f"WITH {EPISODES} SELECT episode_index, length FROM episodes WHERE episode_index IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def flagged_semi(spark, d):
    flags = read(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("episode_index"))
    return episodes(spark, d).select("episode_index", "length").join(flags, "episode_index", "left_semi")


@query("linked_jobs", f"WITH {JOBS} SELECT DISTINCT job, k FROM log WHERE job = k % 1500 OR (state = 'completed' AND k = job * 10)")
def linked_jobs(spark, d):
    """A disjunction as a union of two equalities."""
    j = jobs(spark, d)
    return j.filter("job = k % 1500").select("job", "k").union(j.filter("state = 'completed' AND k = job * 10").select("job", "k")).distinct()


@query("publication_records", f"WITH {JOBS} SELECT o.o_orderkey AS k, l.first_line FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def publication_records(spark, d):
    first = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("first_line"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).join(first, "k", "left")


@query("publication_freshness", f"WITH {JOBS}, f AS (SELECT job, arg_min(k, (stamp, k)) AS first_k, arg_max(k, (stamp, k)) AS last_k FROM log GROUP BY job) SELECT job, first_k, md5((first_k % 3)::VARCHAR) <> md5((last_k % 3)::VARCHAR) AS changed FROM f")
def publication_freshness(spark, d):
    f = jobs(spark, d).groupBy("job").agg(F.min_by("k", F.struct("stamp", "k")).alias("first_k"), F.max_by("k", F.struct("stamp", "k")).alias("last_k"))
    h = lambda c: F.md5((F.col(c) % 3).cast("string").cast("binary"))
    return f.select("job", "first_k", (h("first_k") != h("last_k")).alias("changed"))


@query("episode_response", f"WITH {EPISODES}, {JOBS} SELECT episode_index, review_state, state AS proposal, CASE WHEN reviewer IS NULL THEN 'no_reviewer' ELSE '' END AS warnings FROM episodes LEFT JOIN log ON log.k = episode_index AND log.state = 'completed'")
def episode_response(spark, d):
    p = jobs(spark, d).filter("state = 'completed'").select(F.col("k").alias("episode_index"), F.col("state").alias("proposal"))
    return episodes(spark, d).join(p, "episode_index", "left").select("episode_index", "review_state", "proposal", F.when(F.col("reviewer").isNull(), "no_reviewer").otherwise("").alias("warnings"))


@query("facet_filter", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def facet_filter(spark, d):
    return read(spark, d, "customer").filter(F.lower("c_name").contains("00") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0)).select("c_custkey")


@query("proposal_statuses", f"WITH {EPISODES} SELECT episode_index, concat_ws(',', CASE WHEN t2 IS NULL THEN '2:missing' ELSE '2:ok' END, CASE WHEN t3 IS NULL THEN '3:missing' WHEN t3 <= t2 THEN '3:order' ELSE '3:ok' END) AS statuses FROM episodes")
def proposal_statuses(spark, d):
    two = F.when(F.col("t2").isNull(), "2:missing").otherwise("2:ok")
    three = F.when(F.col("t3").isNull(), "3:missing").when(F.col("t3") <= F.col("t2"), "3:order").otherwise("3:ok")
    return episodes(spark, d).select("episode_index", F.array_join(F.array_sort(F.array(three, two)), ",").alias("statuses"))


@query("contact_sheet_delta", f"WITH {EPISODES} SELECT episode_index, step, {r('(frame - step * 4) / 10.0::DOUBLE')} AS delta_s FROM (SELECT episode_index, unnest([2, 3, 4, 5, 6, 7]) AS step, unnest({_T}) AS frame FROM episodes) WHERE frame IS NOT NULL")
def contact_sheet_delta(spark, d):
    cells = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"t{k}").alias("frame")) for k in range(2, 8)])
    rows = episodes(spark, d).select("episode_index", F.inline(cells)).filter("frame IS NOT NULL")
    return rows.select("episode_index", "step", rounded((F.col("frame") - F.col("step") * 4) / 10).alias("delta_s"))
