"""Queries: language atoms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import per_episode
from tidewell.operators import annotation as A
from tidewell.operators import sequences as S
from tidewell.plans.registry import query
from tidewell.plans.views import ATOMS, EPISODES, EVENT_FRAMES, atoms, episodes, event_frames, r, rounded

#: Frames of a conversation: ten a turn; every third run of five frames is dropped by clipping.
CONV_FRAMES = ATOMS + """,
conv_frames AS (SELECT episode_index, k AS frame_index, k / 10.0::DOUBLE AS timestamp, (k // 5) % 3 <> 1 AS kept
                FROM (SELECT episode_index, unnest(range(count(*) * 10)) AS k FROM atoms GROUP BY episode_index))
"""
CHANGES = CONV_FRAMES + """,
changes AS (SELECT episode_index, timestamp AS at, count(DISTINCT content) AS n, min(content) AS text FROM atoms WHERE style = 'subtask' GROUP BY ALL),
active AS (SELECT f.episode_index, f.frame_index, c.n, CASE WHEN c.n = 1 THEN c.text END AS label FROM (SELECT * FROM conv_frames WHERE kept) f
           ASOF LEFT JOIN changes c ON c.episode_index = f.episode_index AND c.at <= f.timestamp)
"""


def conv_frames(spark, d):
    n = atoms(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    k = n.select("episode_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") * 10 - 1)).alias("frame_index"))
    return k.withColumn("timestamp", F.col("frame_index") / 10)


def kept_frames(spark, d):
    return conv_frames(spark, d).filter("floor(frame_index / 5) % 3 <> 1")


@query("atoms_by_style", f"WITH {ATOMS} SELECT style, role, count(*) AS n, sum(length(content))::BIGINT AS chars FROM atoms GROUP BY ALL")
def atoms_by_style(spark, d):
    return atoms(spark, d).groupBy("style", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("atoms_ordered", f"WITH {ATOMS} SELECT episode_index, seq, row_number() OVER (PARTITION BY episode_index ORDER BY timestamp, coalesce(style, ''), coalesce(role, ''), seq) AS rank FROM atoms")
def atoms_ordered(spark, d):
    w = per_episode("timestamp", F.coalesce("style", F.lit("")), F.coalesce("role", F.lit("")), "seq")
    return atoms(spark, d).select("episode_index", "seq", F.row_number().over(w).cast("bigint").alias("rank"))


@query("partition_atoms", f"""WITH {ATOMS} SELECT episode_index, seq, CASE WHEN style IN ('interjection', 'vqa', 'trace') OR style IS NULL THEN 'language_events' ELSE 'language_persistent' END AS part,
row_number() OVER (PARTITION BY episode_index, style IN ('interjection', 'vqa', 'trace') OR style IS NULL ORDER BY timestamp, seq) AS rank FROM atoms""")
def partition_atoms(spark, d):
    rows = atoms(spark, d).withColumn("part", A.column_for_style(F.col("style")))
    return rows.select("episode_index", "seq", "part", F.row_number().over(Window.partitionBy("episode_index", "part").orderBy("timestamp", "seq")).cast("bigint").alias("rank"))


@query("column_for_style", f"""WITH {ATOMS}, s AS (SELECT DISTINCT style FROM atoms UNION SELECT 'nonsense' UNION SELECT 'motion' UNION SELECT NULL)
SELECT style, CASE WHEN style IS NULL OR style IN ('interjection', 'vqa', 'trace') THEN 'language_events' WHEN style IN ('task_aug', 'subtask', 'plan', 'memory', 'motion') THEN 'language_persistent'
ELSE 'error: unknown style ' || style END AS col FROM s""")
def column_for_style(spark, d):
    s = atoms(spark, d).select("style").union(spark.sql("SELECT * FROM VALUES ('nonsense'), ('motion'), (CAST(NULL AS STRING)) AS t(style)")).distinct()
    return s.select("style", A.column_for_style(F.col("style")).alias("col"))


@query("camera_filter", f"WITH {ATOMS} SELECT episode_index, seq FROM atoms WHERE camera IS NULL OR camera = 'cam1'")
def camera_filter(spark, d):
    return atoms(spark, d).filter(F.col("camera").isNull() | (F.col("camera") == "cam1")).select("episode_index", "seq")


@query("atom_validate", f"""WITH {ATOMS} SELECT episode_index, seq, CASE WHEN length(trim(coalesce(content, ''))) = 0 THEN 'missing_content' WHEN camera IS NOT NULL AND style NOT IN ('vqa', 'trace') THEN 'camera_not_allowed'
WHEN style IN ('task_aug', 'interjection') AND role <> 'user' THEN 'role_mismatch' ELSE 'ok' END AS code FROM atoms""")
def atom_validate(spark, d):
    style = F.col("style")
    code = (
        F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, "missing_content")
        .when(F.col("camera").isNotNull() & ~style.isin("vqa", "trace"), "camera_not_allowed")
        .when(style.isin("task_aug", "interjection") & (F.col("role") != "user"), "role_mismatch").otherwise("ok")
    )
    return atoms(spark, d).select("episode_index", "seq", code.alias("code"))


@query("prepare_atoms", f"WITH {ATOMS} SELECT episode_index, seq, style FROM atoms WHERE style IN ('task_aug', 'subtask', 'plan', 'memory', 'interjection') AND (style NOT IN ('task_aug', 'interjection') OR role = 'user') AND length(trim(content)) > 0")
def prepare_atoms(spark, d):
    style = F.col("style")
    usable = style.isin("task_aug", "subtask", "plan", "memory", "interjection") & (~style.isin("task_aug", "interjection") | (F.col("role") == "user")) & (F.length(F.trim("content")) > 0)
    return atoms(spark, d).filter(usable).select("episode_index", "seq", "style")


@query("speech_atoms", f"WITH {ATOMS} SELECT episode_index, seq, 'say' AS tool, content AS text FROM atoms WHERE role = 'assistant' AND seq % 5 = 3")
def speech_atoms(spark, d):
    """Speech as a nested tool call, built and read back."""
    call = F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit("say").alias("name"), F.create_map(F.lit("text"), F.col("content")).alias("arguments")).alias("function")))
    rows = atoms(spark, d).withColumn("tool_calls", F.when(F.col("seq") % 5 == 3, call)).filter((F.col("role") == "assistant") & (F.col("tool_calls")[0]["function"]["name"] == "say"))
    f = F.col("tool_calls")[0]["function"]
    return rows.select("episode_index", "seq", f["name"].alias("tool"), f["arguments"]["text"].alias("text"))


@query("atom_column_counts", f"WITH {ATOMS} SELECT episode_index, count(*) FILTER (WHERE style IN ('task_aug', 'subtask', 'plan', 'memory', 'motion')) AS persistent_rows, count(*) FILTER (WHERE style IN ('interjection', 'vqa', 'trace')) AS event_rows FROM atoms GROUP BY 1")
def atom_column_counts(spark, d):
    part = A.column_for_style(F.col("style"))
    return atoms(spark, d).groupBy("episode_index").agg(F.count_if(part == "language_persistent").alias("persistent_rows"), F.count_if(part == "language_events").alias("event_rows"))


@query("stage_atoms", f"WITH {ATOMS} SELECT CASE WHEN style = 'vqa' THEN 'vqa' WHEN style = 'interjection' THEN 'interjections' ELSE 'plan' END AS module, count(*) AS n, count(DISTINCT episode_index) AS episodes FROM atoms GROUP BY 1")
def stage_atoms(spark, d):
    module = F.when(F.col("style") == "vqa", "vqa").when(F.col("style") == "interjection", "interjections").otherwise("plan")
    return atoms(spark, d).groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("episode_index").alias("episodes"))


@query("persistent_key", f"WITH {ATOMS} SELECT concat_ws('|', style, role, coalesce(camera, '-')) AS key, count(*) AS n, min(timestamp) AS first_at FROM atoms GROUP BY 1")
def persistent_key(spark, d):
    return atoms(spark, d).groupBy(F.concat_ws("|", "style", "role", F.coalesce("camera", F.lit("-"))).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"))


@query("extract_atoms", f"WITH {ATOMS}, both_rows AS (SELECT *, 0 AS copy FROM atoms UNION ALL SELECT *, 1 FROM atoms WHERE style IN ('subtask', 'plan', 'task_aug')) SELECT episode_index, seq, style FROM both_rows WHERE copy = 0")
def extract_atoms(spark, d):
    """Persistent lists repeat on every row of an episode: the first row's count once; events count wherever they stand."""
    a = atoms(spark, d)
    lists = a.withColumn("copy", F.explode(F.when(F.col("style").isin(*A.PERSISTENT), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    kept = A.first_wins(lists.filter(F.col("style").isin(*A.PERSISTENT)), ["episode_index", "style", "role", "content", "timestamp", "camera"], ["copy", "seq"])
    return kept.unionByName(lists.filter(~F.col("style").isin(*A.PERSISTENT))).select("episode_index", "seq", "style")


@query("extract_atoms_server", f"""WITH {ATOMS}, x AS (SELECT DISTINCT episode_index, role, content, style, timestamp, camera FROM atoms)
SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY timestamp, coalesce(style, ''), coalesce(role, ''), content, camera NULLS FIRST) - 1 AS position FROM x""")
def extract_atoms_server(spark, d):
    """Rows of a table, a turn each: the first has the persistent list, later ones a stale one; events have no time of their own."""
    a = atoms(spark, d)
    parts = [F.col(c) for c in ("role", "content", "style", "timestamp", "camera")]
    lists = a.filter(F.col("style").isin(*A.PERSISTENT)).groupBy("episode_index").agg(F.collect_list(F.struct(*parts)).alias("list"))
    rows = a.join(lists, "episode_index", "left").withColumn("first", F.min("seq").over(per_episode()))
    stale = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("stale").alias("content"), F.lit("plan").alias("style"), F.lit(0.0).alias("timestamp"), F.lit(None).cast("string").alias("camera")))
    event = F.struct("role", "content", "style", F.lit(None).cast("double").alias("timestamp"), "camera")
    rows = rows.select("episode_index", F.col("seq").alias("frame_index"), "timestamp", F.when(F.col("seq") == F.col("first"), F.col("list")).otherwise(stale).alias("language_persistent"),
                       F.when(~F.col("style").isin(*A.PERSISTENT), F.array(event)).alias("language_events"))
    return A.extract(rows)


@query("read_atoms", f"WITH {ATOMS} SELECT episode_index, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM atoms GROUP BY 1")
def read_atoms(spark, d):
    a = atoms(spark, d)
    both = a.filter(F.col("style").isin(*A.PERSISTENT)).unionByName(a.filter(~F.col("style").isin(*A.PERSISTENT)))
    return both.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("atoms_all_rows", f"WITH {ATOMS} SELECT style, count(*) AS n FROM (SELECT DISTINCT episode_index, role, content, style, timestamp FROM atoms) GROUP BY style")
def atoms_all_rows(spark, d):
    return atoms(spark, d).select("episode_index", "role", "content", "style", "timestamp").distinct().groupBy("style").agg(F.count(F.lit(1)).alias("n"))


@query("legacy_atoms", f"""WITH {ATOMS}, segs AS (SELECT episode_index, seq, timestamp AS start, lead(timestamp) OVER (PARTITION BY episode_index ORDER BY seq) AS stop, content FROM atoms WHERE style = 'subtask')
SELECT episode_index, 'subtask' AS style, 'assistant' AS role, start AS timestamp, content FROM segs UNION ALL SELECT episode_index, 'plan', 'assistant', start, 'until ' || coalesce(stop::INT::VARCHAR, 'end') FROM segs""")
def legacy_atoms(spark, d):
    """Old segment records, each giving a subtask atom and a plan atom."""
    w = per_episode("seq")
    segs = atoms(spark, d).filter("style = 'subtask'").withColumn("stop", F.lead("timestamp").over(w))
    one = F.struct(F.lit("subtask").alias("style"), F.lit("assistant").alias("role"), F.col("timestamp"), F.col("content"))
    two = F.struct(F.lit("plan").alias("style"), F.lit("assistant").alias("role"), F.col("timestamp"), F.concat(F.lit("until "), F.coalesce(F.col("stop").cast("int").cast("string"), F.lit("end"))).alias("content"))
    return segs.select("episode_index", F.inline(F.array(one, two)))


@query("coerce_atom", f"WITH {ATOMS} SELECT episode_index, seq, nullif(coalesce(camera, ''), '') AS camera, coalesce(CASE WHEN seq % 3 <> 0 THEN timestamp END, seq / 2.0::DOUBLE) AS timestamp FROM atoms")
def coerce_atom(spark, d):
    stamp = F.when(F.col("seq") % 3 != 0, F.col("timestamp"))
    return atoms(spark, d).select("episode_index", "seq", F.nullif(F.coalesce("camera", F.lit("")), F.lit("")).alias("camera"), F.coalesce(stamp, F.col("seq") / 2).alias("timestamp"))


@query("sidecar_overlay", f"""WITH {ATOMS}, saved AS (SELECT episode_index, seq, 'saved' AS origin FROM atoms WHERE episode_index % 4 = 0 AND seq % 2 = 0),
has AS (SELECT DISTINCT episode_index FROM atoms WHERE episode_index % 4 = 0)
SELECT * FROM saved UNION ALL SELECT episode_index, seq, 'parquet' FROM atoms WHERE episode_index NOT IN (SELECT episode_index FROM has)""")
def sidecar_overlay(spark, d):
    """Saved atoms replace an episode's stored ones, also where none is saved."""
    a = atoms(spark, d).select("episode_index", "seq")
    has = a.filter("episode_index % 4 = 0").select("episode_index").distinct()
    saved = a.filter("episode_index % 4 = 0 AND seq % 2 = 0").withColumn("origin", F.lit("saved"))
    return saved.unionByName(a.join(has, "episode_index", "left_anti").withColumn("origin", F.lit("parquet")))


@query("prompt_counts", f"""WITH {CHANGES} SELECT episode_index, count(*) FILTER (WHERE n IS NULL) AS unlabeled, count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) FILTER (WHERE n = 1) AS labeled, count(*) AS retained FROM active GROUP BY 1""")
def prompt_counts(spark, d):
    return A.prompt_counts(kept_frames(spark, d), atoms(spark, d))


@query("prompt_distribution", f"""WITH {CHANGES} SELECT label, count(*) AS frames, count(DISTINCT episode_index) AS episodes, {r('count(*) / 10.0::DOUBLE')} AS seconds,
{r('count(*) / (SELECT count(*) FROM active)::DOUBLE', 8)} AS ratio FROM active WHERE n = 1 GROUP BY label""")
def prompt_distribution(spark, d):
    out = A.prompt_distribution(kept_frames(spark, d), atoms(spark, d), 10)
    return out.select("label", "frames", "episodes", rounded(F.col("seconds")).alias("seconds"), rounded(F.col("ratio"), 8).alias("ratio"))


@query("active_strict", f"""WITH {CHANGES} SELECT episode_index, frame_index, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'one' ELSE 'none' END AS state FROM active""")
def active_strict(spark, d):
    rows = A.active_label(kept_frames(spark, d), atoms(spark, d), "subtask")
    return rows.select("episode_index", "frame_index", F.when(F.col("n_texts") > 1, "ambiguous").when(F.col("n_texts") == 1, "one").otherwise("none").alias("state"))


_AT = lambda style: f"(SELECT arg_max(content, (timestamp, seq)) FROM atoms a WHERE a.episode_index = f.episode_index AND a.style = '{style}' AND a.timestamp <= f.timestamp)"


@query("instruction_text", f"""WITH {CONV_FRAMES} SELECT episode_index, frame_index, concat_ws(chr(10), 'Task: task ' || episode_index, 'Subtask: ' || {_AT('subtask')}, 'Plan: ' || {_AT('plan')},
'Memory: ' || {_AT('memory')}, 'Interjection: ' || {_AT('interjection')}) AS instruction FROM conv_frames f""")
def instruction_text(spark, d):
    f = conv_frames(spark, d).withColumn("task", F.concat(F.lit("task "), "episode_index"))
    return A.instruction(f, atoms(spark, d), "task").select("episode_index", "frame_index", "instruction")


@query("materialize_tasks", f"""WITH {CHANGES}, t AS (SELECT label, min(episode_index * 1000 + frame_index) AS first FROM active WHERE label IS NOT NULL GROUP BY 1), ids AS (SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS id FROM t)
SELECT a.episode_index, a.frame_index, ids.id AS task_index FROM active a LEFT JOIN ids USING (label)""")
def materialize_tasks(spark, d):
    """Each retained frame's label as a task id, ids by first appearance."""
    rows = A.active_label(kept_frames(spark, d), atoms(spark, d), "subtask")
    ids = A.first_appearance_ids(rows.filter("label IS NOT NULL"), "label", ["episode_index", "frame_index"])
    return rows.join(ids, "label", "left").select("episode_index", "frame_index", F.col("id").alias("task_index"))


@query("first_appearance_ids", f"WITH {EVENT_FRAMES} SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS id FROM event_frames GROUP BY 1")
def first_appearance_ids(spark, d):
    return A.first_appearance_ids(event_frames(spark, d), "event_type", ["event_id"])


@query("stable_tasks", "SELECT o_orderpriority AS prompt, min(o_orderkey % 97 + 1) AS step, row_number() OVER (ORDER BY min(o_orderkey % 97 + 1), encode(o_orderpriority)) - 1 AS task_index FROM orders GROUP BY 1")
def stable_tasks(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("prompt")).agg(F.min(F.col("o_orderkey") % 97 + 1).alias("step"))
    return rows.select("prompt", "step", (F.row_number().over(Window.orderBy("step", F.encode("prompt", "UTF-8"))) - 1).cast("bigint").alias("task_index"))


@query("remap_atoms", f"""WITH {CONV_FRAMES}, kept AS (SELECT episode_index, frame_index, timestamp, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS new FROM conv_frames WHERE kept),
own AS (SELECT * FROM atoms WHERE style IN ('subtask', 'plan', 'memory')),
act AS (SELECT k.episode_index, k.new, s.style, s.role, (SELECT arg_max(seq, (timestamp, seq)) FROM own o WHERE o.episode_index = k.episode_index AND o.style = s.style AND o.role = s.role AND o.timestamp <= k.timestamp) AS seq
        FROM kept k JOIN (SELECT DISTINCT episode_index, style, role FROM own) s ON s.episode_index = k.episode_index),
ch AS (SELECT *, lag(seq) OVER (PARTITION BY episode_index, style, role ORDER BY new) AS last FROM act)
SELECT ch.episode_index, ch.style, ch.role, o.content, {r('new / 10.0::DOUBLE')} AS timestamp FROM ch JOIN own o ON o.episode_index = ch.episode_index AND o.seq = ch.seq WHERE ch.last IS DISTINCT FROM ch.seq""")
def remap_atoms(spark, d):
    out = A.remap_persistent(kept_frames(spark, d), atoms(spark, d), 10)
    return out.withColumn("timestamp", rounded(F.col("timestamp")))


@query("prompt_sequence", f"""WITH {ATOMS}, p AS (SELECT unnest(['x', 'y']) AS prompt), s AS (SELECT episode_index, seq, chr((97 + (length(content) + 23) % 4)::INT) AS label FROM atoms WHERE style = 'subtask'),
l AS (SELECT episode_index, list(label ORDER BY seq) AS labels FROM s GROUP BY 1)
SELECT episode_index, code, count(*) AS n FROM (SELECT episode_index, 'missing_subtask' AS code FROM l, (SELECT unnest(['a', 'b']) AS want) WHERE NOT list_contains(labels, want)
UNION ALL SELECT episode_index, 'unexpected_subtask' FROM s WHERE label NOT IN ('a', 'b')
UNION ALL SELECT episode_index, 'subtask_order_mismatch' FROM l WHERE list_filter(labels, lambda x: x IN ('a', 'b')) <> list_filter(['a', 'b'], lambda x: list_contains(labels, x))) GROUP BY ALL""")
def prompt_sequence(spark, d):
    """Required labels a, b against those observed: missing, unexpected, or in another order."""
    s = atoms(spark, d).filter("style = 'subtask'").withColumn("label", F.chr((97 + (F.length("content") + 23) % 4)))
    l = s.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"]).alias("labels"))
    want = F.array(F.lit("a"), F.lit("b"))
    observed = F.filter("labels", lambda x: F.array_contains(want, x))
    expected = F.filter(want, lambda x: F.array_contains(F.col("labels"), x))
    counts = [("missing_subtask", F.size(F.filter(want, lambda x: ~F.array_contains(F.col("labels"), x)))), ("unexpected_subtask", F.size(F.filter("labels", lambda x: ~F.array_contains(want, x)))), ("subtask_order_mismatch", (observed != expected).cast("int"))]
    found = F.array(*[F.struct(F.lit(k).alias("code"), v.cast("bigint").alias("n")) for k, v in counts])
    return l.select("episode_index", F.inline(found)).filter("n > 0")


@query("label_diff", f"WITH {ATOMS} SELECT content FROM (SELECT DISTINCT content FROM atoms WHERE style = 'subtask') EXCEPT SELECT content FROM atoms WHERE style = 'plan'")
def label_diff(spark, d):
    a = atoms(spark, d)
    return a.filter("style = 'subtask'").select("content").distinct().join(a.filter("style = 'plan'").select("content"), "content", "left_anti")


@query("prompt_unique", f"WITH {ATOMS}, p AS (SELECT episode_index, trim(content) AS p FROM atoms WHERE style = 'subtask') SELECT episode_index, count(DISTINCT p) = count(*) AND bool_and(length(p) > 0) AS valid FROM p GROUP BY 1")
def prompt_unique(spark, d):
    p = atoms(spark, d).filter("style = 'subtask'").groupBy("episode_index").agg(F.collect_list(F.trim("content")).alias("p"))
    return p.select("episode_index", ((F.size(F.array_distinct("p")) == F.size("p")) & F.forall("p", lambda x: F.length(x) > 0)).alias("valid"))


@query("export_language_columns", f"""WITH {CONV_FRAMES} SELECT f.episode_index, f.frame_index, count(a.seq) AS n_events FROM conv_frames f LEFT JOIN atoms a ON a.episode_index = f.episode_index AND a.timestamp = f.timestamp
AND a.style IN ('interjection', 'vqa') GROUP BY ALL""")
def export_language_columns(spark, d):
    """Events on the frame of exactly their time."""
    ev = atoms(spark, d).filter(F.col("style").isin("interjection", "vqa")).groupBy("episode_index", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    return conv_frames(spark, d).join(ev, ["episode_index", "timestamp"], "left").select("episode_index", "frame_index", F.coalesce("n", F.lit(0)).alias("n_events"))


@query("groot_export", f"""WITH {CONV_FRAMES} SELECT f.episode_index, count(*) AS matched, count(*) FILTER (WHERE g.frame_index IS NULL) AS missing FROM conv_frames f
LEFT JOIN (SELECT * FROM conv_frames WHERE frame_index % 17 <> 3) g ON g.episode_index = f.episode_index AND g.frame_index = f.frame_index AND g.timestamp = f.timestamp GROUP BY 1""")
def groot_export(spark, d):
    f = conv_frames(spark, d)
    g = f.filter("frame_index % 17 <> 3").withColumn("there", F.lit(True))
    out = f.join(g, ["episode_index", "frame_index", "timestamp"], "left")
    return out.groupBy("episode_index").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("identity_join", f"""WITH {CONV_FRAMES}, g AS (SELECT episode_index, frame_index, timestamp FROM conv_frames WHERE frame_index % 17 <> 3 UNION ALL SELECT -1, 0, 0.0)
SELECT (SELECT count(*) FROM conv_frames f JOIN g USING (episode_index, frame_index, timestamp)) AS both_sides, (SELECT count(*) FROM conv_frames f ANTI JOIN g USING (episode_index, frame_index, timestamp)) AS only_source,
(SELECT count(*) FROM g ANTI JOIN conv_frames USING (episode_index, frame_index, timestamp)) AS only_annotated""")
def identity_join(spark, d):
    f = conv_frames(spark, d).select("episode_index", "frame_index", "timestamp")
    g = f.filter("frame_index % 17 <> 3").union(spark.sql("SELECT -1L, 0L, 0.0D"))
    side = f.withColumn("a", F.lit(1)).join(g.withColumn("b", F.lit(1)), ["episode_index", "frame_index", "timestamp"], "full")
    return side.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("b").isNull()).alias("only_source"), F.count_if(F.col("a").isNull()).alias("only_annotated"))


@query("merge_records", f"""WITH {EPISODES}, rec AS (SELECT episode_index % 500 AS id, 0 AS src, episode_index AS seq, priority AS v FROM episodes WHERE episode_index % 2 = 0 UNION ALL
SELECT episode_index % 700, 1, episode_index, review_state FROM episodes WHERE episode_index % 2 = 1)
SELECT id, arg_max(v, (src, seq)) AS v, min(src) AS first_src FROM rec GROUP BY id""")
def merge_records(spark, d):
    """Two lists merged by id: the later value wins, the place is the first appearance's."""
    e = episodes(spark, d)
    a = e.filter("episode_index % 2 = 0").select((F.col("episode_index") % 500).alias("id"), F.lit(0).alias("src"), F.col("episode_index").alias("seq"), F.col("priority").alias("v"))
    b = e.filter("episode_index % 2 = 1").select((F.col("episode_index") % 700).alias("id"), F.lit(1).alias("src"), F.col("episode_index").alias("seq"), F.col("review_state").alias("v"))
    return a.unionByName(b).groupBy("id").agg(F.max_by("v", F.struct("src", "seq")).alias("v"), F.min("src").alias("first_src"))


@query("first_wins_dedup", "SELECT o_custkey AS id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS v, count(*) AS n FROM orders GROUP BY 1")
def first_wins_dedup(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = o.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")))
    return A.first_wins(n, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("v"), "n")


@query("latest_wins", "SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS active FROM orders GROUP BY 1")
def latest_wins(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return A.last_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("active"))


@query("set_equality", f"""WITH {EPISODES} SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_right""")
def set_equality(spark, d):
    left = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k")).distinct().withColumn("a", F.lit(1))
    right = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return left.join(right, "k", "full").agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))
