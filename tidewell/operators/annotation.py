"""Language atoms: extraction, active state, prompts, instructions, remapping, findings.

Atoms have ``episode_index, seq, role, content, style, timestamp, camera``; ``seq`` is their place in the input, which
breaks ties where the first or the last of equals counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import per_episode
from tidewell.operators.ranks import global_rank, of_ids
from tidewell.operators.sequences import as_of

# Styles that hold from their time on, and styles of events at one frame.
PERSISTENT = ("task_aug", "subtask", "plan", "memory", "motion")
EVENTS = ("interjection", "vqa", "trace")


def column_for_style(style: Column) -> Column:
    """The column that holds atoms of a style; an unknown one is an error."""
    return (
        F.when(style.isNull() | style.isin(*EVENTS), "language_events")
        .when(style.isin(*PERSISTENT), "language_persistent")
        .otherwise(F.concat(F.lit("error: unknown style "), style))
    )


def extract(rows: DataFrame) -> DataFrame:
    """``episode_index, position, role, content, style, timestamp, camera``: the atoms that an episode's rows hold.

    ``rows`` has ``episode_index, frame_index, timestamp`` and two arrays of structs, ``language_persistent`` and
    ``language_events``. The persistent list repeats on every row, so the first row's counts; an event counts wherever it
    stands, at its row's time if it has none. Atoms without a role are none. Equal atoms count once; they are ordered by
    time, style and role, with a missing one first.
    """
    fields = ("role", "content", "style", "timestamp", "camera")
    first = rows.groupBy("episode_index").agg(F.min_by("language_persistent", "frame_index").alias("list"))
    lasting = first.select("episode_index", F.inline("list")).select("episode_index", *fields)
    events = rows.select("episode_index", F.col("timestamp").alias("s_at"), F.inline("language_events"))
    events = events.withColumn("timestamp", F.coalesce("timestamp", "s_at")).select("episode_index", *fields)
    atoms = lasting.unionByName(events).filter(F.col("role").isNotNull()).withColumn("timestamp", F.coalesce("timestamp", F.lit(0.0))).dropDuplicates()
    order = per_episode("timestamp", F.coalesce("style", F.lit("")), F.coalesce("role", F.lit("")), "content", "camera")
    return atoms.select("episode_index", (F.row_number().over(order) - 1).cast("bigint").alias("position"), *fields)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("s_k", F.row_number().over(w)).filter("s_k = 1").drop("s_k")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order``."""
    return first_wins(df, keys, [F.col(c).desc() for c in order])


def active_label(frames: DataFrame, atoms: DataFrame, style: str) -> DataFrame:
    """``frames`` with ``label`` and ``n_texts``: the text in force, and how many distinct ones share its time.

    Texts of one time are one change; the latest change at or before a frame is in force, null before the first.
    """
    changes = atoms.filter(F.col("style") == style).groupBy("episode_index", "timestamp").agg(F.count_distinct("content").alias("n"), F.min("content").alias("text"), F.min("seq").alias("seq"))
    changes = changes.withColumn("change", F.struct("n", "text"))
    out = as_of(frames, changes, "change")
    return out.withColumn("label", F.when(F.col("change.n") == 1, F.col("change.text"))).withColumn("n_texts", F.coalesce("change.n", F.lit(0))).drop("change")


def prompt_counts(kept: DataFrame, atoms: DataFrame) -> DataFrame:
    """``episode_index, unlabeled, ambiguous, labeled, retained``: retained frames by whether one label is in force."""
    rows = active_label(kept, atoms, "subtask")
    count = lambda c, name: F.count_if(c).alias(name)
    n = F.col("n_texts")
    return rows.groupBy("episode_index").agg(count(n == 0, "unlabeled"), count(n > 1, "ambiguous"), count(n == 1, "labeled"), F.count(F.lit(1)).alias("retained"))


def prompt_distribution(kept: DataFrame, atoms: DataFrame, fps: float) -> DataFrame:
    """``label, frames, episodes, seconds, ratio`` over all retained frames with one label in force."""
    rows = active_label(kept, atoms, "subtask")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    per = rows.filter("n_texts = 1").groupBy("label").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("episode_index").alias("episodes"))
    return per.crossJoin(F.broadcast(total)).select("label", "frames", "episodes", (F.col("frames") / fps).alias("seconds"), (F.col("frames") / F.col("total")).alias("ratio"))


def instruction(frames: DataFrame, atoms: DataFrame, task: str) -> DataFrame:
    """``frames`` with ``instruction``: the task, then the texts in force of subtask, plan, memory and interjection."""
    rows = frames
    for style in ("subtask", "plan", "memory", "interjection"):
        rows = as_of(rows, atoms.filter(F.col("style") == style).withColumn(f"{style}_text", F.col("content")), f"{style}_text")
    parts = [F.when(F.length(F.col(f"{s}_text")) > 0, F.concat(F.lit(f"{s.capitalize()}: "), F.col(f"{s}_text"))) for s in ("subtask", "plan", "memory", "interjection")]
    return rows.select(*frames.columns, F.concat_ws("\n", F.concat(F.lit("Task: "), F.col(task)), *parts).alias("instruction"))


def first_appearance_ids(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """``text, id``: distinct texts numbered from 0 in the order of their first appearance; the first of ``order`` is a whole number."""
    first = rows.groupBy(text).agg(F.min(F.struct(*order)).alias("s_first")).withColumn("s_lead", F.col("s_first")[order[0]])
    return global_rank(first, of_ids("s_lead"), ["s_first", text], "id").select(text, "id")


def remap_persistent(kept: DataFrame, atoms: DataFrame, fps: float) -> DataFrame:
    """Persistent atoms after clipping: ``episode_index, style, role, content, timestamp`` at the new times.

    ``kept`` has the retained ``frame_index`` and ``timestamp`` of each episode. For each (style, role, camera) the
    atom in force is emitted at the first retained frame on which it differs from the one emitted last.
    """
    numbered = kept.withColumn("new", F.row_number().over(per_episode("frame_index")) - 1)
    own = atoms.filter(F.col("style").isin(*PERSISTENT) & (F.col("style") != "task_aug"))
    keys = own.select("episode_index", "style", "role").distinct()
    marks = own.withColumn("atom", F.struct("seq", "content"))
    rows = as_of(numbered.join(keys, "episode_index"), marks, "atom", by=("episode_index", "style", "role"))
    w = Window.partitionBy("episode_index", "style", "role").orderBy("new")
    changed = F.col("atom").isNotNull() & ~F.lag("atom.seq").over(w).eqNullSafe(F.col("atom.seq"))
    return rows.withColumn("emit", changed).filter("emit").select("episode_index", "style", "role", F.col("atom.content").alias("content"), (F.col("new") / fps).alias("timestamp"))
