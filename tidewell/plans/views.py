"""The data model's tables as views of the star schema that queries run over, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames a second of the frame views.
FPS = 10

_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_index, frame_index, timestamp, mode, action, state``: suppliers as episodes, their lines as frames."""
    w = Window.partitionBy("l_suppkey").orderBy(*_LINE_ORDER)
    action = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("episode_index"),
        (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("mode"),
        action.alias("action"),
        F.coalesce(F.lag(action).over(w), action).alias("state"),
    )
    return rows.select("episode_index", "frame_index", (F.col("frame_index") / F.lit(FPS)).alias("timestamp"), "mode", "action", "state")


FRAMES = f"""
frames AS (
  SELECT l_suppkey AS episode_index, row_number() OVER w - 1 AS frame_index, (row_number() OVER w - 1) / {FPS}.0::DOUBLE AS timestamp,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS mode,
         [l_quantity, l_extendedprice, l_discount, l_tax] AS action,
         coalesce(lag([l_quantity, l_extendedprice, l_discount, l_tax]) OVER w, [l_quantity, l_extendedprice, l_discount, l_tax]) AS state
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {", ".join(_LINE_ORDER)}))
"""
#: One row for each dimension of the action.
LONG = FRAMES + """,
long AS (
  SELECT episode_index, frame_index, dim, v, v - lag(v) OVER (PARTITION BY episode_index, dim ORDER BY frame_index) AS delta
  FROM (SELECT episode_index, frame_index, unnest([0, 1, 2, 3]) AS dim, unnest(action) AS v FROM frames))
"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_index, frame_index, timestamp, value, event_type, event_id``: users as episodes, their events as frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), F.col("ts"))
    rows = read(spark, sf_dir, "events").withColumn("us", micros)
    return rows.select(
        F.col("user_id").alias("episode_index"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"),
        ((F.col("us") - F.first("us").over(w)) / F.lit(1e6)).alias("timestamp"), "value", "event_type", "event_id",
    )


EVENT_FRAMES = """
event_frames AS (
  SELECT user_id AS episode_index, row_number() OVER w - 1 AS frame_index,
         (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS timestamp, value, event_type, event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_index, seq, role, content, style, timestamp, camera``: conversations as episodes, their turns as atoms."""
    rows = read(spark, sf_dir, "conversations")
    style = (
        F.when(F.col("role") == "system", "task_aug")
        .when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "subtask")
        .when(F.col("role") == "assistant", "plan")
        .when(F.col("turn") % 3 == 0, "interjection")
        .otherwise("vqa")
    )
    return rows.select(
        F.col("conv_id").alias("episode_index"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), style.alias("style"),
        F.col("turn").cast("double").alias("timestamp"), F.when(style == "vqa", F.concat(F.lit("cam"), F.col("conv_id") % 2)).alias("camera"),
    )


ATOMS = """
atoms AS (
  SELECT conv_id AS episode_index, turn AS seq, role, text AS content, style, turn::DOUBLE AS timestamp,
         CASE WHEN style = 'vqa' THEN 'cam' || (conv_id % 2) END AS camera
  FROM (SELECT *, CASE WHEN role = 'system' THEN 'task_aug' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'subtask'
                       WHEN role = 'assistant' THEN 'plan' WHEN turn % 3 = 0 THEN 'interjection' ELSE 'vqa' END AS style FROM conversations))
"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_index, length, review_state, revision, reviewer, updated_at, chunk, t2..t7``: orders as episodes.

    The six transitions come from the key, so that some are missing, out of range or out of order.
    """
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = read(spark, sf_dir, "orders").join(counts, "o_orderkey", "left")
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "approved_keep").when(F.col("o_orderstatus") == "P", "draft").when(k % 7 == 0, "approved_reject").otherwise("pending")
    t = [F.when((k + i) % 11 != 0, (F.lit(i + 1) * 4 + (k * (i + 3)) % 5 - F.when(k % 13 == i, 9).otherwise(0))).cast("bigint").alias(f"t{i + 2}") for i in range(6)]
    return rows.select(
        k.alias("episode_index"), (F.coalesce("n", F.lit(0)) * 10).alias("length"), state.alias("review_state"), (k % 5).alias("revision"),
        F.when(k % 3 != 0, F.concat(F.lit("reviewer-"), k % 4)).alias("reviewer"), F.col("o_orderdate").alias("updated_at"), F.floor(k / 1000).alias("chunk"),
        F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("group_id"), *t,
    )


EPISODES = """
episodes AS (
  SELECT o_orderkey AS episode_index, coalesce(n, 0) * 10 AS length,
         CASE WHEN o_orderstatus = 'F' THEN 'approved_keep' WHEN o_orderstatus = 'P' THEN 'draft' WHEN o_orderkey % 7 = 0 THEN 'approved_reject' ELSE 'pending' END AS review_state,
         o_orderkey % 5 AS revision, CASE WHEN o_orderkey % 3 <> 0 THEN 'reviewer-' || (o_orderkey % 4) END AS reviewer, o_orderdate AS updated_at,
         o_orderkey // 1000 AS chunk, o_orderpriority AS priority, o_custkey AS group_id,
""" + ",\n".join(
    f"         CASE WHEN (o_orderkey + {i}) % 11 <> 0 THEN {i + 1} * 4 + (o_orderkey * {i + 3}) % 5 - CASE WHEN o_orderkey % 13 = {i} THEN 9 ELSE 0 END END AS t{i + 2}" for i in range(6)
) + """
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_index, start_frame, end_frame``: half-open intervals of frames, some touching or overlapping."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    suppliers = read(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("m"))
    rows = rows.crossJoin(F.broadcast(suppliers))
    start = F.col("k") * 7 % 400
    return rows.select((F.col("k") % F.col("m") + 1).alias("episode_index"), start.alias("start_frame"), (start + F.col("p_size") + 1).alias("end_frame"))


EXCLUSIONS = """
exclusions AS (
  SELECT p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS episode_index, p_partkey * 7 % 400 AS start_frame, p_partkey * 7 % 400 + p_size + 1 AS end_frame
  FROM part)
"""


def rounded(c, digits: int = 4):
    """Half up, as floor(x + 0.5); nulls and signs as they are."""
    k = 10.0**digits
    return F.floor(c * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def r(sql: str, digits: int = 4) -> str:
    """``rounded`` in SQL."""
    k = 10**digits
    return f"(floor(({sql}) * {k}.0 + 0.5)::DOUBLE / {k}.0)"
