"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix's words go to sources one at a time, each to the source with the highest quotient target / (2 words held + 1);
a source's words then go to its shards in the same way, by the shards' sizes. So a source of any size gets its target,
to within a word. A shard lines its documents up in a seeded order, repeats them in full as often as its quota allows,
and takes the rest as a run of that line, from a seeded block on. As the order is seeded too, these are random
documents, and only those at the ends of the picked run are cut, between words.

Sizes and hashes are the only things read from texts. A source is split into shards by a hash of ``doc_id`` and text, so
a source, or an id, that holds a third of all rows is laid out by many tasks. To the driver go one row for each source
and shard: at most ``MAX_SHARDS`` plus the number of sources, which a mix names one by one anyway; both lists are
broadcast only while they are small.

Defined cases: a null text has size 0, a null source is a source of its own, last in order; targets of empty sources
are 0; repeated rows count as often as they occur, and rows of equal id and size are told apart by their texts, so that
reruns agree; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, documents, materialise, maybe_broadcast, ship

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Words of a shard at least, and shards at most.
SHARD_WORDS, MAX_SHARDS = 200_000, 65_536
#: Blocks at which a run of words can start in a mix, if their size stays within these words.
BLOCKS, BLOCK_WORDS = 65_536, (1, 4096)
SEED = 20


def targets(sizes: list[int], weights: list[float], total: float, repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; none above ``repeats`` times its size, the excess shared again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > repeats * sizes[i]]
        for i in over or open_:
            out[i] = float(repeats * sizes[i]) if over else unit * weights[i]
            left -= out[i] if over else 0
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotient votes / (2 held + 1), none above its cap; ties go to the earlier one.

    All but a few seats are given at once: at the divisor of the even share no seat is given that the quotients
    would not give, and the rest go one by one.
    """
    held, whole = [0] * len(votes), sum(votes)
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    if whole > 0:
        held = [min(c, max(0, math.floor(v * seats / whole - 0.5))) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    heap = [(-v / (2 * held[i] + 1), i) for i, v in enumerate(votes) if v > 0 and held[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, source, size, body`` and ``more``: words of each whole text, and a hash of it."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size, F.xxhash64("text").alias("body"), *more)


def _number(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:7], "big")


def plan(sizes: DataFrame, rows: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """columns of ``rows`` or ``sizes``, and ``source_size, target, full, ranges``: repeats and picked word ranges.

    ``sizes`` has ``doc_id, source, size, body``; ``rows``, if given, the same and a struct ``row`` that is carried along.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums = sorted(((r["source"], int(r["n"])) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    total = sum(n for _, n in sums)
    words = max(SHARD_WORDS, -(-total // MAX_SHARDS))
    goal = targets([n for _, n in sums], [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sums))], TOTAL_SHARE * total)
    block = min(max(int(sum(goal)) // BLOCKS, BLOCK_WORDS[0]), BLOCK_WORDS[1])
    quotas = sainte_lague(goal, round(sum(goal)), [MAX_REPEATS * n for _, n in sums])
    per_source = [(s, n, goal[i], quotas[i], max(1, -(-n // words))) for i, (s, n) in enumerate(sums)]
    sources = maybe_broadcast(spark.createDataFrame(per_source, "s_source string, source_size bigint, target double, quota bigint, s_shards bigint"), len(per_source), 256)

    def dealt(df: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "body"), F.col("s_shards")).alias("shard")
        return df.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).select(*df.columns, "source_size", "target", shard)

    in_shard: dict = {}
    for r in dealt(sizes).groupBy("source", "shard").agg(F.sum("size").alias("n")).collect():
        in_shard.setdefault(r["source"], []).append((r["shard"], int(r["n"])))
    per_shard = []
    for source, _, _, quota, _ in per_source:
        own = sorted(in_shard.get(source, []))
        given = sainte_lague([float(n) for _, n in own], quota, [MAX_REPEATS * n for _, n in own])
        for (shard, n), q in zip(own, given, strict=True):
            full, rest = divmod(q, n) if n else (0, 0)
            per_shard.append((source, shard, n, full, rest, block * (_number(seed, source, shard) % max(1, -(-n // block)))))
    shards = maybe_broadcast(spark.createDataFrame(per_shard, "s_source string, s_shard bigint, words bigint, full bigint, rest bigint, first bigint"), len(per_shard), 256)
    order = Window.partitionBy("source", "shard").orderBy("s_at", "doc_id", "size", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes if rows is None else rows
    lined = dealt(rows).withColumn("s_at", F.xxhash64(F.lit(seed + 1), "doc_id", "body")).withColumn("s_from", F.coalesce(F.sum("size").over(order), F.lit(0)))
    lined = lined.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))

    def overlap(lo, hi):
        at = lambda x: F.greatest(F.lit(0), F.least(x - F.col("s_from"), F.col("size"))).cast("bigint")
        return F.struct(at(lo).alias("lo"), at(hi).alias("hi"))

    # the picked blocks follow each other in the seeded order, from a seeded one on and past the end from the start on
    to = F.col("first") + F.col("rest")
    picked = F.array(overlap(F.col("first"), F.least(to, F.col("words"))), overlap(F.lit(0), to - F.col("words")))
    return lined.select(*rows.columns, "source_size", "target", "full", F.filter(picked, lambda p: p["hi"] > p["lo"]).alias("ranges"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document, repeats counted."""
    p = plan(materialise(sized(docs), "sizes"), seed=seed)
    part = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, x: n + x["hi"] - x["lo"])
    return p.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + part).alias("taken"))


def cut(text: str, ranges: list) -> list[str]:
    """The parts of ``text`` from the first to the last word of each range, with what stands between them as it is."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    return [text if (lo, hi) == (0, len(spans)) else text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in ranges]


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each full repeat of a text and for each picked part."""

    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([cut(t or "", [(r["lo"], r["hi"]) for r in rs]) if len(rs) else [] for t, rs in zip(texts, ranges, strict=True)], dtype=object)

    rows = sized(docs, F.struct(*docs.columns).alias("row"))
    p = plan(materialise(sized(docs), "sizes"), rows, seed)
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("full").cast("int")), parts(F.col("row.text"), "ranges"))
    p = p.filter((F.col("size") > 0) & ((F.col("full") > 0) | (F.size("ranges") > 0))).select("row", F.explode(texts).alias("part"))
    return p.select(*[F.col("part").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
