"""Products of series with themselves or each other at many lags, in numpy, over chunks of an episode's frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a chunk; an episode of any length is spread over as many tasks as it has chunks.
CHUNK = 4096


def lag_sums(series: DataFrame, pairs: int, first: int, last: int, chunk: int = CHUNK) -> DataFrame:
    """``episode_index, pair, lag, xy, xx, yy``: sums over ``t`` of ``x[t] y[t + lag]`` and of the squares that take part.

    ``series`` has ``episode_index, t`` (from 0, without gaps), ``n``, the length, ``xs`` and ``ys``, arrays of ``pairs``
    values. A chunk gets the frames around it that its lags reach, so each product is taken by exactly one chunk.
    """
    own = F.floor(F.col("t") / chunk)
    reach = [own] + [F.floor((F.col("t") - F.lit(k)) / chunk) for k in (first, last)]
    parts = F.array_distinct(F.filter(F.array(*reach), lambda c: (c >= 0) & (c * chunk < F.col("n"))))
    rows = series.withColumn("chunk", F.explode(parts))
    lags = np.arange(first, last + 1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        t, n, c = group["t"].to_numpy(), int(group["n"].iloc[0]), int(group["chunk"].iloc[0])
        x, y = (np.stack(group[k].to_numpy()).astype(float) for k in ("xs", "ys"))
        low, begin, end = int(t[0]), c * chunk, min(n, (c + 1) * chunk)
        out = np.zeros((3, len(lags), pairs))
        for k, lag in enumerate(lags.tolist()):
            a, b = max(begin, -lag), min(end, n - lag)
            if a < b:
                u, v = x[a - low : b - low], y[a - low + lag : b - low + lag]
                out[:, k] = (u * v).sum(0), (u * u).sum(0), (v * v).sum(0)
        made = {"episode_index": group["episode_index"].iloc[0], "pair": np.tile(np.arange(pairs), len(lags)), "lag": np.repeat(lags, pairs)}
        return pd.DataFrame(made | {name: out[i].ravel() for i, name in enumerate(("xy", "xx", "yy"))})

    sums = rows.groupBy("episode_index", "chunk").applyInPandas(run, "episode_index bigint, pair int, lag int, xy double, xx double, yy double")
    return sums.groupBy("episode_index", "pair", "lag").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
