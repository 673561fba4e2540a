"""Readers of episode datasets: metadata with a short-lived cache, schema from declared features, shards, run records."""

from __future__ import annotations

import json
import math
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Versions, element types and kinds of media of the datasets.
VERSIONS = ("v3.1", "v3.0", "v2.1", "v2.0")

#: Declared element types and what they are read as; half floats and unsigned 64-bit numbers have no type of their own.
TYPES = {
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
}
MEDIA = ("video", "image", "audio", "depth")


class InfoCache:
    """Dataset metadata by path, each entry for ``ttl`` seconds, the oldest dropped beyond ``size``."""

    def __init__(self, ttl: float = 300.0, size: int = 64, clock=time.monotonic):
        self.ttl, self.size, self.clock, self.held = ttl, max(8, size), clock, OrderedDict()

    def get(self, spark: SparkSession, root: str) -> dict:
        now = self.clock()
        if root in self.held and now - self.held[root][0] < self.ttl:
            self.held.move_to_end(root)
            return self.held[root][1]
        info = read_info(spark, root)
        self.held[root] = (now, info)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return info


def read_info(spark: SparkSession, root: str) -> dict:
    """``meta/info.json`` of a dataset; it must declare features and a known version."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{root}/meta/info.json", wholetext=True).collect())
    info = json.loads(text)
    if info.get("codebase_version") not in VERSIONS:
        raise ValueError(f"unsupported dataset version {info.get('codebase_version')!r}; known are {', '.join(VERSIONS)}")
    if not isinstance(info.get("features"), dict):
        raise ValueError("the dataset declares no features")
    return info


def feature_names(names) -> list[str] | None:
    """The list of names of a feature, under however many objects it lies."""
    while isinstance(names, dict):
        names = next(iter(names.values()), None)
    return list(names) if isinstance(names, list) else None


def schema(features: dict) -> T.StructType:
    """Columns of the declared features; media have none, vectors are arrays, names and shapes go to the metadata."""
    fields = []
    for name, f in features.items():
        if f["dtype"] in MEDIA:
            continue
        kind: T.DataType = TYPES[f["dtype"]]
        for n in reversed(f.get("shape") or [1]):
            if n != 1 or len(f.get("shape") or [1]) > 1:
                kind = T.ArrayType(kind)
        fields.append(T.StructField(name, kind, True, {"shape": f.get("shape"), "names": feature_names(f.get("names"))}))
    return T.StructType(fields)


def chartable(features: dict) -> list[str]:
    """Features that can be drawn: numbers or booleans of one dimension."""
    return [k for k, f in features.items() if f["dtype"] in TYPES and f["dtype"] != "string" and len(f.get("shape") or []) == 1]


def tolerant_select(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist; all if none is named."""
    return df.select(*[c for c in wanted if c in df.columns]) if wanted else df


def read_frames(spark: SparkSession, root: str, episodes: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Frames of all shards, or of some episodes; both filters and columns reach the scan."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/data")
    df = df.filter(F.col("episode_index").isin(episodes)) if episodes is not None else df
    return tolerant_select(df, columns or [])


def read_episodes(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Episode rows: JSON lines in the second layout, Parquet shards in the third."""
    if version.startswith("v2"):
        return spark.read.json(f"{root}/meta/episodes.jsonl")
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/meta/episodes")


def read_runs(spark: SparkSession, workspace: str) -> DataFrame:
    """Run records, one JSON file each; a broken one becomes a row with ``_corrupt_record``."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "run.json").json(f"{workspace}/runs")


def ignored_columns(features: dict) -> list[str]:
    """Numeric features of more than one dimension, which charts leave out."""
    return [k for k, f in features.items() if f["dtype"] in TYPES and f["dtype"] != "string" and len(f.get("shape") or []) > 1]


def size_and_cameras(info: dict) -> dict:
    """Size of data and videos in MB, to one digit, and the cameras with height and width."""
    size = (info.get("data_files_size_in_mb") or 0) + (info.get("video_files_size_in_mb") or 0)
    cameras = [{"name": k, "height": f["shape"][0], "width": f["shape"][1]} for k, f in info.get("features", {}).items() if f.get("dtype") == "video" and len(f.get("shape", ())) >= 2]
    return {"dataset_size_mb": math.floor(size * 10 + 0.5) / 10, "cameras": cameras}
