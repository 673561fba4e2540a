"""Projections and scalar rules: typing, series names, texts, hashes, JSON, colours, units, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import element

SERIES = " | "


def series_flatten(df: DataFrame, keys: list[str], vector: str, names: list[str]) -> DataFrame:
    """``keys, series, value``: a vector's elements as named series."""
    parts = [F.struct(F.lit(f"{vector}{SERIES}{n}").alias("series"), element(F.col(vector), k).alias("value")) for k, n in enumerate(names)]
    return df.select(*keys, F.inline(F.array(*parts)))


def suffix(series: Column) -> Column:
    """The part of a series name behind the first delimiter, or the whole name."""
    return F.coalesce(F.get(F.split(series, r" \| "), F.lit(1)), series)


def short_name(series: Column) -> Column:
    return F.element_at(F.split(series, r" \| "), -1)


def prefix(series: Column) -> Column:
    parts = F.split(series, r" \| ")
    return F.when(F.size(parts) > 1, F.trim(parts[0])).otherwise("other")


def to_finite(text: Column) -> Column:
    """A number from text; blanks, words and infinities are null."""
    d = F.trim(text).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def scale_groups(stats: DataFrame, near: float = 2.0, epsilon: float = 1e-9) -> list[list[str]]:
    """Series grouped greedily by scale, in the given order; ``stats`` has ``position, series, lo, hi``.

    A group's first series leads; a later one joins if the magnitudes of both its ends lie within ``near`` powers of
    ten of the leader's and it is not constant. The order decides, so this runs over the series' figures, a few
    hundred numbers of a schema, on the driver.
    """
    import math

    rows = [(r["series"], r["lo"], r["hi"]) for r in stats.orderBy("position").collect()]
    size = lambda x: math.log10(abs(x) + epsilon)
    out: list[list[str]] = []
    free = {s: (lo, hi) for s, lo, hi in rows if lo is not None and math.isfinite(lo) and math.isfinite(hi)}
    while free:
        lead, (lo, hi) = next(iter(free.items()))
        del free[lead]
        joined = [s for s, (a, b) in free.items() if a != b and abs(size(a) - size(lo)) <= near and abs(size(b) - size(hi)) <= near]
        for s in joined:
            del free[s]
        out.append([lead, *joined])
    return out


def template(path: str, **values: Column) -> Column:
    """A path template with ``{name}`` and ``{name:03d}`` filled from columns."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::0(\d)d)?\}", path):
        v = values[m[1]].cast("string")
        parts += [F.lit(path[at : m.start()]), F.lpad(v, F.greatest(F.length(v), F.lit(int(m[2]))), F.lit("0")) if m[2] else v]
        at = m.end()
    return F.concat(*parts, F.lit(path[at:]))


def blob_hash(content: Column) -> Column:
    """The SHA-1 that a content store names ``content`` by: its kind and size come first."""
    raw = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def total_time(frames: Column, fps: Column) -> Column:
    """Hours and minutes of so many frames; hours are left out if there are none."""
    seconds = frames / fps
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m"))).otherwise(F.concat(minutes, F.lit("m")))


def to_radians(value: Column, top: Column) -> Column:
    """Servo ticks about their middle, degrees or radians, by the largest size ``top`` of a column, in radians."""
    return F.when(top > 360, (value - 2048) / 2048 * F.pi()).when(top > 6.3, F.radians(value)).otherwise(value)


def color_slot(share: Column, slots: int = 256) -> Column:
    """The place in a table of colours of a number from 0 to 1; others count as the nearer end."""
    return F.greatest(F.lit(0), F.least(F.lit(slots - 1), F.floor(share * (slots - 1) + F.lit(0.5)))).cast("int")


def color(share: Column, table: list[tuple[int, int, int]]) -> Column:
    """Red, green and blue of a number from 0 to 1 in a table of colours."""
    return F.get(F.array(*[F.array(*map(F.lit, c)) for c in table]), color_slot(share, len(table)))


def join_nearest_name(joints: DataFrame, columns: DataFrame) -> DataFrame:
    """``joint, column, priority``: for each joint its best column: equal names, then one name that holds the other."""
    pairs = joints.crossJoin(F.broadcast(columns))
    j, c = F.lower("joint"), F.lower("column")
    priority = F.when(j == c, 1).when(F.regexp_replace(j, "[_-]", "") == F.regexp_replace(c, "[_-]", ""), 2).when(c.contains(j) | j.contains(c), 3)
    best = pairs.withColumn("priority", priority).filter("priority IS NOT NULL")
    return best.groupBy("joint").agg(F.min_by("column", F.struct("priority", "column")).alias("column"), F.min("priority").alias("priority"))


def whole_or(value: Column, fallback: float = 0.0) -> Column:
    """A whole number of any width as a double, or ``fallback``."""
    return F.coalesce(value.cast("double"), F.lit(float(fallback)))


def json_number(value: Column) -> Column:
    """A number as JSON has it: without a fraction if it has none."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def rounded_seconds(value: Column) -> Column:
    """Seconds to twelve digits."""
    return F.floor(value * 1e12 + F.lit(0.5)).cast("double") / 1e12
