"""Replies of a model: one JSON object each, checked strictly, its segments, and the fields that errors allow to repair."""

from __future__ import annotations

import json
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds by which a complete reply may miss the start, the end, and a neighbour.
START_GAP, END_GAP, STEP_GAP = 0.25, 0.5, 0.5
STEPS = 7


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


class _Twice(ValueError):
    pass


class _NotFinite(ValueError):
    pass


def _once(members: list) -> dict:
    out = dict(members)
    if len(out) < len(members):
        raise _Twice
    return out


def _no_constant(name: str):
    raise _NotFinite(name)


def reply_status(text: str | None) -> tuple[str, str | None]:
    """What is wrong with a reply, ``ok`` if nothing, and its object as JSON.

    A thinking block in front is cut. What follows must be one object and nothing else, without a member that stands
    twice and without numbers that JSON doesn't know.
    """
    if text is None:
        return "missing", None
    body = text.strip()
    if body.startswith("<think>"):
        _, closed, body = body.partition("</think>")
        if not closed:
            return "unterminated_think", None
    try:
        value = json.loads(body.strip(), object_pairs_hook=_once, parse_constant=_no_constant)
    except _Twice:
        return "duplicate_member", None
    except _NotFinite:
        return "nonfinite_number", None
    except json.JSONDecodeError as e:
        return ("trailing_text" if e.msg == "Extra data" else "invalid_json"), None
    except RecursionError:
        return "too_deep", None
    return ("ok", json.dumps(value)) if isinstance(value, dict) else ("not_an_object", None)


def _statuses(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([reply_status(t) for t in texts], columns=["status", "body"])


def parse_reply(text) -> Column:
    """A struct of ``status`` and ``body``, as ``reply_status`` gives them."""
    return F.pandas_udf(_statuses, "status string, body string")(text)


def contract_errors(replies: DataFrame) -> DataFrame:
    """``replies`` with ``errors``: all that their segments break, as codes.

    ``replies`` has ``duration, episode_complete, missing_steps, uncertainties`` and ``segments``, an array of structs
    ``step, status, start_s, end_s, confidence`` in the order of steps; status is completed, partial or not_observed.
    """
    seen = F.filter("segments", lambda s: s["status"] != "not_observed")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    known = lambda s: finite(s["start_s"]) & finite(s["end_s"]) & finite(s["confidence"])
    named = lambda code, step: F.concat(F.lit(f"{code}:"), step.cast("string"))
    unknown = F.transform(F.filter(seen, lambda s: ~known(s)), lambda s: named("not_finite", s["step"]))
    timed = F.filter(seen, known)
    inside = lambda s: (s["start_s"] >= 0) & (s["start_s"] < s["end_s"]) & (s["end_s"] <= F.col("duration"))
    rows = replies.withColumn("s_timed", timed).withColumn("s_open", F.transform(F.filter("segments", lambda s: s["status"] != "completed"), lambda s: s["step"]))
    outside = F.transform(F.filter("s_timed", lambda s: ~inside(s)), lambda s: named("out_of_bounds", s["step"]))
    pairs = F.zip_with(F.slice("s_timed", 1, F.greatest(F.size("s_timed") - 1, F.lit(0))), F.slice("s_timed", 2, F.greatest(F.size("s_timed"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    complete = F.size("s_open") == 0
    whole = complete & (F.size("s_timed") == F.size("segments")) & (F.size("s_timed") > 0)
    apart = F.transform(F.filter(pairs, lambda p: F.abs(p["a"]["end_s"] - p["b"]["start_s"]) > STEP_GAP), lambda p: F.concat(F.lit("not_adjacent:"), p["a"]["step"].cast("string"), F.lit("-"), p["b"]["step"].cast("string")))
    when = lambda c, code: F.when(c, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    parts = [
        F.when((F.col("duration") > 0) & finite(F.col("duration")), none).otherwise(F.array(F.lit("duration"))),
        unknown, outside,
        when(~F.coalesce("missing_steps", F.array().cast("array<int>")).eqNullSafe(F.col("s_open").cast("array<int>")), "missing_steps"),
        when(~F.col("episode_complete").eqNullSafe(complete), "episode_complete"),
        when(~complete & (F.size("uncertainties") <= 0), "no_uncertainty"),
        when(F.exists(pairs, lambda p: p["b"]["start_s"] <= p["a"]["start_s"]), "starts_not_rising"),
        when(whole & (F.abs(F.get("s_timed", F.lit(0))["start_s"]) > START_GAP), "late_start"),
        when(whole & (F.abs(F.element_at("s_timed", -1)["end_s"] - F.col("duration")) > END_GAP), "early_end"),
        F.when(whole, apart).otherwise(none),
    ]
    return rows.withColumn("errors", F.concat(*parts)).drop("s_timed", "s_open")


def repair_fields(error: Column, starts: Column, ends: Column, duration: Column) -> Column:
    """Struct of the steps whose start, and whose end, may be changed to repair ``error``, an error message."""
    none = F.array().cast("array<int>")
    step = F.regexp_extract(error, r"^step (\d+) must satisfy 0 <= start_s < end_s <= duration_s .+$", 1).try_cast("int")
    left = F.regexp_extract(error, r"^complete steps (\d+) and (\d+) must be adjacent within 0\.5 seconds$", 1).try_cast("int")
    right = F.regexp_extract(error, r"^complete steps (\d+) and (\d+) must be adjacent within 0\.5 seconds$", 2).try_cast("int")
    start, end = F.get(starts, step - 1), F.get(ends, step - 1)
    good_start = F.coalesce((start >= 0) & (start < duration), F.lit(False))
    good_end = F.coalesce((end > 0) & (end <= duration), F.lit(False))
    only_end = good_start & (~good_end | F.coalesce(end <= start, F.lit(False)))
    only_start = ~only_end & good_end & (~good_start | F.coalesce(start >= end, F.lit(False)))
    every = F.array(*[F.lit(k) for k in range(1, STEPS + 1)])
    is_ = lambda text: error == F.lit(text)
    first = (
        F.when(step.isNotNull() & only_end, none).when(step.isNotNull(), F.array(step)).when(right.isNotNull(), F.array(right))
        .when(is_("a complete response must start at 0 within 0.25 seconds"), F.array(F.lit(1)))
        .when(is_("non-null timed segments must have strictly increasing starts"), every)
        .when(is_("a complete response must yield six strictly increasing transition frames"), F.slice(every, 2, STEPS - 1)).otherwise(none)
    )
    last = (
        F.when(step.isNotNull() & only_start, none).when(step.isNotNull(), F.array(step)).when(left.isNotNull(), F.array(left))
        .when(is_("a complete response must end at duration within 0.5 seconds"), F.array(F.lit(STEPS))).otherwise(none)
    )
    return F.struct(first.alias("starts"), last.alias("ends"))


def redact(text: Column, secrets: Column) -> Column:
    """``text`` without the strings of the array ``secrets``, the longest first; empty ones are none."""
    longest = F.array_sort(F.filter(F.array_distinct(secrets), lambda s: F.length(s) > 0), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, s: F.replace(t, s, F.lit("[REDACTED]")))


def redact_deep(value, secrets: list[str]):
    """The same in nested lists and maps of a value on the driver."""
    if isinstance(value, str):
        return reduce(lambda t, s: t.replace(s, "[REDACTED]"), sorted(filter(None, set(secrets)), key=lambda s: (-len(s), s)), value)
    if isinstance(value, dict):
        return {k: redact_deep(v, secrets) for k, v in value.items()}
    return [redact_deep(v, secrets) for v in value] if isinstance(value, (list, tuple)) else value


def answer_kind(answer: Column) -> Column:
    """The kind of a question's JSON answer, by its members and their types; null if it has none of the known shapes."""
    v = F.try_parse_json(answer)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    list_ = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    there = lambda path: F.coalesce(kind(path) != "VOID", F.lit(False))
    truthy = there("point_format") & ~F.coalesce(F.try_variant_get(v, "$.point_format", "string").isin("", "false", "0"), F.lit(False))
    return (
        F.when(list_("detections"), "bbox").when(truthy & list_("point"), "keypoint").when(number("count") & text("label"), "count")
        .when(text("attribute") & there("value"), "attribute").when(text("subject") & text("relation"), "spatial")
    )


def valid_name(name: Column) -> Column:
    """Whether a dataset folder may have this name."""
    return name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,79}\z") & ~name.contains("..") & ~name.isin("frozen", "manifest.json")
