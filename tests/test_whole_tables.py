"""Queries over whole tables, against brute force."""

import re

import pyarrow.parquet as pq
import pytest

from tidewell.plans import registry, scalars

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def lengths():
    n = {r["o_orderkey"]: 0 for r in table("orders")}
    for r in table("lineitem"):
        if r["l_orderkey"] in n:
            n[r["l_orderkey"]] += 10
    return n


def test_normalize_text_covers_every_document(spark):
    want = {r["doc_id"]: None if r["text"] is None else re.sub(r"[ \t\n\r]+", " ", r["text"].strip(" \t\n\r")) for r in table("documents")}
    assert {r["doc_id"]: r["t"] for r in QUERIES["normalize_text"](spark, DATA).collect()} == want


def test_episode_slice_covers_every_episode(spark):
    want, at = {}, 0
    for k, n in sorted(lengths().items()):
        want[k] = (at, max(at + n, at + 1))
        at += n
    assert {r["episode_index"]: (r["start"], r["stop"]) for r in QUERIES["episode_slice"](spark, DATA).collect()} == want


@pytest.mark.parametrize("target", [3000, 700, 7])
def test_episode_frame_info_samples_evenly(spark, monkeypatch, target):
    monkeypatch.setattr(scalars, "OVERVIEW_EPISODES", target)
    n = lengths()
    keys = sorted(n)
    at = range(len(keys)) if len(keys) <= target else [int(i * (len(keys) - 1) / (target - 1) + 0.5) for i in range(target)]
    want = {(keys[i], c): (0.0, max(0.0, n[keys[i]] / 10 - 0.05)) for i in at for c in ("front", "wrist")}
    rows = QUERIES["episode_frame_info"](spark, DATA).collect()
    assert len(rows) == len(want) and {(r["episode_index"], r["camera"]): (r["first_s"], r["last_s"]) for r in rows} == want


def test_merge_groups_covers_every_episode(spark):
    rows = QUERIES["merge_groups"](spark, DATA).collect()
    f = {(r["episode_index"], r["frame_index"]): r for r in scalars.frames(spark, DATA).collect()}
    assert len(rows) == len(f) == len(table("lineitem"))
    for r in rows:
        x = f[r["episode_index"], r["frame_index"]]
        b = x["state"][1] if r["frame_index"] % 3 == 0 else x["action"][1]
        assert float(r["a"]) == pytest.approx(float(x["action"][0]), abs=1e-3) and float(r["b"]) == pytest.approx(float(b), abs=1e-3)


def test_adjacent_episodes_covers_every_episode(spark):
    keys = set(lengths())
    want = sorted((k, k + i) for k in keys for i in (-2, -1, 1, 2) if k + i in keys)
    assert sorted((r["episode_index"], r["neighbour"]) for r in QUERIES["adjacent_episodes"](spark, DATA).collect()) == want
