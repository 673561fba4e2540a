"""Brute-force counterparts of what the operators compute."""

from __future__ import annotations

import re

import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns whose names the operators use themselves.
CLASHING = ", row string, kept string, size string, node string, n string, body string, digest string, shard string, place string, line string"
CLASH = ("x",) * 10
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint" + CLASHING


def table(name: str, data: str = DATA) -> list[dict]:
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def frame(spark, rows):
    """Documents of (doc_id, text, lang, source), with further columns of clashing names."""
    return spark.createDataFrame([(d, t, la, s, None, *CLASH) for d, t, la, s in rows], DOCS)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(sets: dict):
    """The smallest id that each can reach over pairs of similarity 0.75 or more."""
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
