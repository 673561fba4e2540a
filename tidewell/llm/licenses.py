"""License scans by a positional rare-token index.

Templates are word sequences with mandatory key phrases. The index holds, for each of a template's rarest words by
inverse document frequency over the templates, where it stands in which template. A file's words are looked up;
every hit votes for the template starting at its place less the word's offset; starts that all of a template's rare
words agree on, give or take ``SLACK`` words, are compared word by word, and count if enough words match and every
key phrase stands there in full.

A bare phrase is a template that is its own key phrase, so its starts are exactly the places where its words stand
consecutively: each such place holds the phrase's rarest word, and each hit of that word is verified. No file is cut
and no list of hits is capped.

Defined cases: a null or empty text has no words and no places; places may overlap; a file with several labels lists
all, sorted; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, ship

#: The words of the contract: anything but ASCII that is no digit or lower-case letter, after lower-casing A-Z.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases that every scan reports, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices by label, then the phrases that a match must hold in full.
NOTICES = (
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", ("waived all copyright",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

#: Rare words of a template that are indexed, words that a start may be off, and the share of words that must match.
RARE, SLACK, SHARE = 3, 2, 0.7


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool


class Index:
    """Positional postings of the rarest words of each template."""

    def __init__(self, base: dict[str, str] = BASE, notices=NOTICES):
        phrase = lambda s: tuple(s.encode().split())
        self.templates = [Template(label, phrase(p), (phrase(p),), True) for p, label in base.items()]
        self.templates += [Template(label, phrase(p), tuple(map(phrase, keys)), False) for label, p, keys in notices]
        df = Counter(w for t in self.templates for w in set(t.words))
        self.idf = {w: math.log((1 + len(self.templates)) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare: list[set[bytes]] = []
        for k, t in enumerate(self.templates):
            ranked = sorted(dict.fromkeys(t.words), key=lambda w: (-self.idf[w], -len(w), w))
            rare = ranked[: 1 if t.base else RARE]
            self.rare.append(set(rare))
            for at, w in enumerate(t.words):
                if w in self.rare[k]:
                    self.postings[w].append((k, at))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Base places, base labels, all labels, and the best share of a template's words that matched."""
        votes: dict[int, dict[int, set[bytes]]] = {}
        postings = self.postings
        for at, w in enumerate(words):
            if w in postings:
                for k, offset in postings[w]:
                    votes.setdefault(k, {}).setdefault(at - offset, set()).add(w)
        places: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        score = 0.0
        for k, starts in votes.items():
            t = self.templates[k]
            if t.base:
                found = [s for s in starts if s >= 0 and tuple(words[s : s + len(t.words)]) == t.words]
                if found:
                    places += found
                    base.add(t.label)
                    score = 1.0
                continue
            for s in starts:
                agreed: set[bytes] = set()
                for d in range(-SLACK, SLACK + 1):
                    agreed |= starts.get(s + d, set())
                if agreed != self.rare[k]:
                    continue
                span = words[max(0, s - SLACK) : s + len(t.words) + SLACK]
                there = Counter(span)
                share = sum(min(n, there[w]) for w, n in Counter(t.words).items()) / len(t.words)
                if share >= SHARE and all(_holds(span, key) for key in t.keys):
                    labels.add(t.label)
                    score = max(score, share)
        return places, base, labels | base, score


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words) - len(phrase) + 1))


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """Licence words, places, labels and score of each whole text."""
    ship(docs.sparkSession)
    index = index or Index()

    @F.pandas_udf(SCHEMA.partition(", ")[2])
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                words = words_of(text)
                places, base, labels, score = index.scan(words)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64", "score": "float64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), run("text").alias("r")).select("doc_id", "r.*")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
