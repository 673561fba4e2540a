"""Quality rules: gradient-boosted trees over document statistics, as flat numpy node arrays.

The statistics come from whole texts. Trees are grown on histograms of a bounded labelled sample with logistic loss;
for features named in ``MONOTONE`` a split is taken only if it keeps the prediction falling (or rising) along the
feature, and the bounds that a split sets hold in the whole subtree. All trees lie in four arrays (feature, threshold,
left child, value), so a batch is scored by a few array steps a tree level.

The sample: at most ``TRAIN_ROWS`` labelled documents, by the order of a hash of their id; only their statistics go to
the driver, one row for each id. Labels of an id that occurs more than once count as bad if any is; of several
documents under one id the one with the least statistics is learnt from.

Defined cases: a null text has no words, so it fails the base rule and is not kept; lines and words are as in the
contract; with no labelled rows, or of one class only, the method passes every text and the base rules decide alone;
null labels are not learnt from; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, maybe_broadcast, ship

TRAIN_ROWS = 6000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 40, 4, 0.3, 32, 1.0, 10
#: A text passes the method if its probability to be good is at least this.
PASS = 0.5

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct", "upper", "digits", "pipes", "marks", "words_a_line", "longest")
#: The direction in which the probability to be good may move along a feature.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "pipes": -1}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts, and the features of the method."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six white space characters
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeat = 0
    if n >= 3:
        m = len(numbers)
        _, pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
        _, which, count = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        twice = count[which] >= 2
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeat = int(hit.sum())
    at_least = max(n, 1)
    letters = max(chars, 1)
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    kinds = np.bincount(raw, minlength=128)
    features = [
        float(np.log1p(n)), chars / at_least, symbols / at_least, dup / max(len(lines), 1), repeat / at_least, len(numbers) / at_least,
        float(kinds[65:91].sum()) / letters, float(kinds[48:58].sum()) / letters, float(kinds[124]) / at_least,
        float(kinds[[33, 44, 46, 58, 59, 63]].sum()) / at_least, n / max(len(lines), 1), float(np.log1p(max(map(len, words), default=0))),
    ]
    return [n, chars, symbols, dup, repeat], features


class Trees:
    """Boosted trees in flat arrays; node k's children are ``left[k]`` and ``left[k] + 1``, a leaf is its own child."""

    def __init__(self, feature, threshold, left, value, roots, base):
        self.feature, self.threshold, self.left, self.value, self.roots, self.base = feature, threshold, left, value, roots, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.feature[node] >= 0
                right = inner & (x[rows, np.maximum(self.feature[node], 0)] > self.threshold[node])
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...]) -> Trees | None:
    """Trees for rows ``x`` with classes ``y``; None if there is one class only."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    value: list[float] = []
    roots = []

    def node(v: float) -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(len(left))
        value.append(v)
        return len(left) - 1

    def grow(k: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> None:
        best = (1e-6, -1, 0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(edges):
            b = bins[rows, f]
            n = len(e) + 1
            gl, hl, cl = (np.cumsum(np.bincount(b, w, minlength=n))[:-1] for w in (g[rows], h[rows], None))
            if not len(gl):
                continue
            wl, wr = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-(gs - gl) / (hs - hl + RIDGE), low, high)
            gain = -(gl * wl + 0.5 * (hl + RIDGE) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + RIDGE) * wr**2) - 0.5 * gs**2 / (hs + RIDGE)
            fair = (cl >= LEAST) & (len(rows) - cl >= LEAST) & (monotone[f] * (wr - wl) >= 0)
            gain = np.where(fair, gain, -1)
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), f, j)
        if best[1] < 0 or depth == DEPTH:
            return
        _, f, j = best
        go = bins[rows, f] > j
        weight = lambda r: float(np.clip(-g[r].sum() / (h[r].sum() + RIDGE), low, high))
        wl, wr = weight(rows[~go]), weight(rows[go])
        feature[k], threshold[k], value[k] = f, float(edges[f][j]), 0.0
        a, b = node(wl), node(wr)
        left[k] = a
        middle = (wl + wr) / 2
        up, down = monotone[f] > 0, monotone[f] < 0
        grow(a, rows[~go], g, h, depth + 1, middle if down else low, middle if up else high)
        grow(b, rows[go], g, h, depth + 1, middle if up else low, middle if down else high)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        root = node(0.0)
        roots.append(root)
        start = len(left)
        grow(root, np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0)
        for k in range(start, len(left)):
            value[k] *= RATE
        one = Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), [root], 0.0)
        margin += one.margin(x)
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), roots, base)


def train(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """The model, fit on at most ``TRAIN_ROWS`` labelled documents."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: statistics(t)[1])

    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    drawn = labels.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(maybe_broadcast(drawn, TRAIN_ROWS, 64), "doc_id").select("doc_id", "quality", features("text").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).collect()  # repeated ids don't add up
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows]), tuple(MONOTONE.get(f, 0) for f in FEATURES))


def score(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``doc_id``, the counts of whole texts, the base rules' verdict, the method's probability, and ``kept``."""

    ship(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS) + ", probability double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [statistics(t) for t in batch]
            out = pd.DataFrame([c for c, _ in rows], columns=list(COUNTS)).astype("int64")
            x = np.array([f for _, f in rows]).reshape(len(rows), len(FEATURES))
            yield out.assign(probability=model.probability(x) if model else 1.0)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), run("text").alias("r")).select("doc_id", "r.*").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= PASS))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
