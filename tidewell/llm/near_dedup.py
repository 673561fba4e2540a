"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

A document is its set of distinct five-word shingles. Documents with the same set are one node. Each node has a
signature of ``HASHES`` minima; nodes that agree on a whole band of ``ROWS`` of them share a bucket, which two nodes
of similarity 0.75 miss in all ``HASHES / ROWS`` bands with a probability below 1e-5.

Candidates are taken in two steps, so that a bucket of any size never yields all its pairs:

1. each node of a bucket with the bucket's smallest node, one pair a node;
2. in buckets that still hold nodes of different components of the links so far, the other pairs of nodes of different
   components, compared inside tasks, block of nodes against block of nodes. Pairs within a component cannot change
   the result and are not compared. Nothing is capped: a bucket of n nodes has its n^2 / BLOCK^2 pairs of blocks
   spread over as many groups, and no pair becomes a row but the links that join two components. A block has about
   ``BLOCK`` nodes and ``BLOCK_BYTES`` of their sets, or fewer, so long texts make for more and smaller blocks.

A pair's signatures are compared in batches of ``BATCH``. After each batch the posterior of the similarity, from a
uniform prior and the agreements so far, prunes the pair once the chance that it reaches the threshold is below
``MISS``. Survivors are verified on their full shingle sets, with the exact integer test.

Defined cases: null, empty or blank texts have no shingles, are linked with nothing and stand for themselves; a text
of one to four words is one shingle; long texts are used whole; repeated rows and equal texts share a component, named
by its smallest ``doc_id``; rows without a ``doc_id`` take part through rows of equal text only and are kept if there
is none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, documents, map_texts, materialise, maybe_broadcast, release
from tidewell.llm.components import components

WORDS, THRESHOLD = 5, (75, 100)
HASHES, ROWS = 128, 4
BATCH, MISS = 32, 1e-4
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Elements of the sets that are counted at once.
SLICE = 8192
#: Bytes of texts that are shingled together; numpy holds some fifty times as many bytes meanwhile.
CHUNK_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _constants() -> dict[str, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return {"byte": draw[:256][lower], "space": space, "place": draw[256 : 256 + WORDS], "scale": draw[300 : 300 + HASHES], "shift": draw[600 : 600 + HASHES]}


def _stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    c = _constants()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    blank = c["space"][data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    lengths = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1 - starts
    power = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # of each byte in its word
    sums = np.add.reduceat(c["byte"][data[~blank]] * power[at], np.cumsum(lengths) - lengths)
    words = _stir(sums + lengths.astype(np.uint64))
    per_text = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))
    begin = np.cumsum(per_text) - per_text
    mixed = sum(words[k : len(words) - WORDS + 1 + k] * c["place"][k] for k in range(WORDS)) if len(words) >= WORDS else np.empty(0, np.uint64)
    mixed = _stir(mixed + np.uint64(WORDS))
    out = []
    for n, b in zip(per_text.tolist(), begin.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(mixed[b : b + n - WORDS + 1]))
        elif n:
            out.append(_stir(np.array([(words[b : b + n] * c["place"][:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of ``hashes`` under each of the functions, 32 bits each."""
    c = _constants()
    low = np.full(HASHES, ~np.uint64(0))
    for k in range(0, len(hashes), 1024):
        np.minimum(low, (c["scale"][:, None] * hashes[k : k + 1024] + c["shift"][:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame) -> DataFrame:
    """``row, doc_id, body, n, set_key, signature`` of each document; ``row`` is unique, ``body`` a hash of the text."""

    def compute(texts: list[str | None]) -> list[pa.Array]:
        sets = shingles(texts)
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        signatures = [signature(s).tobytes() if len(s) else None for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    out = map_texts(rows, ["doc_id", "body"], compute, "doc_id bigint, body bigint, n bigint, set_key binary, signature binary", CHUNK_BYTES)
    return out.select(F.monotonically_increasing_id().alias("row"), "*")


@lru_cache(maxsize=8)
def least_agreements(batch: int = BATCH, hashes: int = HASHES, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the agreements so far below which a similarity at the threshold or above is improbable.

    The posterior of the similarity after m agreements in n is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= THRESHOLD[0] / THRESHOLD[1]
    out = []
    for n in range(batch, hashes + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(int(np.argmax(p[:, above].sum(axis=1) / p.sum(axis=1) >= miss)))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) of signatures stay after all batches."""
    alive, agreed = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(least_agreements()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (a[i[alive], part] == b[j[alive], part]).sum(axis=1)
        stay = agreed >= least
        alive, agreed = alive[stay], agreed[stay]
    return alive


def _sizes_fit(a, b):
    """Sets of these sizes can reach the threshold."""
    return F.lit(THRESHOLD[1]) * F.least(a, b) >= F.lit(THRESHOLD[0]) * F.greatest(a, b)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, HASHES)


def _probable(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``a, b`` pairs, those that the posterior does not prune."""

    @F.pandas_udf("boolean")
    def stays(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        i = np.arange(len(a))
        if len(a):
            out[survivors(_matrix(a), _matrix(b), i, i)] = True
        return pd.Series(out)

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_fit(F.col("n_a"), F.col("n_b")))
    return both.filter(stays("s_a", "s_b")).select("a", "b")


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, hashes`` of the ``wanted`` nodes: their shingle sets, made again from their texts."""

    def sets(texts: list[str | None]) -> list[pa.Array]:
        raw = [s.tobytes() for s in shingles(texts)]
        return [pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())]

    wanted = materialise(wanted.distinct().join(nodes.select("node", "low", "set_key"), "node"), "wanted")
    ids = maybe_broadcast(wanted.select(F.col("low").alias("doc_id")).distinct(), wanted.count(), 64)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    texts = map_texts(texts, [], sets, "set_key binary, hashes binary", CHUNK_BYTES).groupBy("set_key").agg(F.first("hashes").alias("hashes"))
    out = materialise(wanted.join(texts, "set_key").select("node", "hashes"), "sets")
    discard(wanted)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) of sets reach the threshold.

    Many pairs of the same sets are counted at once, as products of 0/1 matrices over slices of the elements; sums of
    ones stay whole in 32-bit floats. The cheaper of this and pair by pair is taken.
    """
    own = [np.unique(k, return_inverse=True) for k in (i, j)]
    sides = [[s[k] for k in rows] for s, (rows, _) in zip((a, b), own, strict=True)]
    elements = np.unique(np.concatenate([*sides[0], *sides[1]])) if len(i) else np.empty(0, np.uint64)
    if len(i) * 40e-6 <= len(sides[0]) * len(sides[1]) * len(elements) * 1e-10:
        return np.array([similar(a[k], b[m]) for k, m in zip(i.tolist(), j.tolist(), strict=True)], bool)
    places = [(np.repeat(np.arange(len(side)), [len(s) for s in side]), np.searchsorted(elements, np.concatenate(side))) for side in sides]
    both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    for start in range(0, len(elements), SLICE):
        marks = []
        for side, (row, at) in zip(sides, places, strict=True):
            here = (at >= start) & (at < start + SLICE)
            m = np.zeros((len(side), SLICE), np.float32)
            m[row[here], at[here] - start] = 1
            marks.append(m)
        both += marks[0] @ marks[1].T
    sizes = [np.array([len(s) for s in side]) for side in sides]
    x, y = own[0][1], own[1][1]
    inter = both[x, y].astype(np.int64)
    return THRESHOLD[1] * inter >= THRESHOLD[0] * (sizes[0][x] + sizes[1][y] - inter)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of ``a, b`` pairs, those whose full shingle sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)

    full = _full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), nodes, docs)
    side = lambda x: full.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}"))
    out = materialise(pairs.join(side("a"), "a").join(side("b"), "b").filter(linked("h_a", "h_b")).select("a", "b"), "links")
    discard(full)
    return out


def _other_links(members: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that share a bucket: enough of them to join all that any pair there joins.

    A task gets two blocks of a bucket's nodes with signatures and full sets. A pair is left to the first band that it
    shares, pruned by its signatures, and verified; of the links those that join components are returned.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), (F.sum("size") * 8).alias("bytes")).filter("lo != hi AND n > 2")
    parts = F.ceil(F.greatest(F.col("n") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    rows = materialise(placed.join(mixed.select("bucket", parts.alias("parts")), "bucket"), "mixed")
    sets = _full_sets(rows.select("node"), nodes, docs)
    mixed_rows, full = rows, sets.join(nodes.select("node", "signature"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(full, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "leader", "root", "signature", "hashes")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(batches, ["bucket", "i", "j"]):
            i, j, band = (int(group[c].iloc[0]) for c in ("i", "j", "band"))
            x, y = group[group["own"] == i], group[group["own"] == j]
            if not len(x) or not len(y):
                continue
            sets = [[np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (x, y)]
            nodes_, roots_ = [[side[c].to_numpy() for side in (x, y)] for c in ("node", "root")]
            sizes = [np.array([len(h) for h in hs]) for hs in sets]
            low, high = np.minimum(sizes[0][:, None], sizes[1]), np.maximum(sizes[0][:, None], sizes[1])
            fit = (roots_[0][:, None] != roots_[1]) & (THRESHOLD[1] * low >= THRESHOLD[0] * high)
            lead = group["leader"].iloc[0]  # its pairs are done
            fit &= (nodes_[0][:, None] != lead) & (nodes_[1] != lead)
            if i == j:
                fit &= nodes_[0][:, None] < nodes_[1]
            p, q = np.nonzero(fit)
            a, b = _matrix(x["signature"]), _matrix(y["signature"])
            stay = survivors(a, b, p, q)
            p, q = p[stay], q[stay]
            shared = (a[p] == b[q]).reshape(len(p), HASHES // ROWS, ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band
            p, q = p[first], q[first]
            yes = similar_pairs(sets[0], sets[1], p, q)
            parent: dict[int, int] = {}

            def find(r: int, parent=parent) -> int:
                while (up := parent.get(r, r)) != r:
                    parent[r] = parent.get(up, up)
                    r = up
                return r

            out = []
            for k, m in zip(p[yes].tolist(), q[yes].tolist(), strict=True):
                r, t = find(int(roots_[0][k])), find(int(roots_[1][m]))
                if r != t:
                    parent[max(r, t)] = min(r, t)
                    out.append((int(nodes_[0][k]), int(nodes_[1][m])))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        release()

    out = materialise(rows.mapInPandas(compare, "a bigint, b bigint"), "links")
    discard(mixed_rows, sets)
    return out


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by ``keys``, each whole."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        for k, part in batch.groupby(keys, sort=False):
            if held and k != key:
                yield pd.concat(held)
                held = []
            key = k
            held.append(part)
    if held:
        yield pd.concat(held)


def near_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``, ``body``, a hash of its text, and ``group``.

    ``group`` names the component itself: several may share a ``component_id``, which is null or an id of several texts.
    """
    rows = materialise(sketches(docs), "sketches")
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    alike = some.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    nodes = materialise(alike.join(rows.select(F.col("row").alias("node"), "n", "signature"), "node"), "nodes")
    width = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(HASHES // ROWS)])
    banded = nodes.select("node", F.col("n").alias("size"), F.posexplode(bands).alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(banded.join(full.select("bucket", "leader"), "bucket"), "members")
    pairs = members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    probable = materialise(_probable(pairs, nodes), "pairs")
    links = _verified(probable, nodes, docs)
    roots = components(links)
    more = _other_links(members, nodes, roots, docs)
    named = nodes.select("node", "set_key", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not more.isEmpty():  # on from the components so far: only those that the new links join take part
        for end in ("a", "b"):
            more = more.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(end, F.coalesce(f"root_{end}", end))
        joined = components(more.select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("last"))
        named = named.join(maybe_broadcast(joined, joined.count(), 32), "root", "left").withColumn("root", F.coalesce("last", "root"))
    discard(probable, links, members)
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    sets = named.join(least, "root").select("set_key", "component_id", "root")
    out = rows.drop("signature").join(sets, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    group = F.coalesce(F.col("root").cast("string"), F.hex("set_key"))  # digits are at most 19, hex digits 32
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "body", group.alias("group"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, and all rows without shingles.

    Of a component the row of its smallest ``doc_id`` stays; of several such rows one, the one with the least hash.
    Rows without a ``doc_id`` that no other row's text equals are a component for each set of shingles.
    """
    found = materialise(near_dedup(docs), "components")
    stays = found.filter("kept AND n_shingles > 0").groupBy("group").agg(F.min("body").alias("stays"))
    found = found.filter("n_shingles > 0").join(stays, "group", "left")
    dropped = materialise(found.filter("NOT kept OR body != stays").select("doc_id", "body").distinct(), "dropped")
    again = materialise(found.filter("kept AND body = stays").groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("k_id"), F.xxhash64("text").alias("k_body"), F.struct(*docs.columns).alias("row"))
    same = lambda x: F.col("k_id").eqNullSafe(x["doc_id"]) & (F.col("k_body") == x["body"])
    dropped = maybe_broadcast(dropped, dropped.count(), 32)
    rows = rows.join(dropped, same(dropped), "left_anti")
    if not again.isEmpty():
        once = rows.join(again, same(again), "left_semi").dropDuplicates(["k_id", "k_body"])
        rows = rows.join(again, same(again), "left_anti").unionByName(once)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("body", "group")
