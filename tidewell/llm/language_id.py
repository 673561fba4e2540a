"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text. A document is parsed
greedily, from its first symbol to its last, into longest substrings of the labelled text; the phrases needed, times
log2 of the labelled length, over the document's length estimate its cross entropy against the language. The language
with the least wins.

Texts are lower-cased; each run of characters that are not letters is one separator. Every letter of the labelled texts
is a symbol of its own, however many there are; a letter that no labelled text has is a phrase of its own in every
language. The automata are built once, on the driver, and shipped as lists of transitions; each worker lays a list out
as one table, or searches it by halving where the table would exceed ``TABLE_BYTES``, with the same result.

Pieces of ``PIECE`` symbols are parsed side by side, so no Python loop runs over single characters. A parse that
starts at a piece's border soon stands in the same state as the parse that comes from the left, and from there on both
agree; what the two differ by up to that point is found by running them together, all pieces at once. Where they have
not met by the piece's end, the parse from the left is followed symbol by symbol until they do. So the count is that of
one parse of the whole text, whatever its length.

The model is fit on a bounded sample of the labelled rows: at most ``TRAIN_DOCS`` documents a language, the first in the
order of a hash of their id and text, until they reach ``TRAIN_CHARS`` characters. Only that sample goes to the driver.

Defined cases: a null text, an empty text and a text without letters get ``und`` and score 0; so do all texts if no
labelled row exists; ``n_letters`` tells the two apart. Equal costs go to the language whose name comes first. Repeated
rows get equal results, and are learnt from once. A null ``doc_id`` counts as the empty string when rows are held out.
Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewell.llm.common import chunks, documents, held, release, ship

TRAIN_DOCS, TRAIN_CHARS = 400, 50_000
#: Symbols of a piece, and bytes of texts that are parsed together, or one text.
PIECE, CHUNK_BYTES = 512, 1 << 20
#: Bytes of a language's table of transitions at most.
TABLE_BYTES = 64 << 20
UND = "und"


def transitions(text: list[int], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The suffix automaton of a sequence of symbols below ``width``.

    ``state * width + symbol`` of each transition, in order, the state that it leads to, and the number of states.
    """
    follow: dict[int, int] = {}
    symbols: list[list[int]] = [[]]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(symbols)
        symbols.append([])
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and p * width + c not in follow:
            follow[p * width + c] = new
            symbols[p].append(c)
            p = link[p]
        if p >= 0:
            q = follow[p * width + c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(symbols)
                symbols.append(list(symbols[q]))
                for x in symbols[q]:
                    follow[clone * width + x] = follow[q * width + x]
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow.get(p * width + c) == q:
                    follow[p * width + c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    keys = np.fromiter(follow, np.int64, len(follow))
    targets = np.fromiter(follow.values(), np.int64, len(follow))
    order = np.argsort(keys)
    return keys[order], targets[order].astype(np.int32), len(symbols)


class Automaton:
    """A suffix automaton that counts phrases.

    A state is kept as its number times ``width``. A step gives ``next state << 2 | phrases ended``: a symbol that does
    not continue the phrase ends it and begins the next one; a symbol that is nowhere in the labelled text is a phrase
    of its own. State 0 is the root.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, states: int, width: int, size: int, table_bytes: int = TABLE_BYTES):
        self.width, self.bits = width, float(np.log2(size + 2))
        codes = (targets.astype(np.int64) * width) << 2
        root = np.full(width, 2, np.int64)  # the symbol is not there: the phrase before it and the symbol itself are ended
        first = keys < width
        root[keys[first]] = codes[first] | 1
        self.root, self.table = root, None
        if states * width * 4 <= table_bytes:
            self.table = np.tile(root.astype(np.int32), states)
            self.table[:width] = np.where(root == 2, 1, root & ~np.int64(3))
            self.table[keys] = codes
        else:
            self.keys, self.codes = keys, codes

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state + symbol)
        key = state.astype(np.int64) + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        code = np.where(self.keys[at] == key, self.codes[at], self.root[symbol])
        return np.where((state == 0) & (code == 2), 1, code)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Phrases of the parses of the texts that stand in ``symbols`` from ``starts`` on with ``sizes``."""
        n = -(-sizes // piece)
        text = np.repeat(np.arange(len(sizes)), n)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[text] + at * piece
        size = np.minimum(piece, sizes[text] - at * piece)
        order = np.argsort(-size, kind="stable")  # the longest first, so that those still at work stand in front
        end, count = self._run(symbols, begin[order], size[order], np.zeros(len(order), np.int64))
        ends, own = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        ends[order], own[order] = end, count
        # the parse from the left, beside the piece's own, until both stand in one state
        late = np.flatnonzero(at > 0)
        late = late[np.argsort(-size[late], kind="stable")]
        extra = np.zeros(len(order), np.int64)
        apart, left = self._meet(symbols, begin[late], size[late], ends[late - 1], extra, late)
        total = np.bincount(text, weights=own + extra, minlength=len(sizes)).astype(np.int64)
        last = np.cumsum(n) - 1
        some = n > 0
        total[some] += ends[last[some]] > 0
        if len(apart):
            for t in np.unique(text[apart]):
                mine = np.flatnonzero(text == t)
                total[t] = self._follow(symbols, begin[mine], size[mine], ends[mine], own[mine], extra[mine], set((apart[text[apart] == t] - mine[0]).tolist()), dict(zip(apart - mine[0], left, strict=True)))
        return total

    def _run(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each piece, and the phrases ended in it; ``size`` falls."""
        state, count = state.astype(np.int32 if self.table is not None else np.int64), np.zeros(len(begin), np.int64)
        working = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for k, m in enumerate(working.tolist()):
            code = self.step(state[:m], symbols.take(begin[:m] + k))
            count[:m] += code & 3
            state[:m] = code >> 2
        return state.astype(np.int64), count

    def _meet(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, extra: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Add to ``extra`` the phrases that the parses from ``state`` end more than those from the root, until both meet.

        Returns the pieces, as numbered by ``of``, at whose end they are still apart, and the states of the former there.
        """
        kind = np.int32 if self.table is not None else np.int64
        a, b = state.astype(kind), np.zeros(len(state), kind)
        lanes = np.flatnonzero(a != b)
        apart, left = [], []
        k = 0
        while len(lanes):
            done = size[lanes] <= k
            if done.any():
                apart += of[lanes[done]].tolist()
                left += a[lanes[done]].tolist()
                lanes = lanes[~done]
                continue
            symbol = symbols.take(begin[lanes] + k)
            x, y = self.step(a[lanes], symbol), self.step(b[lanes], symbol)
            extra[of[lanes]] += (x & 3).astype(np.int64) - (y & 3)
            a[lanes], b[lanes] = x >> 2, y >> 2
            k += 1
            lanes = lanes[(x >> 2) != (y >> 2)]
        return np.array(apart, np.int64), left

    def _follow(self, symbols, begin, size, ends, own, extra, apart: set[int], left: dict[int, int]) -> int:
        """Phrases of one text some of whose pieces end with the two parses apart."""
        total, state, known = int(own[0]), int(ends[0]), True  # known: the parse from the left stands where the piece's own does
        for j in range(1, len(begin)):
            if known and j not in apart:
                total += int(own[j] + extra[j])
                state = int(ends[j])
                continue
            if known:
                total += int(own[j] + extra[j])
                state = int(left[j])
            else:
                for c in symbols[begin[j] : begin[j] + size[j]].tolist():
                    code = self.one(state, c)
                    total += code & 3
                    state = code >> 2
            known = state == int(ends[j])
        return total + (state > 0)

    def one(self, state: int, symbol: int) -> int:
        if self.table is not None:
            return int(self.table[state + symbol])
        return int(self.step(np.array([state]), np.array([symbol]))[0])


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Symbols:
    """Symbols of texts: 0 for a run of other characters, 1 and up for ``letters``, then one for all other letters."""

    def __init__(self, letters: str):
        self.other, self.of = len(letters) + 1, np.where(_is_letter(), len(letters) + 1, 0).astype(np.int32)
        for k, c in enumerate(letters):
            self.of[ord(c)] = k + 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, joined, and the size of each."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, text = self.of[points], np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
        if len(symbols):
            keep = np.ones(len(symbols), bool)
            keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (text[1:] != text[:-1])
            symbols, text = symbols[keep], text[keep]
        return symbols, np.bincount(text, minlength=len(texts))


Parts = tuple[str, tuple[tuple[str, bytes, bytes, bytes, int, int, int], ...]]


def build(texts: dict[str, str]) -> Parts:
    """What workers need of the labelled ``texts`` by language: the letters, and each language's automaton over its own."""
    letters = "".join(sorted({c for t in texts.values() for c in t.lower() if c.isalpha()}))
    symbols, parts = Symbols(letters), []
    for name in sorted(texts):
        text, _ = symbols([texts[name]])
        used, own = np.unique(text, return_inverse=True)
        width = len(used) + 1
        keys, targets, states = transitions(own.tolist(), width)
        parts.append((name, used.astype(np.int32).tobytes(), keys.tobytes(), targets.tobytes(), states, width, len(text)))
    return letters, tuple(parts)


class Model:
    """Predicts languages from the parts that ``build`` made."""

    def __init__(self, parts: Parts, table_bytes: int = TABLE_BYTES):
        letters, languages = parts
        self.symbols, self.languages, self.automata, self.own = Symbols(letters), [], [], []
        for name, used, keys, targets, states, width, size in languages:
            own = np.full(len(letters) + 2, width - 1, np.int32)  # symbols that this language has not seen are its last
            used = np.frombuffer(used, np.int32)
            own[used] = np.arange(len(used), dtype=np.int32)
            self.languages.append(name)
            self.own.append(own)
            self.automata.append(Automaton(np.frombuffer(keys, np.int64), np.frombuffer(targets, np.int32), states, width, size, table_bytes))

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text (rows) in each language (columns), and the letters of each text."""
        symbols, sizes = self.symbols(texts)
        starts = np.cumsum(sizes) - sizes
        letters = np.add.reduceat(np.append(symbols > 0, 0), np.minimum(starts, len(symbols))) * (sizes > 0)
        out = np.zeros((len(texts), len(self.languages)))
        for j, (a, own) in enumerate(zip(self.automata, self.own, strict=True)):
            out[:, j] = a.phrases(own[symbols], starts, sizes) * a.bits
        return out / np.maximum(sizes, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """The language of each text, 1 less the best cost's share of the second best, and the letters."""
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        costs, letters = self.costs([t or "" for t in texts])
        if self.languages:
            best = np.argmin(costs, axis=1)
            for i in np.flatnonzero(letters > 0):
                rest = np.delete(costs[i], best[i])
                names[i] = self.languages[best[i]]
                scores[i] = float(1 - costs[i, best[i]] / rest.min()) if len(rest) else 1.0
        return names, scores, letters.tolist()


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame) -> dict[str, str]:
    """Labelled text by language: at most ``TRAIN_DOCS`` documents and ``TRAIN_CHARS`` characters of each.

    A hash of id and text orders a language's documents. Counts of distinct ones give the share of hashes to look at, twice what is
    needed; of these each task passes on its first ``TRAIN_DOCS``, and text beyond ``TRAIN_CHARS`` is not collected.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    at = F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(at).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * TRAIN_DOCS / max(n, 1))))])
    drawn = labelled.select("lang", at.alias("at"), F.substring("text", 1, TRAIN_CHARS).alias("text"))
    drawn = drawn.filter((F.col("at") / F.lit(2.0**64) + F.lit(0.5)) <= share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("at", "text")
    copies = Window.partitionBy("lang", "at").orderBy("text")  # equal rows are one document
    drawn = drawn.withColumn("copy", F.row_number().over(copies)).filter("copy = 1").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= TRAIN_DOCS)
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = drawn.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < TRAIN_CHARS).select("lang", "k", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v)[:TRAIN_CHARS] for k, v in texts.items() if any(c.isalpha() for t in v for c in t)}


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """``docs`` with a struct ``_language`` of ``lang_pred``, ``score`` and ``n_letters``; learns from ``train``, or else from ``docs``.

    Texts are parsed in groups of at most ``CHUNK_BYTES`` bytes, or one text, whose rows leave at once.
    """
    spark = docs.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(build(sample(docs if train is None else train)))
    at = docs.columns.index("text")
    found = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_letters", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("language", hash(shipped.value)), lambda: Model(shipped.value))
        for batch in batches:
            rows = batch.column(0)
            texts = pc.struct_field(rows, [at])
            for start, end in chunks(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), CHUNK_BYTES):
                names, scores, letters = model.predict(texts.slice(start, end - start).to_pylist())
                arrays = [rows.slice(start, end - start), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "lang_pred", "score", "n_letters"])
        release()

    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*docs.columns).alias("row"))
    out = rows.mapInArrow(run, StructType([StructField("row", rows.schema["row"].dataType), *found]))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.struct("lang_pred", "score", "n_letters").alias("_language"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score", "_language.n_letters")
