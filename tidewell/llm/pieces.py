"""SentencePiece encoding and decoding by shared-prefix forward search.

A text is marked (a dummy prefix, spaces as U+2581) and cut into marked words, across whose borders no piece of the
vocabulary reaches. The distinct words of a group of texts are sorted, which lays them out as a depth-first walk of
their trie: consecutive words share a prefix, and the forward states of that prefix are kept, so each edge of the trie
is searched once.

The forward state depends on the model's kind. For a unigram model it is Viterbi's: the best score of a segmentation
of the prefix and its last piece. A BPE model's pieces have ranks, not probabilities, and the best sum of scores is
not what the format defines. There the search is Viterbi's over scores of neighbours: a piece scores 0 behind another
if merging the two yields just these two, and minus infinity else. One segmentation of each prefix scores 0, so its
state is its last piece, and the ids are those that merging pair by pair gives.

Defined cases: a null or empty text has no ids; U+2581 in a text stands for a space, as in the format; characters
outside the vocabulary become byte pieces, or the unknown piece if the model has none; very long words are searched
like others; repeated rows get equal results; other columns are not read. The memory for words is bounded:
``CACHE_WORDS`` words are kept between groups of at most ``CHUNK_BYTES`` bytes of text, or one text, and as
many pairs of pieces.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, held, map_texts, ship

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_WORDS, CHUNK_BYTES = 100_000, 2 << 20
MARK = "▁"
#: Ranges of Latin letters, as a class of a pattern.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"

# Fixed values of the model format: kinds of pieces, and kinds of models.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, BPE = 1, 2
#: A unigram model scores an unknown character this much below its worst piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """A vocabulary of pieces with scores, read from the bytes of a ``.model`` file."""

    def __init__(self, data: bytes):
        self.kind, self.dummy_prefix, strip = UNIGRAM, True, True
        pieces = []
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.dummy_prefix, strip = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(1, b"identity") != b"identity":
                    raise ValueError("only models with the identity normaliser are supported")
        if self.kind not in (UNIGRAM, BPE) or strip:
            raise ValueError("the model must be of kind unigram or BPE and keep white space as it is")
        self.strings = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        self.scores = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.decoded = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == 3 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.longest = max(map(len, self.ids), default=1)
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            sizes.setdefault(p[-2:], set()).add(len(p))
            sizes.setdefault(p[-1:], set()).add(1)
        ends = {p[-1:] for p in self.ids}
        #: Lengths of the pieces that end in two characters, longest first.
        self.sizes = {k: tuple(sorted(v | ({1} if k[-1] in ends else set()), reverse=True)) for k, v in sizes.items()}
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        apart = not any(MARK in p.lstrip(MARK) or "\n" in p or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.ids)
        runs = [s for p, s in self.scores.items() if len(p) > 1 and not p.strip(MARK)]
        self.apart = self.kind == BPE and apart and max(runs, default=-1e9) <= min((s for p, s in self.scores.items() if p.strip(MARK)), default=0)
        # with runs of marks merged after all else, words and the marks before them can be searched apart
        whole = f"{MARK}*[^{MARK}]*"
        if self.apart:
            # where no piece holds a Latin letter beside another character, runs of either are searched apart as well
            mixed = any(re.search(f"[{LATIN}][^{LATIN}]|[^{LATIN}{MARK}][{LATIN}]", p) for p in self.ids)
            runs_of = f"{MARK}?[^{MARK}\n]+" if mixed else f"{MARK}?[{LATIN}]+|{MARK}?[^{LATIN}{MARK}\n]+"
            whole = f"{MARK}+(?={MARK})|{runs_of}|{MARK}|\n"
        self.words = re.compile(whole, re.DOTALL)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.edges: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        self.wholes: dict[str, bool] = {}
        self.runs: dict[int, list[int]] = {}

    # one word, pair by pair; decides which pieces may follow each other

    def merged(self, word: str, last: str | None = None) -> list[str]:
        """The BPE pieces of ``word``: the best-scored neighbours are joined first, the leftmost of equals.

        With ``last``, stops before a join that yields it.
        """
        parts, scores = list(word), self.scores
        while len(parts) > 1 and not (last and len(parts) == 2):
            pairs = [scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(pairs)
            if best == -np.inf:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """What stands at the left (0) or right (1) edge of ``piece`` while it is merged, from last to first.

        Each entry has the string, and the ranks between which it stands there: its own, and its successor's.
        """
        key = (piece, side)
        if (edge := self.edges.get(key)) is None:
            edge = [(piece, -self.scores.get(piece, np.inf), np.inf)]
            if len(piece) > 1:
                parts = self.merged(piece, last=piece)
                inner = self._edge(parts[-side], side)
                edge = [(piece, -self.scores[piece], np.inf)] + [(t, born, min(end, -self.scores[piece])) for t, born, end in inner]
            elif piece in self.scores:
                edge = [(piece, -np.inf, np.inf)]
            self.edges[key] = edge
        return edge

    def follows(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` yields just ``a`` and ``b``: at no rank is there a better pair across the border.

        Of equal ranks the pair further left is joined first: within ``a``, then across, then within ``b``.
        """
        if self.n_fits > 2 * CACHE_WORDS:
            self.fits.clear()
            self.n_fits = 0
        known = self.fits.setdefault(a, {})
        if (fit := known.get(b)) is None:
            if self.apart and self.whole(a) and self.whole(b):
                fit = True
                for left, born, end in self._edge(a, 1):
                    for right, since, until in self._edge(b, 0):
                        if since < end and born < until and (s := self.scores.get(left + right)) is not None and -s < end and -s <= until:
                            fit = False
            else:
                fit = self.merged(a + b) == ([a, b] if a else [b])
            known[b] = fit
            self.n_fits += 1
        return fit

    def whole(self, piece: str) -> bool:
        """Whether merging the characters of ``piece`` yields ``piece``."""
        if (fit := self.wholes.get(piece)) is None:
            fit = self.wholes[piece] = piece in self.ids and self.merged(piece) == [piece]
        return fit

    # all words, in order

    def search(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each of the sorted ``words``; the states of a prefix serve all words that share it.

        A state is the last piece of its prefix; ``best`` has the scores beside them where the model has need of them.
        """
        extend = self._merge_on if self.kind == BPE else self._viterbi_on
        before, states, best = "", [""], [0.0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del states[shared + 1 :], best[shared + 1 :]
            extend(word, shared + 1, states, best)
            parts, end = [], len(word)
            while end:
                piece = states[end]
                parts.append(piece)
                end -= len(piece)
            parts.reverse()
            yield word, parts
            before = word

    def _merge_on(self, word: str, end: int, states: list[str], best: list[float]) -> None:
        """Append the states of ``word``'s prefixes from ``end`` on: the last piece of each one's merge result."""
        ids, fits, sizes, none = self.ids, self.fits, self.sizes, {}
        for end in range(end, len(word) + 1):
            for size in sizes.get(word[end - 2 : end] if end > 1 else word[0], (1,)):
                if size > end:
                    continue
                piece = word[end - size : end]
                if piece in ids:
                    last = states[end - size]
                    fit = fits.get(last, none).get(piece)
                    if self.follows(last, piece) if fit is None else fit:
                        states.append(piece)
                        break
            else:
                states.append(word[end - 1])  # outside the vocabulary: joined with nothing

    def _viterbi_on(self, word: str, end: int, states: list[str], best: list[float]) -> None:
        """Append the states of ``word``'s prefixes from ``end`` on: last piece and score of each one's best segmentation."""
        for end in range(end, len(word) + 1):
            last, top = word[end - 1], best[end - 1] + self.scores.get(word[end - 1], self.worst)
            for size in self.sizes.get(word[end - 2 : end], ()):
                piece = word[end - size : end]
                if 1 < size <= end and piece in self.scores and (score := best[end - size] + self.scores[piece]) > top:
                    last, top = piece, score
            states.append(last)
            best.append(top)

    def run(self, marks: int) -> list[int]:
        """Ids of a run of marks that joins nothing else. Pieces grow from the left, so a long run repeats its first."""
        if marks not in self.runs:
            bound = 4 * self.longest
            ahead, rest = [], marks
            if marks > bound:
                first = self.merged(MARK * bound)[0]
                ahead = [first] * -(-(marks - bound) // len(first))
                rest -= len(ahead) * len(first)
            if len(self.runs) > 1000:
                self.runs.clear()
            self.runs[marks] = list(self._numbers(ahead + self.merged(MARK * rest)))
        return self.runs[marks]

    def _numbers(self, parts: list[str]) -> tuple[int, ...]:
        try:
            return tuple([self.ids[p] for p in parts])
        except KeyError:
            out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        marked = [((MARK if self.dummy_prefix else "") + t.replace(" ", MARK)) if t else "" for t in texts]
        cut = [self.words.findall(m) for m in marked]
        cache = self.cache
        distinct = set(chain.from_iterable(cut))
        for word, parts in self.search(sorted(distinct - cache.keys())):
            cache[word] = self._numbers(parts)
        mark = (self.ids.get(MARK, self.unknown),)
        out = []
        for m, words in zip(marked, cut, strict=True):
            if self.apart and MARK * 2 in m:
                ids: list[int] = []
                held = 0
                for w in words:
                    if not w.strip(MARK):
                        held += len(w)
                        continue
                    own = cache[w]
                    if held and w[0] == MARK and own[:1] == mark:
                        held, own = held + 1, own[1:]
                    ids += self.run(held) if held else []
                    ids += own
                    held = 0
                ids += self.run(held) if held else []
                out.append(np.array(ids, np.int32))
            else:
                out.append(np.fromiter(chain.from_iterable(map(cache.__getitem__, words)), np.int32))
        if len(cache) > CACHE_WORDS:  # this group's words are the likeliest to come again
            self.cache = {w: cache[w] for w in distinct} if len(distinct) <= CACHE_WORDS // 2 else {}
        return out

    def decode(self, ids) -> str:
        """The text of ``ids``."""
        table = self.decoded
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(data: bytes) -> PieceModel:
    """The model of these bytes, one for each process."""
    return held(("pieces", hash(data)), lambda: PieceModel(data))


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip, decoded_sha256``: ids of each whole text, whether decoding them gives it back, and the digest of what it gives."""
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def compute(texts: list[str | None]) -> list[pa.Array]:
        model = load(shipped.value)
        ids = model.encode(texts)
        counts = np.array([len(x) for x in ids], np.int64)
        back = [model.decode(x.tolist()) for x in ids]
        same = [b == (t or "").replace(MARK, " ") for t, b in zip(texts, back, strict=True)]
        digests = [hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(counts), pa.array(same, pa.bool_()), pa.array(digests, pa.string())]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_texts(rows, ["doc_id"], compute, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean, decoded_sha256 string", CHUNK_BYTES)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``."""
    spark = encoded.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        model = load(shipped.value)
        return batch.map(lambda ids: None if ids is None else model.decode(list(ids)))

    return encoded.select("doc_id", run("ids").alias("text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
