"""Line dedup: exact copies of lines and lines within a small edit distance, in DataFrame functions only.

A line with a visible character is dropped if an earlier line, of any document, is equal to it or within a few edits
of it: one edit for each ``CHARS_AN_EDIT`` characters of the shorter line, and ``THRESHOLD`` at most. So a line of 12
characters may differ by one edit, one of 24 or more by two, and segments never have fewer than six characters, which
keeps their index selective at any size. Lines are ordered by ``doc_id`` (null last), then by their place. Blank lines
stay. The rule is not transitive: what counts is one earlier line, dropped itself or not.

Near lines are found by a segment-partition edit join. A line that allows k edits is cut into k + 1 even segments,
keyed by the line's length, the segment's number and its characters. An edit spoils one segment, so of two near lines
the longer holds a segment of the shorter one, near its place: with the i-th (from 0) as the first that the edits
reach with fewer edits than segments, at most i edits lie before it and at most k - i behind. So a line probes
the index at each length up to ``THRESHOLD`` less than its own, at the few starts that these bounds allow. Pairs that
agree on a key must also agree, but for two an edit, on counts of a few letters; then their texts are fetched and
their distance is computed by a banded bit-parallel pass over the characters.

Of each distinct line one row takes part, whatever its copies; a segment that many lines share is met by a sort-merge
join, whose skewed partitions Spark splits, and pairs that the letter counts rule out never become rows. Decisions are
joined to the lines from the few distinct lines that repeat or are near another: by broadcast if they are measured to
be small, else the lines that hold more than ``HOT_SHARE`` of all places by broadcast, at most 1 / ``HOT_SHARE`` of
them, and the others by a shuffle.

Defined cases: a null text has no lines and stays null; a text all of whose lines are dropped becomes empty; lines end
at line feeds only; rows with one ``doc_id`` count as one document, and of equal such rows each keeps what one alone
would keep; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import BROADCAST_BYTES, documents, materialise, maybe_broadcast
from tidewell.llm.components import components

THRESHOLD = 2
#: Characters of a line for each edit that it allows.
CHARS_AN_EDIT = 12
#: Letters whose counts, modulo 16, are compared before texts are, and characters that candidates are compared by
#: besides; any are right, frequent ones are sharp.
LETTERS, MORE = "etaoinsrhldcumf", " pgbvw.,yk01qxz"
#: A visible character.
VISIBLE = r"[^ \t\x0B\f\r]"
#: Places of a line within its document fit below this.
PLACES = 1 << 31
_LAST = (1 << 63) - 1
#: Pairs that one task verifies, some milliseconds each.
PAIRS_A_TASK = 500
#: A line that holds at least this share of all places is joined by broadcast; there are at most 1/share of them.
HOT_SHARE = 0.001


def edits(length: Column, threshold: int = THRESHOLD) -> Column:
    """The edits that a line of this length allows."""
    return F.least(F.lit(threshold), _div(length, CHARS_AN_EDIT))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def _key(i: int, length: Column, piece: Column) -> Column:
    return F.xxhash64(F.lit(i), length, piece)


def _segment(wide: Column, length: Column, parts: int, i: int, off: int = 0) -> Column:
    """The ``i``-th of the even segments of a line of ``length``, or what stands ``off`` characters behind its place.

    ``wide`` has four bytes a character, so a segment is found without walking the line.
    """
    start, end = _div(length * F.lit(i), parts), _div(length * F.lit(i + 1), parts)
    return F.substring(wide, (start + F.lit(off)) * 4 + 1, (end - start) * 4)


def segment_keys(lines: DataFrame, threshold: int) -> tuple[DataFrame, list[str], list[str]]:
    """``lines`` with columns of keys, and the names of those of the index and of the probes.

    A line of length n that allows k edits is in the index under its k + 1 segments. A probe for lines shorter by d
    takes, for each segment of such a line, the starts off by s that need |s| edits before it and |s - d| behind it.
    """
    wide, out = F.col("s_wide"), lines.withColumn("s_wide", F.encode("line", "UTF-32"))
    out = out.withColumn("s_n", (F.octet_length("s_wide") / 4).cast("int"))
    out = out.select("*", *[(F.col("s_n") - F.lit(d)).alias(f"s_n{d}") for d in range(threshold + 1)])
    out = out.select("*", *[edits(F.col(f"s_n{d}"), threshold).alias(f"s_k{d}") for d in range(threshold + 1)])

    def slots(d: int, cases) -> list[Column]:
        """For each place in the lists of ``cases`` by allowed edits, the key of the case that holds."""
        n, k = F.col(f"s_n{d}"), F.col(f"s_k{d}")
        found = {}
        for allowed in range(max(1, d), threshold + 1):
            for place, (i, s) in enumerate(cases(allowed)):
                key = _key(i, n, _segment(wide, n, allowed + 1, i, s))
                if s < 0:  # a start before the line is none
                    key = F.when(_div(n * F.lit(i), allowed + 1) >= F.lit(-s), key)
                found[place] = F.when(k == allowed, key) if place not in found else found[place].when(k == allowed, key)
        return [found[p] for p in sorted(found)]

    index = slots(0, lambda k: [(i, 0) for i in range(k + 1)])
    probe = [x for d in range(threshold + 1) for x in slots(d, lambda k, d=d: [(i, s) for i in range(k + 1) for s in range(-k, k + 1) if abs(s) <= i and abs(s - d) <= k - i])]
    names = [f"i{k}" for k in range(len(index))], [f"p{k}" for k in range(len(probe))]
    # a lambda keeps the keys out of whole-stage code, whose one method would be too long to be compiled
    index[0] = _let(index[0], lambda key: key)
    return out.select("*", *[c.alias(x) for c, x in zip(index + probe, names[0] + names[1], strict=True)]), *names


def letter_counts(line: Column, letters: str = LETTERS) -> Column:
    """Counts of ``letters``, modulo 16, four bits each; letters that are counted are taken out, so later ones read less."""
    marks = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(4 * k).alias("at")) for k, c in enumerate(letters)])

    def take(state: Column, mark: Column) -> Column:
        def added(rest: Column) -> Column:
            n = F.pmod(F.octet_length(state["rest"]) - F.octet_length(rest), F.lit(16)).cast("bigint")
            return F.struct(rest.alias("rest"), (state["counts"] + F.call_function("shiftleft", n, mark["at"])).alias("counts"))

        return _let(F.replace(state["rest"], mark["c"], F.lit("")), added)

    start = F.struct(line.alias("rest"), F.lit(0).cast("bigint").alias("counts"))
    return F.aggregate(marks, start, take, lambda state: state["counts"])


def counts_differ(a: Column, b: Column) -> Column:
    """A lower bound of the sum of differences of the letters' counts; an edit changes two counts by one at most."""

    def one(k: int) -> Column:
        d = F.pmod(F.shiftright(a, 4 * k) - F.shiftright(b, 4 * k), F.lit(16))
        return F.least(d, F.lit(16) - d)

    return reduce(add, [one(k) for k in range(len(LETTERS))])


def within(a: Column, b: Column, threshold: int, allowed: Column | None = None) -> Column:
    """Whether two texts, their lengths apart by at most ``threshold``, are within ``allowed`` edits, ``threshold`` if not given.

    A window of 2 * ``threshold`` + 1 rows moves down the diagonal of the distance matrix, one column a character of
    the longer text. Bits of one number hold where the distance rises or falls from row to row within the window; one
    step's worth of and, or, shift and a carrying sum moves all of them on. The score follows the window's last row
    until that reaches the end of the shorter text, and from there on that text's last row.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    none = F.lit(0)

    def run(texts: Column) -> Column:
        first, second = texts["first"], texts["second"]
        m, n = F.size(first), F.size(second)

        def row(j: Column, k: int) -> Column:
            at = j + F.lit(k - threshold - 1)
            return F.get(first, F.when(at >= 0, at).otherwise(F.lit(-1)))

        def matches(j: Column) -> Column:
            bits = [F.when(row(j, k) == F.get(second, j - 1), F.lit(1 << k)).otherwise(none) for k in range(width)]
            return F.struct(j.alias("j"), reduce(add, bits).alias("same"))

        def step(state: Column, column: Column) -> Column:
            j, same, up, down = column["j"], column["same"], state["up"], state["down"]
            level = (same.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down).bitwiseAND(F.lit(mask))
            bit = F.call_function("shiftleft", F.lit(1), F.greatest(m - j + F.lit(threshold), none))

            def follow(flat: Column) -> Column:
                right, left = down.bitwiseOR(F.lit(mask) - flat.bitwiseOR(up)), flat.bitwiseAND(up)
                ahead = F.shiftright(flat, 1)
                diagonal = F.when(flat.bitwiseAND(F.lit(1 << (width - 1))) == 0, F.lit(1)).otherwise(none)
                across = F.when(right.bitwiseAND(bit) != 0, F.lit(1)).when(left.bitwiseAND(bit) != 0, F.lit(-1)).otherwise(none)
                score = state["score"] + F.when(j + F.lit(threshold) <= m, diagonal).otherwise(across)
                return F.struct(left.bitwiseOR(F.lit(mask) - ahead.bitwiseOR(right)).alias("up"), ahead.bitwiseAND(right).alias("down"), score.alias("score"))

            return _let(level, follow)

        start = F.struct(F.lit(((1 << (threshold + 1)) - 1) << threshold).alias("up"), none.alias("down"), F.lit(threshold).alias("score"))
        columns = F.transform(F.sequence(F.lit(1), n), matches)
        return F.aggregate(columns, start, step, lambda s: s["score"] <= (F.lit(threshold) if allowed is None else allowed))

    return _let(F.struct(F.split(a, "").alias("first"), F.split(b, "").alias("second")), run)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda over an array of one stands for a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc")


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc, body, place, line`` of each line with a visible character.

    ``doc`` is the id, the largest number if null; with ``body``, a hash of the text, it tells rows apart.
    """
    out = docs.select(_doc(), F.xxhash64("text").alias("body"), F.posexplode(F.split(F.col("text"), "\n")).alias("place", "line"))
    return out.filter(F.col("line").rlike(VISIBLE))


def _order(doc: Column, place: Column) -> Column:
    """A number that orders lines by document and place."""
    return doc.cast("decimal(38,0)") * F.lit(PLACES).cast("decimal(11,0)") + place.cast("decimal(11,0)")


def _doc_of(order: Column) -> Column:
    return ((order - F.pmod(order, F.lit(PLACES).cast("decimal(11,0)"))) / F.lit(PLACES)).cast("bigint")


def identity() -> list[Column]:
    """128 bits that name a line: ``id, id2``."""
    return [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2")]


def distinct_lines(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each distinct line: ``id, id2, first, n``, counts of letters and keys, all numbers; ``first`` orders its first copy."""
    keyed, index, probe = segment_keys(lines, threshold)
    own = _order(F.col("doc"), F.col("place")).alias("own")
    keyed = keyed.select(*identity(), own, F.when(F.col("s_k0") > 0, letter_counts(F.col("line"))).alias("counts"), *index, *probe)
    # of a line's copies one row is left, by a map-side combine over numbers of fixed width; no text is shuffled
    once = [F.first(c).alias(c) for c in ("counts", *index, *probe)]
    return materialise(keyed.groupBy("id", "id2").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"), *once), "distinct-lines")


def near_links(lines: DataFrame, distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``id, id2, first, near``: ends of pairs of distinct lines that are within the edits that the shorter one allows.

    ``first`` is the order of the line's own first copy. ``near`` is the order of the first copy of the other line if that comes earlier, else null.
    """
    keys = [c for c in distinct.columns if c[1:].isdigit() and c[0] in "ip"]
    index = [c for c in keys if c[0] == "i" and c != "id2"]
    every = F.posexplode(F.array(*keys)).alias("at", "key")  # all columns on either side: one exchange serves both
    long = distinct.filter(F.col("counts").isNotNull())
    side = lambda x, own: long.select(every, F.col("id").alias(x), F.col("counts").alias(f"counts_{x}")).filter(own & F.col("key").isNotNull())
    left, right = side("a", F.col("at") < len(index)), side("b", F.col("at") >= len(index))
    alike = (F.col("a") != F.col("b")) & (counts_differ(F.col("counts_a"), F.col("counts_b")) <= F.lit(2 * threshold))
    pairs = left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & alike)
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    n_pairs = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = lines.select("doc", "place", "line", *identity()).join(maybe_broadcast(ids, 2 * n_pairs, 32), "id", "left_semi")
    texts = materialise(texts.groupBy("id", "id2", "line").agg(F.min(_order(F.col("doc"), F.col("place"))).alias("first")), "line-texts")
    texts = texts.withColumn("more", letter_counts(F.col("line"), MORE))
    end = lambda x: texts.select(F.col("id").alias(x), F.col("id2").alias(f"{x}2"), F.col("line").alias(f"line_{x}"), F.col("first").alias(f"first_{x}"), F.col("more").alias(f"more_{x}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").filter(counts_differ(F.col("more_a"), F.col("more_b")) <= F.lit(2 * threshold)).withColumn("s_a", F.length("line_a")).withColumn("s_b", F.length("line_b"))
    both = both.filter(F.abs(F.col("s_a") - F.col("s_b")) <= edits(F.least("s_a", "s_b"), threshold))
    both = both.repartition(max(1, n_pairs // PAIRS_A_TASK), "a", "b")  # small rows, but much work each
    swap = F.col("s_a") > F.col("s_b")
    short, long_ = F.when(swap, F.col("line_b")).otherwise(F.col("line_a")), F.when(swap, F.col("line_a")).otherwise(F.col("line_b"))
    linked = both.filter(within(short, long_, threshold, edits(F.least("s_a", "s_b"), threshold)))
    ends = [F.struct(F.col(x).alias("id"), F.col(f"{x}2").alias("id2"), F.col(f"first_{x}").alias("first"), F.when(F.col(f"first_{y}") < F.col(f"first_{x}"), F.col(f"first_{y}")).alias("near")) for x, y in ("ab", "ba")]
    return linked.select(F.inline(F.array(*ends)))


def decisions(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables: of lines that repeat or are near another one, and of links between documents.

    The first has ``doc, body, place, kind, links``: ``kind`` is 0 for a line that is kept, 1 for an exact copy, 2 for a
    line near an earlier one, and ``links`` counts distinct other lines that are near. The second has ``a, b``: a
    document and the one that holds the first copy of one of its lines, and the documents of two near lines.
    """
    lines = lines_of(docs)
    distinct = distinct_lines(lines, threshold)
    links = materialise(near_links(lines, distinct, threshold), "line-links")
    ends = links.groupBy("id", "id2").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("links"))
    ends = materialise(ends, "line-ends")
    known = distinct.select("id", "id2", "first", "n").join(maybe_broadcast(ends, ends.count(), 96), ["id", "id2"], "left").filter("n > 1 OR links > 0")
    first_place = F.pmod("first", F.lit(PLACES).cast("decimal(11,0)")).cast("int")
    known = known.select("id", "id2", "n", _doc_of(F.col("first")).alias("first_doc"), first_place.alias("first_place"), F.col("near").isNotNull().alias("is_near"), "links")
    known = materialise(known, "line-known")
    out = _places(lines.select("doc", "body", "place", *identity()), known, distinct)
    copy = (F.col("doc") != F.col("first_doc")) | (F.col("place") != F.col("first_place"))
    kind = F.when(copy, F.lit(1)).when(F.col("is_near"), F.lit(2)).otherwise(F.lit(0))
    found = materialise(out.select("doc", "body", "place", kind.alias("kind"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "first_doc"), "line-decisions")
    copies = found.filter("doc != first_doc").select(F.col("doc").alias("a"), F.col("first_doc").alias("b"))
    near = links.filter("near IS NOT NULL").select(_doc_of(F.col("first")).alias("a"), _doc_of(F.col("near")).alias("b"))
    return found.drop("first_doc"), copies.union(near)


def _places(places: DataFrame, known: DataFrame, distinct: DataFrame) -> DataFrame:
    """The ``places`` of ``known`` lines, with its columns; a hot line's places are never dealt out by its key."""
    if known.count() * 96 <= BROADCAST_BYTES:
        return places.join(F.broadcast(known), ["id", "id2"])
    total = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = materialise(known.filter(F.col("n") >= max(2, int(total * HOT_SHARE))), "line-hot")
    rest = places.join(F.broadcast(hot.select("id", "id2")), ["id", "id2"], "left_anti")
    return places.join(F.broadcast(hot), ["id", "id2"]).unionByName(rest.join(known, ["id", "id2"]))


def _cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``row``, a struct of ``docs``' columns, with ``doc``, the text without dropped lines as ``cut``, and the counts of ``found``."""
    per = found.groupBy("doc", "body").agg(
        F.count_if(F.col("kind") == 1).alias("n_copies"), F.count_if(F.col("kind") == 2).alias("n_near"), F.sum("links").alias("n_links"), F.collect_set(F.when(F.col("kind") > 0, F.col("place"))).alias("places"),
    )
    per = materialise(per, "line-documents")
    size = per.agg(F.sum(F.size("places") * 4 + 96).alias("bytes")).first()["bytes"] or 0
    per = F.broadcast(per) if size <= BROADCAST_BYTES else per
    rows = docs.select(_doc(), F.xxhash64("text").alias("body"), F.struct(*docs.columns).alias("row"))

    def joined(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    text = F.when(F.col("places").isNull() | (F.size("places") == 0), F.col("row.text")).otherwise(_let(F.split("row.text", "\n"), joined))
    return rows.join(per, ["doc", "body"], "left").select("row", "doc", text.alias("cut"), "n_copies", "n_near", "n_links")


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with dropped lines taken out of ``text``."""
    found, _ = decisions(docs, threshold)
    rows = _cut(docs, found)
    return rows.select(*[F.col("cut").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: the digest of its text without the dropped lines, counts of lines, links and class.

    ``n_copies`` and ``n_near`` count dropped lines by their kind, ``n_links`` the near lines of all its lines; rows of
    equal id and text are counted together. ``class_id`` is the least document that can be reached over equal and near
    lines; rows without an id are one document, whose class is null if no other is reached.
    """
    found, edges = decisions(docs, threshold)
    classes = components(edges).select(F.col("node").alias("doc"), "root")
    visible = F.regexp_count(F.coalesce("row.text", F.lit("")), F.lit(r"[^ \t\x0B\f\r\n][^\n]*"))  # lines with a visible character
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    rows = _cut(docs.select("doc_id", "text"), found).select("doc", visible.cast("bigint").alias("n_lines"), *map(zero, ("n_copies", "n_near", "n_links")), F.sha2("cut", 256).alias("text_sha256"))
    class_id = F.coalesce("root", "doc")
    doc_id = F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id")
    return rows.join(classes, "doc", "left").select(doc_id, "n_lines", "n_copies", "n_near", "n_links", F.when(class_id != _LAST, class_id).alias("class_id"), "text_sha256")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


ORACLE = rf"""
WITH RECURSIVE lines AS MATERIALIZED (
  SELECT doc_id, place, line, length(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0 AS visible FROM (
    SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
distinct_lines AS MATERIALIZED (
  SELECT line, length(line) AS n, min(doc_id::HUGEINT * {PLACES} + place) AS first,
         n - length(replace(line, 'e', '')) AS ce, n - length(replace(line, 't', '')) AS ct, n - length(replace(line, 'a', '')) AS ca,
         n - length(replace(line, 'o', '')) AS co, n - length(replace(line, 'n', '')) AS cn, n - length(replace(line, 'i', '')) AS ci
  FROM lines WHERE visible GROUP BY line),
links AS MATERIALIZED (
  SELECT a.line AS la, b.line AS lb, a.first AS fa, b.first AS fb
  FROM distinct_lines a JOIN distinct_lines b ON b.n BETWEEN a.n - {THRESHOLD} AND a.n + {THRESHOLD} AND a.line <> b.line
  WHERE a.n >= {CHARS_AN_EDIT} AND b.n >= {CHARS_AN_EDIT}
    AND CASE WHEN abs(a.ce - b.ce) + abs(a.ct - b.ct) + abs(a.ca - b.ca) + abs(a.co - b.co) + abs(a.cn - b.cn) + abs(a.ci - b.ci) <= {2 * THRESHOLD}
             THEN levenshtein(a.line, b.line) <= least({THRESHOLD}, least(a.n, b.n) // {CHARS_AN_EDIT}) ELSE FALSE END),
near AS (SELECT la AS line, count(*) AS links, min(fb) FILTER (WHERE fb < fa) AS near FROM links GROUP BY la),
decided AS MATERIALIZED (
  SELECT l.doc_id, l.place, l.line, visible, CASE WHEN l.doc_id::HUGEINT * {PLACES} + l.place > d.first THEN 1 WHEN near IS NOT NULL THEN 2 ELSE 0 END AS kind,
         (d.first // {PLACES})::BIGINT AS first_doc, coalesce(links, 0) AS links
  FROM lines l LEFT JOIN distinct_lines d ON d.line = l.line AND visible LEFT JOIN near ON near.line = l.line AND visible),
pairs AS (SELECT doc_id AS a, first_doc AS b FROM decided WHERE visible AND first_doc <> doc_id
          UNION SELECT (fa // {PLACES})::BIGINT, (fb // {PLACES})::BIGINT FROM links WHERE fa // {PLACES} <> fb // {PLACES}),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(doc, root) AS (SELECT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc),
classes AS (SELECT doc, min(root) AS root FROM reach GROUP BY doc)
SELECT d.doc_id, count(*) FILTER (WHERE visible)::BIGINT AS n_lines, count(*) FILTER (WHERE visible AND kind = 1)::BIGINT AS n_copies,
       count(*) FILTER (WHERE visible AND kind = 2)::BIGINT AS n_near, coalesce(sum(links) FILTER (WHERE visible), 0)::BIGINT AS n_links,
       coalesce(any_value(root), d.doc_id) AS class_id,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT visible OR kind = 0), '')) END AS text_sha256
FROM documents d LEFT JOIN decided USING (doc_id) LEFT JOIN classes c ON c.doc = d.doc_id GROUP BY d.doc_id, d.text
"""
