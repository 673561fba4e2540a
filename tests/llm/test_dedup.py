import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import DATA, distance, frame, groups, shingles, table
from tidewell.llm import exact_dedup, line_dedup, near_dedup
from tidewell.llm.common import shared_dir
from tidewell.llm.components import components

EDGE = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "a"), (4, "one two", "en", "a"), (5, "ONE two", "en", "b"),
    (6, "one two", "en", "a"), (6, "one two", "en", "a"), (None, "one two", "en", "a"), (None, "alone here", None, None),
    (7, "w " * 30_000, "en", "a"), (8, "x" * 50_000, "en", "a"), (9, "one two three four five", "en", "a"),
]


def test_exact_dedup_edge_cases(spark):
    rows = exact_dedup.exact_dedup(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert (by[1][0]["keep_id"], by[1][0]["group_size"], by[1][0]["kept"]) == (2, 2, False)
    assert by[2][0]["kept"] and not by[3][0]["keep_id"] == 2
    assert (by[4][0]["keep_id"], by[4][0]["group_size"]) == (6, 4)
    assert sorted(r["kept"] for r in by[6]) == [False, True] and by[5][0]["kept"]
    assert {(r["keep_id"], r["kept"]) for r in by[None]} == {(6, False), (None, True)}
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted({r["text_sha256"] for r in rows})  # one row of every text
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "index_persists", f"{shared_dir(spark)}/index_persists", 4)
    first = exact_dedup.exact_dedup(frame(spark, [(5, "a", None, None), (6, "b", None, None)]), index)
    assert {r["doc_id"]: r["kept"] for r in first.collect()} == {5: True, 6: True}
    again = exact_dedup.DigestIndex(spark, "index_persists", f"{shared_dir(spark)}/index_persists", 4)
    second = exact_dedup.exact_dedup(frame(spark, [(9, "a", None, None), (8, "c", None, None)]), again)
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in second.collect()} == {9: (5, False), 8: (8, True)}
    assert again.table.count() == 3
    third = exact_dedup.exact_dedup(frame(spark, [(None, "d", None, None), (None, "d", None, None), (None, "a", None, None)]), again)
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in third.collect()) == [(0, 2, False), (0, 2, True), (5, 1, False)]
    about = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE FORMATTED index_persists").collect()}
    assert about["Num Buckets"] == "4" and "digest" in about["Bucket Columns"] and "digest" in about["Sort Columns"]


def test_two_batches_against_one_index(spark):
    """A kept index of 10,000 paired digests; a batch of one row broadcasts nothing of it, and new texts alone are added."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id % 10000) AS text")
    index = exact_dedup.DigestIndex(spark, "two_batches", f"{shared_dir(spark)}/two_batches", 4)
    assert exact_dedup.exact_dedup(docs, index).filter("kept").agg(F.min("doc_id"), F.count(F.lit(1))).first()[0:2] == (10_000, 10_000)
    rows = exact_dedup.digests(frame(spark, [(90_000, "text 7", None, None)])).withColumn("row", F.lit(0))
    batch = rows.selectExpr("digest", "doc_id AS keep_id", "1L AS group_size", "0L AS keep_row")
    found = index.lookup(rows, batch)
    assert found.count() == 1 and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()  # no digest is hot
    second = exact_dedup.exact_dedup(spark.range(9_990, 10_010).selectExpr("id + 50000 AS doc_id", "concat('text ', id) AS text"), index)
    assert second.filter("kept").count() == 10 and second.filter("NOT kept AND keep_id >= 10000 AND keep_id < 20000").count() == 10
    assert index.table.count() == 10_010
    index.drop()


def test_near_dedup_edge_cases(spark):
    rows = near_dedup.near_dedup(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] and by[6] == [(1, 4, False)] * 2
    assert sorted(by[None], key=str) == [(1, 4, False), (1, None, True)]
    assert by[7] == [(1, 7, True)] and by[8] == [(1, 8, True)]
    assert near_dedup.near_dedup(frame(spark, [])).collect() == []


def test_near_dedup_matches_brute_force(spark):
    sets = {r["doc_id"]: shingles(r["text"]) for r in table("documents")}
    expected = {d: (len(sets[d]), c, c == d) for d, c in groups(sets).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op2_minhash_near_dedup(spark, DATA).collect()}
    assert got == expected


def test_near_dedup_dense_group(spark):
    """Many near copies of one text, each with two changed words; the blocks hold more rows than one."""
    random.seed(4)
    words = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(words), None, None)]
    for k in range(1, 320):
        own = list(words)
        for i in random.sample(range(90), 2):
            own[i] = f"v{k}x{i}"
        rows.append((k, " ".join(own), None, None))
    expected = groups({d: shingles(t) for d, t, _, _ in rows})
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == expected


def test_near_dedup_blocks_of_few_bytes(spark, monkeypatch):
    """Blocks bounded by the bytes of sets, and a bucket whose leader is near nobody else in it."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    random.seed(9)
    rows, words = [], [f"w{i}" for i in range(120)]
    for k in range(60):
        own = list(words)
        for i in random.sample(range(120), random.choice([1, 3, 6])):
            own[i] = f"v{k}x{i}"
        rows.append((k, " ".join(own), None, None))
    expected = groups({d: shingles(t) for d, t, _, _ in rows})
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame(spark, rows)).collect()} == expected


def test_deduplicate_keeps_one_row_a_group(spark):
    docs = frame(spark, EDGE)
    out = near_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, None, 7, 8, 9], key=str)


def test_deduplicate_keeps_unrelated_texts_of_one_id(spark):
    """Without an id or under one id, texts that have nothing in common all stay, and equal ones once."""
    texts = ["red green blue grey pink teal", "one two three four five six", "do re mi fa so la"]
    rows = [(None, t, None, None) for t in texts[:2]] + [(None, texts[0], None, None)]
    rows += [(7, "a b c d e f g", None, None), (7, "p q r s t u v", None, None), (7, "p q r s t u v", None, None), (8, "P q r s t u v", None, None)]
    rows += [(None, texts[2], None, None), (9, texts[2], None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.deduplicate(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, "a b c d e f g"), (7, "p q r s t u v"), (9, texts[2])], key=str)


def test_survivors_keep_pairs_at_the_threshold():
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 32, (4000, near_dedup.HASHES), np.uint64).astype("<u4")
    b = np.where(r.random(a.shape) < 0.75, a, a + np.uint32(1))
    i = np.arange(len(a))
    assert len(near_dedup.survivors(a, b, i, i)) >= 0.99 * len(a)
    c = np.where(r.random(a.shape) < 0.3, a, a + np.uint32(1))
    assert len(near_dedup.survivors(a, c, i, i)) <= 0.01 * len(a)


@pytest.mark.parametrize(("n", "m", "size"), [(120, 90, 60), (6, 4, 3000), (1, 1, 3)])
def test_similar_pairs_count_like_sets(n, m, size):
    import numpy as np

    r = np.random.default_rng(n)
    base = np.unique(r.integers(0, 1 << 62, size, np.uint64))
    some = lambda: np.unique(np.concatenate([r.choice(base, int(len(base) * r.uniform(0.7, 1)), replace=False), r.integers(0, 1 << 62, size // 8, np.uint64)]))
    a, b = [some() for _ in range(n)], [some() for _ in range(m)]
    i, j = np.nonzero(r.random((n, m)) < 0.7)
    want = [100 * len(set(a[x].tolist()) & set(b[y].tolist())) >= 75 * len(set(a[x].tolist()) | set(b[y].tolist())) for x, y in zip(i, j, strict=True)]
    assert near_dedup.similar_pairs(a, b, i, j).tolist() == want


def test_letter_counts_bound_the_edits(line_pairs):
    for letters in (line_dedup.LETTERS, line_dedup.MORE):
        bound = line_dedup.counts_differ(line_dedup.letter_counts(F.col("a"), letters), line_dedup.letter_counts(F.col("b"), letters))
        assert line_pairs.filter(bound > 2 * F.col("d")).count() == 0
    one = line_pairs.limit(1).select(line_dedup.letter_counts(F.lit("teeéttt")).alias("n")).first()["n"]
    assert one == 2 + (4 << 4)


def test_shingle_hashes_are_distinct():
    for r in table("documents")[:60]:
        assert len(near_dedup.shingles([r["text"]])[0]) == len(shingles(r["text"]))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 230)] + [(3, 2), (2, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 230))
    assert got[2] == got[3] == 2 and 7 not in got


@pytest.fixture(scope="module")
def line_pairs(spark):
    random.seed(11)
    rows = []
    for _ in range(1500):
        a = "".join(random.choice("abcé") for _ in range(random.randint(4, 30)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            i = random.randrange(len(b) + 1)
            b[i : i + random.randint(0, 1)] = random.choice(["", "a", "é"])
        a, b = sorted((a, "".join(b)), key=len)
        rows.append((a, b, distance(a, b)))
    return spark.createDataFrame(rows, "a string, b string, d int")


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(line_pairs, threshold):
    near = line_pairs.filter(F.length("b") - F.length("a") <= threshold).filter(F.length("a") > threshold)
    assert near.filter(line_dedup.within(F.col("a"), F.col("b"), threshold) != (F.col("d") <= threshold)).count() == 0


def test_line_dedup_matches_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(8, 60))) for _ in range(40)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(random.randint(0, 6)):
            x = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                i = random.randrange(len(x))
                x[i : i + random.randint(0, 2)] = random.choice(["", "z", "zz"])
            lines.append("".join(x))
        docs.append((d, "\n".join([*lines, "", " "]) if lines else None, None, None))
    seen, expected = [], {}
    for d, t, _, _ in docs:
        kept = []
        for x in (t or "").split("\n"):
            if not x.strip(" \t"):
                kept.append(x)
                continue
            dup = any(x == y or distance(x, y) <= min(2, min(len(x), len(y)) // 12) for y in seen)
            seen.append(x)
            if not dup:
                kept.append(x)
        expected[d] = None if t is None else "\n".join(kept)
    df = frame(spark, docs)
    out = line_dedup.line_dedup(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == expected


def test_near_lines_of_twelve_characters(spark):
    """One edit for 12 characters, two for 24, at any segment; none for 11."""
    lines = ["read more now", "read mare now", "read more nw", "abcdefghijkl", "bcdefghijkl", "abcdefghijkx", "xbcdefghijkx", "elevenchars", "elevenchart"]
    docs = frame(spark, [(k, x, None, None) for k, x in enumerate(lines)])
    assert {r["doc_id"] for r in line_dedup.line_dedup(docs).collect() if r["text"] == ""} == {1, 2, 5, 6}
    want = {k for k, x in enumerate(lines) if any(distance(x, y) <= min(2, min(len(x), len(y)) // 12) for y in lines[:k])}
    assert want == {1, 2, 5, 6}


def test_hot_lines_and_shuffled_decisions_agree(spark, monkeypatch):
    """The way beyond the broadcast's bound gives the same rows, with a line that holds a third of all places."""
    texts = [f"a line that everyone has, word for word\nown line number {k} of this text {'xyz'[k % 3] * 9}" for k in range(60)]
    docs = frame(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    few = sorted(map(tuple, line_dedup.report(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 0.3)
    assert sorted(map(tuple, line_dedup.report(docs).collect())) == few and len(few) == 60


def test_report_has_digests_counts_and_classes(spark):
    """Digests follow the cleaned texts, and classes follow links of any number of steps, near ones too."""
    x, y, z = "the first line of them all stands here", "another line that is shared by two", "a third line, near a line in the fourth one"
    texts = {1: x, 2: f"{x}\n{y}", 3: f"{y}\n{z}", 4: f"{z}!!\nnothing else", 5: "alone", 6: None, 7: f"own words\n{z[2:]}\n"}
    kept = {1: x, 2: y, 3: z, 4: "nothing else", 5: "alone", 6: None, 7: "own words\n"}
    counts = {1: (1, 0, 0, 0), 2: (2, 1, 0, 0), 3: (2, 1, 0, 2), 4: (2, 0, 1, 1), 5: (1, 0, 0, 0), 6: (0, 0, 0, 0), 7: (2, 0, 1, 1)}
    rows = line_dedup.report(frame(spark, [(d, t, None, None) for d, t in texts.items()])).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["text_sha256"] for r in rows} == {d: None if t is None else hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()}
    assert {r["doc_id"]: r["class_id"] for r in rows} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 1}
    assert {r["doc_id"]: (r["n_lines"], r["n_copies"], r["n_near"], r["n_links"]) for r in rows} == counts


def test_line_dedup_edge_cases(spark):
    docs = frame(spark, EDGE)
    got = {}
    for r in line_dedup.line_dedup(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == [None] and got[2] == [""] and got[3] == [" \n\t"]
    assert got[4] == ["one two"] and got[5] == ["ONE two"] and got[6] == ["", ""]
    assert got[7] == [EDGE[9][1]] and got[8] == [EDGE[10][1]]
    assert sorted(got[None]) == ["", "alone here"]
    rows = {}
    for r in line_dedup.report(docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == len(EDGE) and rows[5][0]["class_id"] == 5 and rows[6][0]["class_id"] == 4 and rows[1][0]["n_lines"] == 0
    assert {r["class_id"] for r in rows[None]} == {4}
    assert line_dedup.report(frame(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_shingle_count_of_any_text(text):
    assert len(near_dedup.shingles([text])[0]) == len(shingles(text))
