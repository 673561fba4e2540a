import corpus_pipeline
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.llm.helpers import DATA, WORD, frame, groups, shingles, table
from tidewell.llm import registry


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = con.sql(registry.oracle_sql()[name])
    columns = sorted(theirs.columns)
    ours = registry.queries()[name](spark, DATA)
    assert sorted(ours.columns) == columns
    sort = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert sort(ours.select(*columns).collect()) == sort(theirs.project(", ".join(columns)).fetchall())


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(pq.read_table(str(tmp_path / str(k))).to_pylist())
    before = table("documents")
    assert {r["doc_id"] for r in kept[0]} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    assert len(kept[1]) == len(kept[0])
    assert sum(len(r["text"].split("\n")) for r in kept[1]) < sum(len(r["text"].split("\n")) for r in kept[0])
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept[1]}
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(d for d, c in groups(sets).items() if c == d)
    assert {r["doc_id"] for r in kept[3]} <= {r["doc_id"] for r in kept[2]}
    total = sum(len(WORD.findall(r["text"])) for r in kept[2])
    assert abs(sum(len(WORD.findall(r["text"])) for r in kept[3]) - 1.5 * total) < 0.01 * total
    assert len(kept[4]) == len(kept[3]) and all(r["round_trip"] for r in kept[4])


def stages_of(spark, rows):
    """The rows after each stage, as sorted (doc_id, text) pairs; token counts after the last."""
    docs, out = frame(spark, rows), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        out.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    return [*out, sorted(((r["doc_id"], r["n_tokens"] > 0, r["round_trip"]) for r in last), key=str)]


def test_stages_take_an_empty_table(spark):
    assert stages_of(spark, []) == [[], [], [], [], []]


def test_stages_take_odd_rows(spark):
    """Nulls in each column, blank texts, copies under one id and without one, a text of 60,000 words; nothing is labelled."""
    long = " ".join(f"word{k}" for k in range(60_000))
    words = "some words that stand here for all to see"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " 12 \n", "en", "a"), (None, words, None, None), (4, words, None, "a"), (4, words, None, "a"), (5, long, None, "b"), (6, "alone in this place", None, None)]
    found, lines, near, mixed, encoded = stages_of(spark, rows)
    assert found == sorted([(None, words), (4, words), (4, words), (5, long), (6, "alone in this place")], key=str)
    assert lines == sorted([(None, ""), (4, words), (4, words), (5, long), (6, "alone in this place")], key=str)  # equal rows of one id keep what one alone would
    assert near == sorted([(None, ""), (4, words), (5, long), (6, "alone in this place")], key=str)
    assert {d for d, _ in mixed} == {4, 5, 6} and all(t in dict(near)[d] for d, t in mixed)
    assert [d for d, _, _ in encoded] == [d for d, _ in mixed] and all(some and same for _, some, same in encoded)


def test_run_equals_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    key = lambda df: sorted((r["doc_id"], r["decoded_sha256"], r["n_tokens"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(want)
