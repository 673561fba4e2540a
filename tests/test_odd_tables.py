"""Queries against their SQL in DuckDB, on tables whose values the test data doesn't have."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidewell.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL, in order, over ``tables``."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    theirs = con.sql(SQL[name])
    ours = QUERIES[name](spark, str(folder)).select(*theirs.columns)
    order = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return order(ours.collect()), order(theirs.fetchall())


def embeddings(vectors):
    return pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})


def test_arrays_zip_pad_multiplies_in_the_floats_of_the_vectors(spark, tmp_path):
    whole = np.arange(-999, 1000, dtype=np.float32) / np.float32(1000)
    near = np.concatenate([np.nextafter(whole, np.float32(-2)), whole, np.nextafter(whole, np.float32(2))])
    rows = near[: len(near) // 16 * 16].reshape(-1, 16)
    ours, theirs = both(spark, tmp_path, "arrays_zip_pad", embeddings=embeddings([r.tolist() for r in rows]))
    assert len(ours) == 5 * len(rows) and ours == theirs


def test_arrays_zip_pad_has_five_rows_of_vectors_of_any_width_and_keeps_odd_numbers(spark, tmp_path):
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 3e38, -3e38, 1e20, 12345.678, -1e-30, 1e-30, None]
    vectors = [None, [], [0.5], [0.1] * 12, odd, odd[::-1], [-0.25] * 10 + odd]
    ours, theirs = both(spark, tmp_path, "arrays_zip_pad", embeddings=embeddings(vectors))
    assert len(ours) == 5 * len(vectors) and ours == theirs


def test_path_template_of_keys_of_any_length(spark, tmp_path):
    keys = [0, 7, 999, 1000, 99_999, 100_000, 999_999, 1_000_000, 1_234_567, 10_000_000, 123_456_789_012]
    orders = pq.read_table("/root/testdata/sf0.001/orders.parquet").slice(0, len(keys))
    orders = orders.set_column(orders.schema.get_field_index("o_orderkey"), "o_orderkey", pa.array(keys, pa.int64()))
    lines = pq.read_table("/root/testdata/sf0.001/lineitem.parquet")
    ours, theirs = both(spark, tmp_path, "path_template", orders=orders, lineitem=lines)
    assert len(ours) == len(keys) and ours == theirs
