"""Exact dedup over a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table of one row per distinct digest, clustered and sorted by the digest, so a later batch is
anti-joined against it by a sort-merge join that neither shuffles nor sorts the index side. Only digests move: a
batch is first reduced to its distinct digests by a map-side combine, so a group of copies of any size reaches a
reducer as one row for each task.

Defined cases: a null text equals the empty text; texts are compared as they are, byte by byte; of equal new texts
the row with the largest ``doc_id`` stays, and exactly one row: null ids lose to any id, and where all are null, or
several rows have the largest id, one of them stays; an empty table gives an empty result and an unchanged index.
Columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, documents, materialise, shared_dir

#: A digest that holds at least this share of the batch is joined by broadcast; there are at most 1/share of them.
HOT_SHARE = 0.001


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest``: the lowercase hex SHA-256 of each whole text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


class DigestIndex:
    """A persistent set of digests, each with the id of the document that stays, and the batch and row that brought it."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, group_size BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame, name: str) -> None:
        """Add the digests of ``batch`` (``digest, keep_id, group_size, keep_row``, one row each) that the index lacks."""
        fresh = batch.join(self.table.select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(name))
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def lookup(self, rows: DataFrame, batch: DataFrame) -> DataFrame:
        """``rows`` with the columns of the index; the rows of a digest that is hot in their ``batch`` meet it by broadcast."""
        hot = F.broadcast(batch.filter(F.col("group_size") >= max(2, int(rows.count() * HOT_SHARE))).select("digest"))
        common = rows.join(F.broadcast(self.table.join(hot, "digest", "left_semi")), "digest")
        others = rows.join(hot, "digest", "left_anti").join(self.table.join(hot, "digest", "left_anti").hint("merge"), "digest")
        return common.unionByName(others)

    def drop(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Without ``index``, a new one is made in the shared folder for this call, and dropped. With one, a text that an
    earlier batch holds is a copy of that batch's row, and ``group_size`` counts the batch that brought the text.
    """
    spark, name, own = docs.sparkSession, f"digest_index_{uuid.uuid4().hex}", index is None
    if own:
        index = DigestIndex(spark, name, f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialise(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    batch = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"))
    batch = materialise(batch, "batch")  # else the optimiser moves the anti-join, and its shuffle, before the combining
    index.append(batch, name)
    kept = (F.col("batch") == name) & (F.col("row") == F.col("keep_row"))
    found = index.lookup(rows, batch).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
    found = materialise(found, "exact")
    discard(rows, batch)
    if own:
        index.drop()
    return found


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""
