"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest. A batch is reduced to one row a digest (with map-side
combining, so a digest that a third of all rows share costs one row a task), deduplicated against the index by a
sort-merge anti-join for which only the batch is shuffled, and what is new is appended to the index.

A batch has a name, which the index keeps with its rows. A batch that is ingested again under its name, as after a run that
ended between append and result, meets the rows of other batches only, and gives the same result without another append.
Each append adds a file a bucket; ``compact`` makes one file a bucket of them again, so that a scan need not sort
(where the session trusts that order: spark.sql.legacy.bucketedTableScan.outputOrdering).

Defined results: a null text counts as empty; repeated rows, even with equal ids, leave exactly one row; a null id is the
smallest; an empty batch leaves the index as it is; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import join_groups, materialize, parts


class DigestIndex:
    """``name``: the index's table; a new table is made unless it exists. ``buckets``: of a new table."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name or f"winnow_digests_{uuid.uuid4().hex}", buckets or parts(spark)
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], "digest binary, keep_id long, batch string"))

    def _append(self, rows: DataFrame, name: str | None = None) -> None:
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(name or self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicates a batch and adds it to the index. One row for each row of the batch: row_id (as the rows were
        numbered), id, keep_id (of the row that stays, possibly of an earlier batch), group_size (rows of this batch with
        the text), kept, text_sha256. ``batch``: its name; without one it can't be repeated."""
        named, batch = batch is not None, batch or uuid.uuid4().hex
        digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), digest.alias("digest"))
        rows = materialize(rows, "digests")  # numbered once
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row_id")).alias("top"), F.count("*").alias("group_size"))
        others = self.spark.table(self.name).filter(F.col("batch") != batch).select("digest", "keep_id").hint("merge")
        new = groups.join(others, "digest", "left_anti").select("digest", "group_size", F.col("top.id").alias("keep_id"), F.col("top.row_id").alias("keep_row"), F.lit(True).alias("new"))
        old = groups.join(others, "digest").select("digest", "group_size", "keep_id", F.lit(None).cast("long").alias("keep_row"), F.lit(False).alias("new"))
        judged = materialize(new.unionByName(old), "judged")
        fresh = judged.filter("new").select("digest", "keep_id", F.lit(batch).alias("batch"))
        if named:
            fresh = fresh.join(self.spark.table(self.name).filter(F.col("batch") == batch).hint("merge"), "digest", "left_anti")
        self._append(fresh.repartition(self.buckets, "digest"))
        both = join_groups(rows, judged, ["digest"], "group_size", rows.count())
        kept = F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept")
        return both.select("row_id", F.col("id").alias(id_col), "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self) -> None:
        """One sorted file a bucket. The new table is whole before it takes the place of the old one."""
        whole = f"{self.name}_{uuid.uuid4().hex}"
        self._append(self.spark.table(self.name).repartition(self.buckets, "digest"), whole)
        self.drop()
        self.spark.sql(f"ALTER TABLE {whole} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table ``docs`` that stay, with their columns. They are found again by text and id, as another scan may
    number rows otherwise; of rows that repeat both, any one stays."""
    index = DigestIndex(docs.sparkSession)
    found = index.ingest(docs, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("keep_id")))
    index.drop()
    kept = found.groupBy(F.unhex("text_sha256").alias("__winnow_kept"), F.col(id_col).alias("__winnow_id")).agg(F.count("*").alias("__winnow_n"), F.max("kept").alias("__winnow_new"))
    kept = materialize(kept.filter("__winnow_new").drop("__winnow_new"), "kept")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.withColumn("__winnow_digest", digest)
    same = (F.col("__winnow_digest") == F.col("__winnow_kept")) & F.col(id_col).cast("long").eqNullSafe(F.col("__winnow_id"))
    once = rows.join(kept.filter("__winnow_n = 1"), same, "left_semi").select(*docs.columns)
    if kept.filter("__winnow_n > 1").isEmpty():
        return once
    repeated = rows.join(kept.filter("__winnow_n > 1"), same, "left_semi")
    one = repeated.groupBy("__winnow_digest").agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")  # combined in each task
    return once.unionByName(one)
