"""Shared-folder tables: every intermediate result that is read twice is written where all executors can see it."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset and driver and
    executors are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="winnow-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and that nothing reads any more (later columns on it don't matter)."""
    context = table.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Executors delete the shuffle files of a finished write once the driver has collected it as garbage, which may come
    late by itself. Called after large writes, so that disks hold one large shuffle at a time."""
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most so many bytes: long texts then take less memory in the JVM and in Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_winnow_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    where = Path(tempfile.mkdtemp(prefix="winnow-package-"))
    with zipfile.ZipFile(where / "winnow_package.zip", "w") as z:
        for p in sorted((root / "winnow").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(where / "winnow_package.zip"))
    context._winnow_shipped = True


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group is hot if it has more than one in HOT of all rows; there are fewer than HOT such groups, which bounds the broadcast.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with what is known of each group. ``size``: the column of ``groups`` with a group's number of rows.
    Hot groups are broadcast, so that their rows stay where they are; the others meet by sort-merge."""
    hot = groups.filter(F.col(size) * HOT > total)
    cold = groups.filter(F.col(size) * HOT <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold.hint("merge"), keys))
