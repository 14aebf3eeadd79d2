"""Shared helpers: the folder for cut lineage, and documents with one row an id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.shared import deleted, new_path


def saved(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again; cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*dfs: DataFrame) -> None:
    """Deletes what `saved` wrote for these, when nothing will read it any more."""
    for df in dfs:
        path = getattr(df, "_saved_at", None)
        if path:
            deleted(path)


def repeated_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame | None:
    """The ids that more than one row has, or None if there are none; reads the id column alone."""
    found = docs.groupBy(key).count().where(F.col("count") > 1).where(F.col(key).isNotNull()).select(key)
    return None if found.isEmpty() else found


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string) with every id once.

    Rows with a null id are left out, since no result could name them; a null
    text counts as empty.  The distinct texts of an id that several rows have
    are put together in order, a line break between.  Other columns are dropped.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    twice = repeated_ids(slim)
    if twice is None:
        return slim
    merged = slim.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.concat_ws("\n", F.sort_array(F.collect_set("text"))).alias("text"))
    return slim.join(twice, "doc_id", "left_anti").unionByName(merged)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows in an Arrow batch than Spark's 10000, where the session hasn't set another number: texts may be long, and both the JVM and Python hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with columns of these names renamed, and a function that names them back."""
    away = {c: f"aside_{i}_{c}" for i, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(away), lambda df: df.withColumnsRenamed({v: k for k, v in away.items()})


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether `df` has no more than `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def semi(docs: DataFrame, ids: DataFrame, how: str = "left_semi", broadcast_rows: int = 4_000_000) -> DataFrame:
    """`docs` with (left_semi) or without (left_anti) the doc_ids of `ids`.

    Up to `broadcast_rows` ids (about 64 MB) are broadcast, so that no text is
    shuffled; beyond that Spark's shuffled join is taken.  Null ids match nothing.
    """
    return docs.join(F.broadcast(ids) if small_enough(ids, broadcast_rows) else ids, "doc_id", how)
