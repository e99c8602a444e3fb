"""Idempotent appends and source generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept


def upsert_events(target: DataFrame, batch: DataFrame, key: str, repairable: list[str], order: str | None = None) -> DataFrame:
    """Known ids are no-ops but for NULL metadata, which may be filled; amounts and first captures never change.
    Within a batch the first row of an id (by `order`, or its smallest values) counts."""
    by = [order] if order else [c for c in batch.columns if c != key]
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_r = 1").drop("_r")
    t, b = target.select(key, F.struct(*target.columns).alias("_old")), first.select(key, F.struct(*target.columns).alias("_new"))
    j = t.join(b, key, "full")
    known = F.col("_old").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in repairable else F.when(known, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    return j.select(*((F.col(c) if c == key else pick(c)).alias(c) for c in target.columns))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _among(column: str, values: list) -> Column:
    """Whether a column has one of the values, which may hold NULL."""
    known = F.col(column).isin([v for v in values if v is not None])
    return known | F.col(column).isNull() if None in values else known


def merged_batches(spark: SparkSession, path: str) -> DataFrame:
    """batch, part (as text), new_rows, repaired_rows: what merge_events wrote, a row for each partition that a batch changed, or one with NULLs."""
    return spark.read.parquet(f"{path}/batches/*")


def merge_events(batch: DataFrame, path: str, key: str, repairable: list[str], partition: str, number: int | None = None, order: str | None = None) -> list:
    """S16 as a sink: upsert_events into the table at path/rows, of which only partitions that change are written anew.

    An id's rows have one value of `partition` (a date, say), so the batch's partitions are all that is read, and those where an id is new or
    a NULL is filled all that is rewritten; the values of both are listed on the driver.  A batch's number is noted once its rows are written: it
    is not merged again, and one that failed on its way is merged again without harm, as known ids are no-ops.  What is to be written
    stands in the shared folder before anything is overwritten.  Returns the partitions that were rewritten."""
    spark = batch.sparkSession
    note = f"{path}/batches/{number}"
    if number is not None and _exists(spark, note):
        return []
    rows, columns = f"{path}/rows", batch.columns
    by = [order] if order else [c for c in columns if c != key]
    batch = kept(batch, "batch")
    touched = [r[0] for r in batch.select(partition).distinct().collect()]
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_r = 1").drop("_r")
    stored = spark.read.schema(batch.schema).parquet(rows) if _exists(spark, rows) else batch.where("false")
    old = stored.where(_among(partition, touched)).select(key, F.struct(*columns).alias("_old"))
    j = old.join(first.select(key, F.struct(*columns).alias("_new")), key, "full")
    filled = [F.col(f"_old.{c}").isNull() & F.col(f"_new.{c}").isNotNull() for c in repairable]
    value = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in repairable else F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    is_new = F.col("_old").isNull()
    repaired = ~is_new & (F.array_max(F.array(*filled)) if filled else F.lit(False))
    merged = kept(j.select(*((F.col(c) if c == key else value(c)).alias(c) for c in columns), is_new.alias("_is_new"), F.coalesce(repaired, F.lit(False)).alias("_repaired")), "merged")
    changes = merged.groupBy(F.col(partition).alias("part")).agg(F.count_if("_is_new").alias("new_rows"), F.count_if("_repaired").alias("repaired_rows")).where("new_rows + repaired_rows > 0").collect()
    parts = [r.part for r in changes]
    if parts:
        out = merged.where(_among(partition, parts)).drop("_is_new", "_repaired").repartition(partition)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(rows)
    if number is not None:
        noted = [(number, None if r.part is None else str(r.part), r.new_rows, r.repaired_rows) for r in changes] or [(number, None, None, None)]
        spark.createDataFrame(noted, "batch long, part string, new_rows long, repaired_rows long").coalesce(1).write.mode("overwrite").parquet(note)
    return parts


def merge_sink(path: str, key: str, repairable: list[str], partition: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """S16 in a stream: a foreachBatch function."""

    def batch(df: DataFrame, number: int) -> None:
        merge_events(df, path, key, repairable, partition, number, order)

    return batch


def active_generation(files: DataFrame, path: str, identity: str, order: str) -> DataFrame:
    """Files with `active`: the newest identity of each path."""
    w = Window.partitionBy(path).orderBy(F.desc(order), F.desc(identity))
    return files.withColumn("active", F.row_number().over(w) == 1)


def supersede_generation(files: DataFrame, facts: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """(active facts, retired facts) for files with `active`."""
    live = files.where("active").select(identity)
    return facts.join(live, identity, "left_semi"), facts.join(live, identity, "left_anti")
