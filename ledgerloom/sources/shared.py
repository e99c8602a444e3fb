"""Tables in the folder that driver and executors share, and how many tasks their rows are dealt to."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


ROWS_PER_TASK, FEWEST_ROWS = 200_000, 10_000


def tasks_for(rows: DataFrame) -> int:
    """How many tasks to deal rows to that are sorted and walked through there.

    Adaptive execution joins partitions by their compressed bytes, of which narrow rows have few, while the memory of sorts grows
    with the rows; it leaves a number that is named as it is."""
    n = rows.count()
    return max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FEWEST_ROWS), n // ROWS_PER_TASK)


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir.  Only where all run in one process may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or _own_folder()).rstrip('/')}/ledgerloom/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet and read it back: what is used several times is computed once, and lineage ends there."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
