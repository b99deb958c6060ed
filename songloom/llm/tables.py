"""Tables written to the shared folder, and positions in a global order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.session import shared_dir


def fresh_path(spark, label: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(df: DataFrame, order: list[Column], label: str, name: str = "pos") -> DataFrame:
    """``df`` in a global order, with gapless positions from 0 in column ``name``.

    Rows are sorted in ranges and written once; a row's number within its range comes with
    it, so only one count per range is gathered. Ranges split a key of any size as long as
    ``order`` ends in a column that tells its rows apart.
    """
    in_range = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = saved(in_range.withColumn("_at", F.monotonically_increasing_id()), label)
    # monotonically_increasing_id() holds the partition above bit 33 and the row below it
    shaped = written.withColumn("_range", F.shiftright("_at", 33))
    total, starts = 0, []
    for row in shaped.groupBy("_range").count().orderBy("_range").collect():  # one row a range
        starts.append((row["_range"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_range long, _start long")
    return (
        shaped.join(F.broadcast(offsets), "_range")  # one row a range
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_range", "_start", "_at")
    )
