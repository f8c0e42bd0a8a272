"""Tables that are written piece by piece: streams appended exactly once, rows laid over a table of buckets, old days dropped.

All three write partitions as wholes and leave the others' files alone, so that a piece done again is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .scratch import dropped, stored


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is at the path; no rows before anything is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _overwrite(df: DataFrame, path: str, *parts: str) -> None:
    """Overwrites the partitions that df has rows of, and no others; a partition in few files, a large one in several."""
    df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def append_batch(df: DataFrame, batch: int, path: str, part: str = "date") -> None:
    """Adds one micro-batch to a table in partitions of `part`, under its number; done again, it overwrites what it wrote."""
    _overwrite(df.withColumn("batch", F.lit(batch).cast("bigint")), path, part, "batch")


def append_stream(stream: DataFrame, path: str, checkpoint: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df, part: str = "date") -> None:
    """Adds what the stream has not given yet, as `rows` makes it, each row once, whatever is restarted.

    A table is one stream's: the number of a batch is its name in the table. rows works on a micro-batch and gives the column
    `part`, which must not be null.
    """
    keep = lambda df, k: append_batch(rows(df), k, path, part)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert_table(updates: DataFrame, path: str, keys: list[str], order: str, buckets: int = 64) -> None:
    """Lays updates over a table in buckets of its keys; of several updates of a key the last by `order`, then in all, holds.

    Only the buckets that have updates are read and written, so the work goes with them and not with the table; their new rows
    are on disk before the old ones go. Nulls are keys like any other. The number of buckets is the table's for good.
    """
    spark = updates.sparkSession
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema]
    several = F.max(F.struct(order, *[c for c in updates.columns if c != order])).alias("_last")
    placed = updates.withColumn("bucket", bucket_of(keys, buckets))
    last = stored(placed.groupBy("bucket", *keys).agg(several).select("_last.*", "bucket"), "updates")
    touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # no more than there are buckets
    if not touched:
        return
    table = read_parts(spark, path, ", ".join([*fields, "bucket int"])).filter(F.col("bucket").isin(touched))
    same = [table[k].eqNullSafe(last[k]) for k in keys]
    on = table["bucket"] == last["bucket"]
    for k in same:
        on = on & k
    new = stored(table.join(last, on, "left_anti").unionByName(last), "upserted")
    _overwrite(new, path, "bucket")
    dropped(last)
    dropped(new)


def drop_days(spark: SparkSession, path: str, before: str, part: str = "date") -> list[str]:
    """Deletes the partitions of days before that one (yyyy-mm-dd) and names them; the others' files stay."""
    context = spark.sparkContext
    fs_path = context._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    gone = []
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith(f"{part}=") and name.split("=", 1)[1][:10] < before and name[len(part) + 1].isdigit():
            fs.delete(folder.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)


def prune_table(spark: SparkSession, path: str, schema: str, before: str, at: str = "created_at", part: str = "date") -> None:
    """Drops rows from before a time: whole days by their partition, and of the day itself the rows before the time.

    before: yyyy-mm-dd hh:mm:ss, session time, which `part` was made in. Rows without a time stay.
    """
    drop_days(spark, path, before[:10], part)
    day = F.lit(before[:10]).cast("date")
    edge = read_parts(spark, path, schema).filter(F.col(part) == day)
    # a day's batches are one partition each; one that loses all its rows is deleted, as nothing would overwrite it
    left = stored(edge.withColumn("_old", F.coalesce(F.col(at) < F.lit(before).cast("timestamp"), F.lit(False))), "edge")
    counts = left.groupBy("batch").agg(F.count_if(F.col("_old")).alias("old"), F.count("*").alias("n")).filter("old > 0")
    context = spark.sparkContext
    for r in counts.collect():  # a row a batch of one day
        if r.old == r.n:
            folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={before[:10]}/batch={r.batch}")
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        else:
            _overwrite(left.filter((F.col("batch") == r.batch) & ~F.col("_old")).drop("_old"), path, part, "batch")
    dropped(left)
