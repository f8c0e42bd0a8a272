"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths given out within each open `scoped`, the innermost last.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. A session without one gets a temporary folder if all of it runs in this process."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to a scratch table and read back: cuts lineage, so a lost executor costs a reread. options: of the writer."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """As `stored`, packed tighter, and what the write has shuffled goes with its end, not with the driver's garbage: for jobs
    that deal a large table several times."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df, name, compression="zstd")
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `stored` gave and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all scratch tables that were made inside; what is built on them has to be written before that.

    with scoped(spark):
        public_guide(...).write.parquet(path)
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)
