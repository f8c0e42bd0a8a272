"""Deliveries of a table's files, each with the columns and types it happens to have, brought to the declared schema.

Nothing is lost: a row that can't be read, or holds what its table does not allow, is kept aside with the reason and its whole
content as JSON. A value of another type is cast; only one that can't be is drift.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import ALLOWED, SCHEMAS


class Delivered(NamedTuple):
    """rows: of the declared columns and `delivery`; aside: delivery, reason, content."""

    rows: DataFrame
    aside: DataFrame


def declared(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str, delivery: str, corrupt: Column | None = None) -> Delivered:
    """df as rows of the declared table. Columns it lacks are null, those it has beside them are only kept aside.

    The first reason that holds: corrupt (the reader's column), drift (a value that is not of its column's type) or not allowed
    (by the list of the table's checked columns), the last two with the column's name.
    """
    fields = declared(name).fields
    has = {c.lower(): c for c in df.columns}
    typed, drift, wrong = [], [], []
    for f in fields:
        own = has.get(f.name.lower())
        if own is None:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        kind = df.schema[own].dataType
        value = F.col(f"_src.{own}")
        if kind == f.dataType:
            typed.append(value.alias(f.name))
            continue
        plain = value if kind.typeName() not in ("struct", "array", "map") else F.to_json(value)
        cast = plain.try_cast(f.dataType)
        typed.append(cast.alias(f.name))
        drift.append(F.when(value.isNotNull() & cast.isNull(), f"drift: {f.name}"))
    for (table, c), values in ALLOWED.items():
        if table == name:
            got = F.col(f"_row.{c}")
            wrong.append(F.when(got.isNotNull() & ~got.isin(values), f"not allowed: {c}"))
    told = [F.when(corrupt, "corrupt")] if corrupt is not None else []
    src = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("_src"))
    rows = src.select("_src", F.struct(*typed).alias("_row"))
    rows = rows.withColumn("reason", F.coalesce(*told, *drift, *wrong, F.lit(None).cast("string")))
    return Delivered(
        rows.filter("reason is null").select("_row.*", F.lit(delivery).alias("delivery")),
        rows.filter("reason is not null").select(F.lit(delivery).alias("delivery"), "reason", F.to_json("_src").alias("content")),
    )


def read_delivery(spark: SparkSession, path: str, name: str, delivery: str) -> Delivered:
    """One folder or file of Parquet, or of JSON lines where its name ends in `json`."""
    if not path.rstrip("/").endswith("json"):
        return conform(spark.read.parquet(path), name, delivery)
    # numbers and times as their text, so that a value of another type is told from one that is missing
    text = StructType()
    for f in declared(name).fields:
        text = text.add(f.name, "string")
    read = spark.read.schema(text.add("_corrupt_record", "string")).json(path)
    return conform(read, name, delivery, F.col("_src._corrupt_record").isNotNull())


def deliveries(spark: SparkSession, root: str) -> list[str]:
    """Names of what lies in a folder, in order; those that begin with `_` or `.` are no deliveries."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n[0] not in "_.")


def read_deliveries(spark: SparkSession, root: str, name: str) -> Delivered:
    """All deliveries of a table: each read with its own schema and brought to the declared one, then united."""
    rows, aside = None, None
    for n in deliveries(spark, root):
        one = read_delivery(spark, f"{root}/{n}", name, n)
        rows = one.rows if rows is None else rows.unionByName(one.rows)
        aside = one.aside if aside is None else aside.unionByName(one.aside)
    if rows is None:
        none = spark.createDataFrame([], f"{SCHEMAS[name]}, delivery string")
        return Delivered(none, spark.createDataFrame([], "delivery string, reason string, content string"))
    return Delivered(rows, aside)
