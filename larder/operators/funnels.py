"""Funnels over any number of events a person: ranges of events become summaries that combine, so nobody's events are collected.

An attempt starts with the first step; each later step counts if it comes within the limit of the start. Every start is an
attempt of its own, so somebody who comes back gets another chance. Of the attempts that have come equally far only the latest
matters, since it has most time left; so what has to be known is, for each step, the latest start that got there.

A range of a person's events does two things: it starts attempts of its own, and it carries those that come into it further. For
the second it keeps the earliest time at which an attempt that enters with i steps has j: it gets there if that time is within
the limit of its start. Two such summaries make one, so a person may be spread over any number of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Summary:
    """What a range of events does to attempts at a funnel of so many steps, the last of them within `limit` of the start."""

    steps: int
    limit: int
    started: dict[int, int] = field(default_factory=dict)  # steps done: latest start of this range that got there
    carried: dict[tuple[int, int], int] = field(default_factory=dict)  # steps before and after: earliest time
    done: int = 0

    def add(self, step: int, t: int) -> None:
        """One event, no earlier than those before."""
        for i in range(1, step + 1):
            if i == step or (i, step) in self.carried:
                self.carried.setdefault((i, step + 1), t)
        if step == 0:
            self.started[1] = t
            self.done = max(self.done, 1)
        elif step in self.started and t - self.started[step] <= self.limit:
            self.started[step + 1] = max(self.started[step], self.started.get(step + 1, self.started[step]))
            self.done = max(self.done, step + 1)

    def then(self, after: Summary) -> Summary:
        """This range and the one behind it as one."""
        out = Summary(self.steps, self.limit, dict(after.started), dict(self.carried), max(self.done, after.done))
        for j, start in self.started.items():
            out.started[j] = max(start, out.started.get(j, start))
        for (i, j), t in after.carried.items():
            start = self.started.get(i)
            if start is not None and t - start <= self.limit:
                out.started[j] = max(start, out.started.get(j, start))
                out.done = max(out.done, j)
            # in here with h steps, at i when this range ends, at j in the next
            for h in range(1, i + 1):
                if h == i or (h, i) in self.carried:
                    out.carried[h, j] = min(t, out.carried.get((h, j), t))
        return out


def _packed(s: Summary) -> tuple[list, list, int]:
    return [{"a": j, "b": 0, "t": t} for j, t in s.started.items()], [{"a": i, "b": j, "t": t} for (i, j), t in s.carried.items()], s.done


_MARK = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("t", pa.int64())]))
_MARKS = "array<struct<a:int,b:int,t:bigint>>"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def funnel_progress(events: DataFrame, steps: list[Column], hours: float = 24, key: str = "user_id") -> DataFrame:
    """(key, done): how many of the steps each person did in order in one attempt, all within so many hours of its first.

    events: key, ts and what the steps ask for; an event is the first step that it fits. Events at one time count in the order of
    the steps. A null key is a person like any other; events that are no step don't count.
    """
    spark = events.sparkSession
    which = F.coalesce(*(F.when(s, i) for i, s in enumerate(steps)))
    rows = events.select(key, F.unix_micros("ts").alias("t"), which.alias("s")).filter("s is not null and t is not null")
    limit, n, kind = int(hours * 3_600_000_000), len(steps), rows.schema[key].dataType.simpleString()
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "t", "s").sortWithinPartitions(key, "t", "s")

    def walked(batches):
        schema, now, who, out = None, None, None, []
        for batch in batches:
            schema = schema or pa.schema([(key, batch.schema.field(0).type), ("started", _MARK), ("carried", _MARK), ("done", pa.int32())])
            for at in range(0, batch.num_rows, 8192):
                for k, t, s in zip(*(c.to_pylist() for c in batch.slice(at, 8192).columns)):
                    if now is None or k != who:
                        if now is not None:
                            out.append((who, *_packed(now)))
                        now, who = Summary(n, limit), k
                    now.add(s, t)
                if out:
                    yield _emit(out, schema)
                    out = []
        if now is not None:
            yield _emit([(who, *_packed(now))], schema)

    ranges = dealt.mapInArrow(walked, f"{key} {kind}, started {_MARKS}, carried {_MARKS}, done int").withColumn("range", F.spark_partition_id())

    def joined(batches):
        schema, now, out, who = None, None, [], None
        for batch in batches:
            schema = schema or pa.schema([(key, batch.schema.field(0).type), ("done", pa.int32())])
            for k, started, carried, done in zip(*(batch.column(c).to_pylist() for c in range(4))):
                one = Summary(n, limit, {x["a"]: x["t"] for x in started}, {(x["a"], x["b"]): x["t"] for x in carried}, done)
                if now is not None and k == who:
                    now = now.then(one)
                    continue
                if now is not None:
                    out.append((who, now.done))
                now, who = one, k
            if out:
                yield _emit(out, schema)
                out = []
        if now is not None:
            yield _emit([(who, now.done)], schema)

    # a person has a row a range: one, or few if their events fill whole ranges
    together = ranges.repartition(key).sortWithinPartitions(key, "range")
    return together.mapInArrow(joined, f"{key} {kind}, done int")


def funnel(events: DataFrame, steps: list[Column], hours: float = 24) -> DataFrame:
    """(step, users): people, other than internal ones, who came to each step in one attempt; a row a step, from 1."""
    done = funnel_progress(events.filter("not internal"), steps, hours)
    counted = done.groupBy("done").agg(F.count("*").alias("n"))  # a row a step at most
    each = counted.select(F.explode(F.sequence(F.lit(1), F.lit(len(steps)))).alias("step"), F.when(F.col("done") >= F.col("step"), F.col("n")).otherwise(0).alias("n"))
    return each.groupBy("step").agg(F.sum("n").alias("users"))
