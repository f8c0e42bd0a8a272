"""Limits by address on streams: searches, and votes that must also be new. Each micro-batch is decided as a whole, exactly once.

A limit depends on the order of a key's rows, and what a stateful operator gets of a key comes in no order and has to be held to
be sorted. So the batches are decided here: dealt by key and sorted by time on disk, then walked row by row, with at most `most`
accepted times of one key in hand, whatever its number of rows. The state is a table, written under the number of its batch; a
batch that is done again reads the state before it and overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from larder.operators.editing import validate_votes
from larder.sources.scratch import scratch, stored

DAY = 86_400


class Held:
    """The latest accepted times of one key, in seconds: at most `most`, which is all that a limit depends on."""

    def __init__(self, times=(), most: int = 15, span: int = 3600):
        self.most, self.span, self.times = most, span, sorted(times)[-most:]

    def full(self, t: int) -> bool:
        return sum(x > t - self.span for x in self.times) >= self.most

    def add(self, t: int) -> None:
        self.times = sorted([*self.times, t])[-self.most :]


def _walked(rows: DataFrame, held: DataFrame, most: int, span: int) -> DataFrame:
    """rows: key, at, id, mark; held: key, times. (key, at, id, mark, verdict, times): a verdict a row, accepted, refused or, where
    the mark was accepted of the same key before, repeat; and a row a key with its times afterwards and no verdict. A null mark is
    never a repeat."""
    before = held.select("key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("mark"), "times")
    both = before.unionByName(rows.select("key", F.lit(1).alias("kind"), "at", "id", "mark", F.lit(None).cast("array<bigint>").alias("times")))
    schema = pa.schema([("key", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("mark", pa.string()), ("verdict", pa.string()), ("times", pa.list_(pa.int64()))])

    def run(batches):
        now, state, marks, any_yet = None, Held((), most, span), set(), False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                out = []
                for key, kind, t, i, mark, times in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns)):
                    if key != now or not any_yet:
                        if any_yet:
                            out.append((now, None, None, None, None, state.times))
                        now, state, marks, any_yet = key, Held((), most, span), set(), True
                    if not kind:
                        state = Held(times, most, span)
                        continue
                    verdict = "repeat" if mark is not None and mark in marks else "refused" if state.full(t) else "accepted"
                    if verdict == "accepted":
                        state.add(t)
                        marks.add(mark)  # accepted ones only, so few a day
                    out.append((key, t, i, mark, verdict, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, None, None, None, None, state.times), schema)], schema=schema)

    walked = both.repartition("key").sortWithinPartitions("key", "kind", "at", "id")
    return walked.mapInArrow(run, "key string, at bigint, id bigint, mark string, verdict string, times array<bigint>")


def _table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What is at the path, of earlier batches only if so asked; no rows where nothing is yet."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch bigint")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_batches(stream: DataFrame, home: str, decide: Callable[[DataFrame, int], None], files: int | None = None) -> None:
    """Feeds what the stream has not fed yet to `decide`, batch by batch; its progress is kept in home."""
    query = stream.writeStream.option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).foreachBatch(decide).start()
    query.awaitTermination()


# --- searches ---------------------------------------------------------------------------------------------------------

_STATE = "key string, times array<bigint>"
_VERDICTS = "id bigint, key string, allowed boolean"


def limit_batch(batch: DataFrame, k: int, home: str, key: str, most: int, span: int) -> None:
    """Decides one batch (key, id, created_at): verdicts and state go to home under its number."""
    spark = batch.sparkSession
    before = _table(spark, f"{home}/state", _STATE, k)
    last = before.agg(F.max("batch")).first()[0]
    rows = batch.select(F.col(key).cast("string").alias("key"), F.unix_seconds("created_at").alias("at"), F.col("id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("mark"))
    held = before.filter(F.col("batch") == F.lit(last)).select("key", "times")
    out = stored(_walked(rows, held, most, span), "walked")
    newest = out.agg(F.max("at")).first()[0]
    fresh = F.lit(True) if newest is None else F.element_at("times", -1) > newest - 2 * span  # rows may be late by a span
    _write(out.filter("verdict is not null").select("id", "key", (F.col("verdict") == "accepted").alias("allowed")), f"{home}/verdicts", k)
    _write(out.filter("verdict is null and size(times) > 0").filter(fresh).select("key", "times"), f"{home}/state", k)


def rate_limit(events: DataFrame, key: str = "ip_hash", most: int = 15, span: int = 3600, home: str | None = None) -> DataFrame:
    """events: a stream of key, id, created_at. (id, key, allowed) of every row so far: allowed if fewer than `most` accepted ones
    of the key lie in the `span` seconds before it. Only accepted ones count.

    Rows are judged as they come: within a micro-batch by time and id, a late one after those of the batches before, whose later
    times count against it. A key's state goes when its last accepted time is two spans behind the newest row. home: a folder that
    driver and executors share; with one of its own, what comes later goes on where this ended.
    """
    home = home or scratch(events.sparkSession, "limits")
    run_batches(events, home, lambda batch, k: limit_batch(batch, k, home, key, most, span))
    return _table(events.sparkSession, f"{home}/verdicts", _VERDICTS).select("id", F.col("key").alias(key), "allowed")


# --- votes ------------------------------------------------------------------------------------------------------------

_ACCEPTED = "id bigint, email string, city string, country string, ip_hash string, mark string, at bigint"
_TOLD = "id bigint, verdict string"


def vote_mark(email: Column, city: Column, country: Column) -> Column:
    """Names a vote: one a person and city, in any case of letters; null counts as ''."""
    part = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.to_json(F.array(part(email), part(city), part(country)))


def vote_batch(batch: DataFrame, k: int, home: str, most: int = 10, span: int = DAY) -> None:
    """Decides one batch of votes: id, email, city, country, ip_hash, created_at, and error, null where the vote is valid.

    A vote already accepted is a repeat and costs nothing; of new ones an address may cast `most` in `span` seconds. Addresses are
    walked side by side. Where two of them accept one vote, the earlier one has it; the other gets its place back, so what it
    refused is tried again, until no two agree. Each round's verdicts stand: an accepted vote stays acceptable with fewer others.
    """
    spark = batch.sparkSession
    earlier = _table(spark, f"{home}/accepted", _ACCEPTED, k)
    votes = batch.select("id", "email", "city", "country", F.col("ip_hash").cast("string").alias("key"), F.unix_seconds("created_at").alias("at"), "error")
    votes = stored(votes.withColumn("mark", vote_mark(F.col("email"), F.col("city"), F.col("country"))), "votes")
    told = votes.filter("error is not null").select("id", F.concat(F.lit("invalid: "), "error").alias("verdict"))
    valid = votes.filter("error is null")
    known = earlier.select("mark").distinct()
    told = told.unionByName(valid.join(known, "mark", "left_semi").select("id", F.lit("repeat").alias("verdict")))
    todo = stored(valid.join(known, "mark", "left_anti").select("key", "at", "id", "mark"), "todo")
    # only times that can still count against a vote of this batch
    oldest = todo.agg(F.min("at")).first()[0]
    times = lambda df: df.groupBy("key").agg(F.slice(F.reverse(F.array_sort(F.collect_list("at"))), 1, most).alias("times"))
    held = stored(times(earlier.filter(F.col("at") > F.lit(oldest) - span).select(F.col("ip_hash").alias("key"), "at")), "held")
    accepted = None
    while True:
        out = stored(_walked(todo, held, most, span).filter("verdict is not null"), "walked")
        first = out.filter("verdict = 'accepted'").groupBy("mark").agg(F.min(F.struct("at", "id", "key")).alias("w"))
        out = stored(out.drop("times").join(first, "mark", "left").withColumn("won", F.col("w").eqNullSafe(F.struct("at", "id", "key"))), "met")
        won = out.filter("verdict = 'accepted' and won").dropDuplicates(["mark"]).select("key", "at", "id", "mark")
        accepted = stored(won if accepted is None else accepted.unionByName(won), "won")
        lost = out.filter("verdict = 'accepted' and not won").select(F.col("key").alias("_key")).distinct().withColumn("gave_back", F.lit(True))
        out = stored(out.join(lost, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key"), "judged")
        back, there = F.coalesce(F.col("gave_back"), F.lit(False)), F.col("w").isNotNull()
        refused = F.col("verdict") == "refused"
        left = out.filter(refused & back & ~there).select("key", "at", "id", "mark")
        # a repeat follows the vote it repeats; what was refused before that stays refused, if with reason
        late = F.struct("at", "id") > F.struct(F.col("w.at"), F.col("w.id"))
        verdict = F.when(~refused | (there & (late | back)), "repeat").otherwise("refused")
        final = out.filter(~((F.col("verdict") == "accepted") & F.col("won")) & ~(refused & back & ~there))
        told = told.unionByName(final.select("id", verdict.alias("verdict")))
        if left.isEmpty():
            break
        todo = left
        now = accepted.select("key", "at").unionByName(earlier.filter(F.col("at") > F.lit(oldest) - span).select(F.col("ip_hash").alias("key"), "at"))
        held = stored(times(now), "held")
    names = votes.select("id", "mark", "email", "city", "country", F.col("key").alias("ip_hash"), "at").dropDuplicates(["id", "mark"])
    _write(names.join(accepted.select("id", "mark"), ["id", "mark"], "left_semi").select("id", "email", "city", "country", "ip_hash", "mark", "at"), f"{home}/accepted", k)
    _write(told.unionByName(accepted.select("id", F.lit("accepted").alias("verdict"))), f"{home}/told", k)


def checked_votes(votes: DataFrame, cities: DataFrame) -> DataFrame:
    """votes with their city and country as the list writes them, the person's address trimmed and in small letters, and an error
    where city, country, region, email or ip_hash are not as they must be."""
    place = validate_votes(votes, cities).select(F.col("id").alias("_id"), F.col("city").alias("_city"), F.col("country").alias("_country"), F.col("error").alias("_error"))
    rows = votes.withColumn("email", F.lower(F.trim("email"))).join(place, F.col("id") == F.col("_id"))
    person = F.when(~F.coalesce(F.length("email").between(3, 254), F.lit(False)), "email")
    hashed = F.when(~F.coalesce(F.col("ip_hash").rlike("^([0-9a-f]{16}|[0-9a-f]{64})$"), F.lit(False)), "ip_hash")
    rows = rows.withColumn("error", F.coalesce("_error", person, hashed))
    fine = F.col("error").isNull()
    named = {"city": F.when(fine, F.col("_city")).otherwise(F.col("city")), "country": F.when(fine, F.col("_country")).otherwise(F.col("country"))}
    return rows.withColumns(named).drop("_id", "_city", "_country", "_error")


def vote_ingest(votes: DataFrame, home: str, cities: DataFrame | None = None, taken: DataFrame | None = None, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(accepted, told) after what the stream `votes` has not given yet: accepted votes (id, email, city, country, ip_hash, at) of
    all deliveries, and a verdict (id, verdict: accepted, repeat, refused or invalid) for every vote.

    votes: id, email, city, country, region, is_custom, ip_hash, created_at. cities: the list they are
    checked against, if given. taken: votes accepted before home was begun, same columns. Ids name votes; a refused vote is
    not kept, so it can be sent again and is then decided anew.
    """
    spark = votes.sparkSession
    if taken is not None and _table(spark, f"{home}/accepted", _ACCEPTED).isEmpty():
        own = taken.withColumn("mark", vote_mark(F.col("email"), F.col("city"), F.col("country"))).withColumn("at", F.unix_seconds("created_at"))
        _write(own.select("id", "email", "city", "country", F.col("ip_hash").cast("string").alias("ip_hash"), "mark", "at"), f"{home}/accepted", -1)

    def decide(batch: DataFrame, k: int) -> None:
        checked = batch.withColumn("error", F.lit(None).cast("string")) if cities is None else checked_votes(batch, cities)
        vote_batch(checked, k, home, most)

    run_batches(votes, home, decide)
    return _table(spark, f"{home}/accepted", _ACCEPTED).drop("batch", "mark"), _table(spark, f"{home}/told", _TOLD).drop("batch")
