"""Exact deduplication as a stateful stream.

A streaming aggregation keyed by the digest of the normalised text holds, on disk (RocksDB) and without expiry, per digest:
the stable identifier of the row that stays, its content locator (file and row), and how many rows came. Rows of a digest
that came more than once are hits: their full bytes are fetched by locator and compared with those of the row that stays.
Texts that share a digest and differ are told apart by their bytes.

State, digests and group changes lie in one folder (`home`). With a `home` of their own, deliveries can come one after the
other: only files that the digests don't have yet are read, only their digests enter the state, and the groups cover all
deliveries so far. A run that broke off goes on where its checkpoint is.

Partial aggregation runs before the shuffle, so a text with any number of copies costs one row a task. The joins on the
digest have one row a digest on one side and can be split where one digest holds many rows.

Defined results: a null text is an empty one, and all empty ones are copies of each other. Ties go to the smallest id, then
to the greatest locator. Every row counts and has a row in the result, also one that is repeated whole; `distinct_documents`
keeps one row of each group. A null id counts as larger than any other. Extra columns are not read, or pass through whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import WHITE_SPACE, scratch, stored, table

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each store sets aside 4 MB of disk for a manifest of a few hundred bytes
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
LAST = 9223372036854775807


def normalised(text: Column) -> Column:
    """Text without any ASCII white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _addressable(docs: DataFrame, home: str) -> DataFrame:
    """(file, row, doc): docs where Spark's reader found them. A derived table, in which a row of a file may stand several times or
    none at all, is first added to what home has of such tables."""
    spark, doc = docs.sparkSession, F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in (c.lower() for c in docs.columns):
        try:
            found = docs.select(*place, doc)
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
        else:  # only places are read for this
            if found.groupBy("file", "row").agg(F.count("*").alias("n")).filter("n > 1 or file is null or row is null").isEmpty():
                return found
    content = docs.select(doc)
    content.write.mode("append").parquet(f"{home}/content")
    return spark.read.schema(content.schema).parquet(f"{home}/content").select(*place, "doc")


def _log(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, digest string, points bigint, file string, row bigint").parquet(f"{home}/digests")


def log_new(content: DataFrame, home: str, digest) -> DataFrame:
    """Adds to home's digests those of files that it doesn't have: a row a document, with id, digest, code points of the original
    text and locator. Gives all of them. Written, since the stream reads them."""
    text = F.col("doc.text")
    rows = content.select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), digest(normalised(text)).alias("digest"), F.char_length(F.coalesce(text, F.lit(""))).cast("bigint").alias("points"), "file", "row")
    try:
        have = _log(content.sparkSession, home).select("file").distinct()
        rows = rows.join(have, "file", "left_anti") if not have.isEmpty() else rows
    except AnalysisException:
        pass  # the first delivery
    rows.select("doc_id", "digest", "points", "file", "row").write.mode("append").parquet(f"{home}/digests")
    return _log(content.sparkSession, home)


_BEST = "struct<points:bigint,order:bigint,doc_id:bigint,file:string,row:bigint>"


def run_stream(spark: SparkSession, home: str, files_per_trigger: int | None = None) -> DataFrame:
    """Feeds home's digests, those not yet fed, through the stateful aggregation; (digest, best, n) of all so far,
    best = struct(points, order, doc_id, file, row)."""
    own = spark.newSession()  # its settings are this stream's alone
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    for key, value in _STATE.items():
        own.conf.set(key, value)
    log = _log(own, home)
    reader = own.readStream.schema(log.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    best = F.max(F.struct("points", (F.lit(LAST) - F.coalesce("doc_id", F.lit(LAST))).alias("order"), "doc_id", "file", "row")).alias("best")
    state = reader.parquet(f"{home}/digests").groupBy("digest").agg(best, F.count("*").alias("n"))
    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda changed, k: changed.write.mode("overwrite").parquet(f"{home}/changes/batch={k}"))
        .start()
    )
    query.awaitTermination()
    try:
        changes = spark.read.schema(f"digest string, best {_BEST}, n bigint, batch int").parquet(f"{home}/changes")
    except AnalysisException:  # nothing came
        return spark.createDataFrame([], f"digest string, best {_BEST}, n bigint")
    # a digest's count only grows, so the last change has the greatest count
    return changes.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select("digest", "s.best", "s.n")


def _hit_texts(content: DataFrame, log: DataFrame, state: DataFrame) -> DataFrame:
    """(file, row, digest, points, doc_id, stays, text) of the rows whose digest came more than once, text normalised, fetched by locator."""
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    hits = log.join(state.filter("n > 1").select("digest", "best"), "digest").select("file", "row", "digest", "points", "doc_id", stays.alias("stays"))
    texts = content.select("file", "row", normalised(F.col("doc.text")).alias("text"))
    return stored(texts.join(hits.hint("shuffle_hash"), ["file", "row"]), "hits")


def _members(content: DataFrame, home: str, digest, files_per_trigger: int | None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, digest, file, row, first: whether it is the one row that stays."""
    log = log_new(content, home, digest)
    state = stored(run_stream(content.sparkSession, home, files_per_trigger), "groups")
    groups = state.select("digest", "best", F.col("n").alias("group_size"))
    hits = _hit_texts(content, log, state)
    # written, so that the join below reads it by an exchange of its own and a digest of very many rows can be split
    stays = stored(hits.filter("stays").select("digest", F.col("text").alias("kept_text")), "stays")
    differing = stored(hits.join(stays, "digest").filter("text <> kept_text").select("digest"), "differing").distinct()
    columns = ["digest", "doc_id", "file", "row", "best", "group_size"]
    member = log.join(groups, "digest", "left").select(*columns)
    if not differing.isEmpty():  # one digest, several texts: those digests' rows are grouped by their bytes
        apart = hits.join(differing, "digest", "left_semi")
        best = F.max(F.struct("points", (F.lit(LAST) - F.coalesce("doc_id", F.lit(LAST))).alias("order"), "doc_id", "file", "row")).alias("best")
        by_text = apart.groupBy("digest", "text").agg(best, F.count("*").alias("group_size"))
        member = member.join(differing, "digest", "left_anti").unionByName(apart.join(by_text, ["digest", "text"]).select(*columns))
    first = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return member.withColumns({"keep_id": F.col("best.doc_id"), "kept": F.col("doc_id").eqNullSafe(F.col("best.doc_id")), "first": first}).drop("best")


def exact_duplicates(docs: DataFrame, digest=lambda text: F.sha2(text, 256), files_per_trigger: int | None = None, home: str | None = None) -> DataFrame:
    """One row a document (doc_id, text): doc_id, keep_id, group_size, kept, digest.

    home: a folder that driver and executors share, kept from delivery to delivery. docs is then the whole table so far, as
    read from its files; a derived table counts as one more delivery. Without it, the folder is a new scratch one.
    """
    home = home or scratch(docs.sparkSession, "dedup")
    return _members(_addressable(docs, home), home, digest, files_per_trigger).select("doc_id", "keep_id", "group_size", "kept", "digest")


def distinct_documents(docs: DataFrame, home: str | None = None) -> DataFrame:
    """One row of docs of each group, all columns; docs has doc_id and text."""
    home = home or scratch(docs.sparkSession, "dedup")
    content = _addressable(docs, home)
    kept = _members(content, home, lambda text: F.sha2(text, 256), None).filter("first").select("file", "row")
    return content.join(kept.hint("shuffle_hash"), ["file", "row"], "left_semi").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op2_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
