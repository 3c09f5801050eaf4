"""Streaming queries: the batch operators inside ``foreachBatch``.

Readings may be of any age, so nothing here drops late rows behind a watermark.
Sinks are written under ``batch_id=``: a batch that is retried after a failure
replaces its own output and does not count against itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalgrid.operators import access, alerts, fanout, meds, series
from vitalgrid.sources import readings as source

Table = Callable[[], DataFrame]
"""Read a table anew; permissions, subscriptions and thresholds must be live in every batch."""


def message_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Messages as JSON lines (seq, message). A topic source gives the same columns."""
    return (
        spark.readStream.schema("seq bigint, message string")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def topic_stream(spark: SparkSession, servers: str, topic: str = "health_metrics") -> DataFrame:
    """The topic form; needs the connector on the class path. Offsets order rows within a partition."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("offset").alias("seq"), F.col("value").cast("string").alias("message"))


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, live: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if live else writer.trigger(availableNow=True)).start()


@contextmanager
def _read_once(batch: DataFrame) -> Iterator[DataFrame]:
    """A batch that several branches use: read and decoded once."""
    batch = batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def _batch_path(folder: str, batch_id: int) -> str:
    return f"{folder}/batch_id={batch_id}"


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all batches of a sink, empty when there is none yet."""
    try:
        return spark.read.schema(schema + ", batch_id bigint").option("basePath", folder).parquet(folder)
    except Exception as e:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", batch_id bigint")


STORED = "seq bigint, user_id string, value double, time timestamp, metric_type string, date date, slice int"


def stored_readings(spark: SparkSession, folder: str) -> DataFrame:
    return read_batches(spark, folder, STORED).drop("slice")


def ingest_batch(batch: DataFrame, batch_id: int, store: str, bad: str, metric_types: Table, users: Table) -> None:
    """Decode, validate and store one batch; the first reading of a key stays, across batches too."""
    spark = batch.sparkSession
    decoded = source.ingest_readings(batch, metric_types(), users()).persist()
    try:
        before = stored_readings(spark, store).filter(F.col("batch_id") != batch_id)
        fresh = source.new_readings(source.good_rows(decoded).drop("message"), before)
        source.store_readings(fresh, _batch_path(store, batch_id), mode="overwrite")
        source.quarantine(decoded).write.mode("overwrite").parquet(_batch_path(bad, batch_id))
    finally:
        decoded.unpersist()


def stream_ingest(
    messages: DataFrame, store: str, bad: str, metric_types: Table, users: Table, checkpoint: str, live: bool = False
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, bad, metric_types, users)

    return _start(messages, write, checkpoint, live)


def stream_alerts(
    readings: DataFrame, tables: dict[str, Table], out: str, checkpoint: str, live: bool = False
) -> StreamingQuery:
    """Alert messages per arriving reading; repeats are not suppressed.

    ``tables``: metric_types, thresholds, permissions, members, users, groups.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        t = {name: read() for name, read in tables.items()}
        with _read_once(batch) as batch:
            alert(batch, batch_id, t)

    def alert(batch: DataFrame, batch_id: int, t: dict[str, DataFrame]) -> None:
        bounds = alerts.thresholds_for(batch.select("user_id", "metric_type"), t["metric_types"], t["thresholds"])
        found = alerts.threshold_breaches(batch, bounds)
        pairs = found.select(F.col("user_id").alias("owner_id"), "metric_type")
        watchers = access.metric_watchers(pairs, t["permissions"], t["members"], t["users"], t["groups"])
        alerts.alert_fanout(found, watchers, t["users"]).write.mode("overwrite").parquet(_batch_path(out, batch_id))

    return _start(readings, write, checkpoint, live)


FAN = 8
DELTAS = "user_id bigint, metric_type string, bucket_time timestamp, total double, n bigint, bucket string"


def live_folders(n: int, fan: int = FAN) -> list[str]:
    """Folders that together hold the first ``n`` batches: at most ``fan - 1`` of every level.

    A folder of level k covers ``fan ** k`` batches and is named by the last of
    them, so the list follows from the number of batches alone.
    """
    out, level, width = [], 0, 1
    while n >= width:
        top = n // width
        out += [f"level={level}/upto={at * width}" for at in range(top - top % fan + 1, top + 1)]
        level, width = level + 1, width * fan
    return out


def _is_done(spark: SparkSession, rollup: str, n: int) -> bool:
    """Whether ``n`` batches are complete: the mark of a batch is written after its folders."""
    try:
        return not spark.read.schema("id bigint").parquet(f"{rollup}/done/upto={n}").isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def batches_done(spark: SparkSession, rollup: str) -> int:
    """Number of complete batches, by doubling and halving over the marks: their folder is never listed."""
    high = 1
    while _is_done(spark, rollup, high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _is_done(spark, rollup, middle) else (low, middle)
    return low


def _live(spark: SparkSession, root: str, schema: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{folder}" for folder in folders]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def _add_batch(
    delta: DataFrame, n: int, root: str, schema: str, merge: Callable[[DataFrame], DataFrame], fan: int, parts: tuple[str, ...] = ()
) -> None:
    """Store the rows of the ``n``-th batch, fold full levels into the next one, then mark the batch as complete.

    Every row is rewritten once per level. Folders in use are never written
    again: a batch that failed before its mark replaces only folders nobody
    reads yet, and callers leave one alone that is retried after it.
    """
    spark = delta.sparkSession
    write = lambda df, folder: df.write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/{folder}")
    write(delta, f"level=0/upto={n}")
    level, width = 1, fan
    while n % width == 0:
        full = [f"level={level - 1}/upto={n - i * (width // fan)}" for i in range(fan)]
        write(merge(_live(spark, root, schema, full)), f"level={level}/upto={n}")
        level, width = level + 1, width * fan
    spark.range(0, 1, 1, 1).write.mode("overwrite").parquet(f"{root}/done/upto={n}")


def _summed(deltas: DataFrame) -> DataFrame:
    """Deltas added up per bucket."""
    return deltas.groupBy("user_id", "metric_type", "bucket", "bucket_time").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )


def chart_batch(batch: DataFrame, batch_id: int, rollup: str, fan: int = FAN) -> None:
    if not _is_done(batch.sparkSession, rollup, batch_id + 1):
        _add_batch(series.rollup_deltas(batch), batch_id + 1, rollup, DELTAS, _summed, fan, ("bucket",))


def stream_chart(
    readings: DataFrame, rollup: str, checkpoint: str, live: bool = False, fan: int = FAN
) -> StreamingQuery:
    """(sum, count) deltas per bucket and batch, compacted as they come; ``read_chart`` adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chart_batch(batch, batch_id, rollup, fan)

    return _start(readings, write, checkpoint, live)


def read_chart(spark: SparkSession, rollup: str, metric_types: DataFrame, fan: int = FAN) -> DataFrame:
    """Current chart values: the folders of the complete batches, logarithmic in their number, added up."""
    folders = live_folders(batches_done(spark, rollup), fan)
    return series.read_rollup(_summed(_live(spark, rollup, DELTAS, folders)), metric_types)


MARKS = "share_id bigint, reminder_id bigint, today date, batch bigint"


def _last_marks(marks: DataFrame) -> DataFrame:
    """One mark per share: that of the latest batch, and there the highest reminder."""
    order = F.struct("batch", "reminder_id")
    return marks.groupBy("share_id").agg(F.max_by(F.struct("reminder_id", "today", "batch"), order).alias("m")).select("share_id", "m.*")


def missed_batch(ticks: DataFrame, batch_id: int, tables: dict[str, Table], marks: str, out: str, fan: int = FAN) -> None:
    """Missed reminders of one tick; the marks of all batches before it decide, and its own decide the next ones.

    A batch of several ticks counts as its last one, as for a scheduler that was
    away. Marks are kept as versions: those before this batch are the folders of
    ``batch_id`` batches, also when the batch is tried again.
    """
    spark = ticks.sparkSession
    if _is_done(spark, marks, batch_id + 1):
        return
    now = ticks.agg(F.max("tick").cast("string")).first()[0]
    t = {name: read() for name, read in tables.items()}
    before = _last_marks(_live(spark, marks, MARKS, live_folders(batch_id, fan)))
    shares = meds.missed_state(t["shares"], before)
    sent = meds.missed_reminders(shares, t["medications"], t["reminders"], t["users"], now)
    sent.write.mode("overwrite").parquet(_batch_path(out, batch_id))
    told = spark.read.schema(sent.schema).parquet(_batch_path(out, batch_id))
    delta = _last_marks(told.select("share_id", "reminder_id", "today", F.lit(batch_id).cast("bigint").alias("batch")))
    _add_batch(delta, batch_id + 1, marks, MARKS, _last_marks, fan)


def stream_missed(
    ticks: DataFrame, tables: dict[str, Table], marks: str, out: str, checkpoint: str, live: bool = False, fan: int = FAN
) -> StreamingQuery:
    """Missed reminders per arriving tick, each share told once per reminder and day while its mark stands.

    ``tables``: shares, medications, reminders, users, read anew in every batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        missed_batch(batch, batch_id, tables, marks, out, fan)

    return _start(ticks, write, checkpoint, live)


def stream_publish(readings: DataFrame, out: str, checkpoint: str, live: bool = False) -> StreamingQuery:
    """Published messages (key, value) as files, through the engine's file sink.

    Its commit log names the files of every batch, so readers of the folder see
    each reading exactly once, also after a batch that was stopped half way.
    """
    writer = (
        source.publish_readings(readings).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(processingTime="10 seconds") if live else writer.trigger(availableNow=True)).start()


def stream_broadcast(
    readings: DataFrame, tables: dict[str, Table], out: str, checkpoint: str, live: bool = False
) -> StreamingQuery:
    """Deliveries per arriving reading under the subscriptions and permissions of the moment.

    ``tables``: subscriptions, permissions, members, groups.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        t = {name: read() for name, read in tables.items()}
        with _read_once(batch) as batch:
            deliver(batch, batch_id, t)

    def deliver(batch: DataFrame, batch_id: int, t: dict[str, DataFrame]) -> None:
        subs = t["subscriptions"]
        asked = batch.select(F.col("user_id").alias("owner_id"), "metric_type").distinct()
        # only pairs somebody listens to need their rights looked up
        heard = asked.join(
            subs.select(F.col("target_user_id").alias("owner_id"), "metric_type").distinct(), ["owner_id", "metric_type"], "left_semi"
        )
        rights = access.stream_watchers(heard, t["permissions"], t["members"], t["groups"])
        fanout.broadcast_fanout(batch, subs, rights).write.mode("overwrite").parquet(_batch_path(out, batch_id))

    return _start(readings, write, checkpoint, live)
