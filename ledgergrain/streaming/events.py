"""Structured Streaming over run events: landing in order of arrival, replay removal, readers that go on, live state.

Table and checkpoint folder are parameters: a job that is started again with the same two goes on where it stopped.
Below the table lie ``events`` and ``heads`` by job and batch, and ``landed`` with a mark for each finished batch. A job is
known by its checkpoint, so a lost checkpoint starts the table anew and never mixes two numberings. A batch's rows are
staged, then moved to their place in one step, so a reader or a second job sees whole batches, and a batch that is
repeated after a failure keeps what it has landed.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.functions.sequence import grouped_sequence
from ledgergrain.operators.run_events import agent_status, tool_entries, tool_figures, tool_pairs
from ledgergrain.sources.adapters import shape_run_events

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(
    spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of the event files that match a pattern in a folder."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_event_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The stream in run-event shape."""
    return shape_run_events(read_events(spark, folder, **options))


def _run(stream: DataFrame, write, checkpoint: str, mode: str) -> None:
    """Process all available input, batch by batch, then stop."""
    with _rocksdb(stream.sparkSession):
        job = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
        running = job.trigger(availableNow=True).start()
    running.awaitTermination()


@contextmanager
def _rocksdb(spark: SparkSession):
    """State of jobs that start here lies on local disk, with changes in the checkpoint, not on the heap.

    A batch uploads what it changed; whole states go up now and then, in the background. Rows aren't counted, which
    would read each key once more.
    """
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}.rocksdb.trackTotalNumberOfRows": "false",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Every so many batches the heads of all runs are written, else only those of the batch's runs.
SNAPSHOT = 32


@dataclass(frozen=True)
class Landing:
    """A landed table: its rows with ``seq`` (the arrival number in the run, from 1, without gaps) and ``batch_id``."""

    spark: SparkSession
    schema: T.StructType
    table: str
    run: str = "run_id"

    def _read(self, schema: T.StructType | str, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _marks(self) -> DataFrame:
        return self._read("job string, batch_id long, at timestamp", f"{self.table}/landed")

    def last(self) -> tuple[str | None, int]:
        """The job that landed last and its last finished batch; -1 if there is none."""
        newest = self._marks().groupBy("job").agg(F.max("at").alias("at"), F.max("batch_id").alias("b"))
        row = newest.orderBy(F.desc("at")).first()
        return (row.job, row.b) if row else (None, -1)

    def events(self, after: int = -1) -> DataFrame:
        """All finished batches behind ``after``; others are not read."""
        job, last = self.last()
        fields = [*self.schema.fields, *(T.StructField(n, T.LongType()) for n in ("seq", "batch_id"))]
        rows = self._read(T.StructType(fields), f"{self.table}/events/job={job}")
        return rows.where((F.col("batch_id") > after) & (F.col("batch_id") <= last))

    def heads(self, job: str, before: int) -> DataFrame:
        """The last arrival number of every run in the batches before one."""
        fields = [self.schema[self.run], *(T.StructField(n, T.LongType()) for n in ("seq", "batch_id"))]
        rows = self._read(T.StructType(fields), f"{self.table}/heads/job={job}")
        since = (before - 1) // SNAPSHOT * SNAPSHOT
        rows = rows.where((F.col("batch_id") >= since) & (F.col("batch_id") < before))
        return rows.groupBy(self.run).agg(F.max("seq").alias("_head"))

    def land(self, batch: DataFrame, number: int, job: str, order: list[Column]) -> None:
        """Number a batch's rows behind those of earlier batches and publish them.

        The batch is stored first: numbering reads it more than once, and each reading would go through its state.
        """
        place = f"job={job}/batch_id={number}"
        came = f"{self.table}/_staged/{uuid.uuid4().hex}"
        batch.write.parquet(came)
        batch = self._read(batch.schema, came)
        numbered = grouped_sequence(batch, [self.run], order, "_number")
        heads = self.heads(job, number)
        same = numbered[self.run].eqNullSafe(heads[self.run])
        seq = (F.coalesce("_head", F.lit(0)) + F.col("_number")).alias("seq")
        rows = numbered.join(heads, same, "left").select(*[numbered[c] for c in batch.columns], seq)
        staged = f"{self.table}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        _publish(self.spark, staged, f"{self.table}/events/{place}")
        own = T.StructType([self.schema[self.run], T.StructField("seq", T.LongType())])
        changed = self._read(own, f"{self.table}/events/{place}")
        changed = changed.groupBy(self.run).agg(F.max("seq").alias("seq"))
        if number % SNAPSHOT == 0:
            every = changed.unionByName(heads.withColumnRenamed("_head", "seq"))
            changed = every.groupBy(self.run).agg(F.max("seq").alias("seq"))
        changed.write.mode("overwrite").parquet(f"{self.table}/heads/{place}")
        mark = self.spark.range(1).select(
            F.lit(job).alias("job"), F.lit(number).cast("long").alias("batch_id"),
            F.lit(datetime.now(timezone.utc)).alias("at"),
        )
        mark.coalesce(1).write.mode("append").parquet(f"{self.table}/landed")


def _publish(spark: SparkSession, staged: str, place: str) -> None:
    """Move a folder to its place in one step; one that is there already, from a try that got so far, stays."""
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, place))
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(target):
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"could not publish {place}")


def _job_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its job for life."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def _arrival(columns: list[str], time: str, key: str) -> list[Column]:
    """Order inside a batch: by time and key; what is equal in both, or has none, by its values."""
    first = [F.col(c).asc_nulls_first() for c in (time, key) if c in columns]
    return [*first, F.xxhash64(*columns)]


def append_table(
    stream: DataFrame, table: str, checkpoint: str, time: str = "ts", run: str = "run_id", key: str = "event_id"
) -> DataFrame:
    """Land all available events and return the table with ``seq`` and ``batch_id``; copies are events of their own."""
    landing = Landing(stream.sparkSession, stream.schema, table, run)
    order = _arrival(stream.columns, time, key)

    def write(batch: DataFrame, number: int) -> None:
        job = _job_of(landing.spark, checkpoint)
        if landing.last() != (job, number):
            landing.land(batch, number, job, order)

    _run(stream, write, checkpoint, "append")
    return landing.events()


def append_unique(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    key: str = "event_id",
    time: str = "ts",
    run: str = "run_id",
    lifetime: str | None = None,
) -> DataFrame:
    """Land the events that haven't come before, however late they or their copies are, and return the table.

    An event is known by its key; of copies the first one to arrive stays (within a batch, any). Events without a key
    all stay. The keys are state of the stream, so a batch costs its own rows whatever the table's age. They are kept
    for good, or for ``lifetime`` after their arrival (like ``"30 days"``): a copy that comes later still is landed
    again. Arrival is what counts there, not the event's own time, so no event is too late to be landed.
    """
    keyed, without = stream.where(F.col(key).isNotNull()), stream.where(F.col(key).isNull())
    if lifetime is None:
        unique = keyed.dropDuplicates([key])
    else:
        arrived = keyed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", lifetime)
        unique = arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")
    return append_table(unique.select(stream.columns).union(without), table, checkpoint, time, run, key)


def events_from(landed: DataFrame, positions: DataFrame, run: str = "run_id") -> DataFrame:
    """A reader that goes on: the landed events of every run behind the last ``seq`` that the reader has had.

    Numbers follow arrival, so an event that comes late, with an early time, is delivered like any other. Runs without a
    position are read from the start of ``landed``. A reader of all runs gives ``Landing.events`` the last batch that it
    has read to the end, and older batches are not opened.
    """
    last = positions.groupBy(F.col(run).alias("_run")).agg(F.max("seq").alias("_last"))
    joined = landed.join(last, F.col(run).eqNullSafe(F.col("_run")), "left")
    return joined.where(F.col("seq") > F.coalesce("_last", F.lit(0))).select(*landed.columns)


def positions_of(read: DataFrame, run: str = "run_id") -> DataFrame:
    """Where a reader stands after these events: the last ``seq`` of each run."""
    return read.groupBy(run).agg(F.max("seq").alias("seq"))


def live_table(state: DataFrame, keys: list[str], table: str, checkpoint: str) -> DataFrame:
    """Run an update-mode aggregation to the end of its input and return the current row of every key.

    Each batch writes the rows that it changed; the newest batch of a key has its current row.
    """
    spark, schema = state.sparkSession, state.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    _run(state, write, checkpoint, "update")
    fields = [*schema.fields, T.StructField("batch_id", T.LongType())]
    changes = spark.read.schema(T.StructType(fields)).parquet(table)
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch_id").alias("row"))
    return newest.select("row.*")


#: What a reader of landed events takes at once. State tasks cost time per batch, so batches follow bytes, not files.
BYTES = 8 << 30


def landed_stream(landing: Landing, files_per_trigger: int | None = None) -> DataFrame:
    """The events that a job has landed as a stream; batches appear whole."""
    fields = [*landing.schema.fields, T.StructField("seq", T.LongType())]
    reader = landing.spark.readStream.schema(T.StructType(fields)).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", BYTES)
    return reader.parquet(f"{landing.table}/events/job={landing.last()[0]}")


def live_agent_status(events: DataFrame) -> DataFrame:
    """Update-mode frame: the current status per run and agent; one state row for each, as long as the job lives."""
    return agent_status(events)


def live_tool_pairs(events: DataFrame) -> DataFrame:
    """Update-mode frame: the tool entries per run, agent and call; one state row for each, as long as the job lives."""
    return tool_pairs(events)


def closing_tool_pairs(events: DataFrame, bound: str, late: str, time: str = "ts") -> DataFrame:
    """Append-mode frame: the tool entries of each call, given out once no event of it came for ``bound``.

    State ends: a call's row is dropped when it is given out, as soon as the newest event is ``late`` past the bound.
    A completion that comes after its call was closed is listed on its own, as completed without start. Events
    more than ``late`` behind the newest one are past the job's memory and not counted; choose it with the feed in mind.
    """
    tools = events.where(F.col("type").isin("tool_started", "tool_completed"))
    timed = tools.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    span = F.session_window("_at", bound)
    grouped = timed.groupBy(span, "run_id", "agent_id", "tool_call_id").agg(*tool_figures())
    closed = tool_entries(grouped, F.col("session_window.start").cast("timestamp_ntz").alias("opened"))
    return closed


def append_closed(closed: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Run an append-mode frame to the end of its input and return what it has given out so far."""
    with _rocksdb(closed.sparkSession):
        job = closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        running = job.trigger(availableNow=True).start(table)
    running.awaitTermination()
    return closed.sparkSession.read.schema(closed.schema).parquet(table)
