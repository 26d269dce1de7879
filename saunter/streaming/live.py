"""Streams: a running summary of trial files as they land, and first passage over a stream of steps."""

from __future__ import annotations

import math
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from saunter.functions.exprs import clean
from saunter.sources.schema import schema

PASSAGE = "trial_id long, walker_id long, step int, touch_no int, time double"
FIELDS = ("step", "l", "theta", "phi", "x0", "y0", "z0", "u")
#: State variables can be several per key only in this store, which keeps them on disk.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trial_stream(spark: SparkSession, path: str, variant: str = "surface", files_per_trigger: int = 1000) -> DataFrame:
    """Trial files of a folder as they land. A file must land whole: what is appended to one already read isn't seen."""
    return spark.readStream.schema(schema(variant)).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def live_summary(trials: DataFrame, keys, value: str = "detection_time") -> DataFrame:
    """n, mean, std and sem per group so far; state is a few numbers a group (no medians)."""
    v = clean(F.col(value).cast("double"))
    out = trials.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    out = out.withColumn("std", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("std")))
    return out.withColumn("sem", F.try_divide(F.col("std"), F.sqrt(F.col("n").cast("double"))))


class Passage(StatefulProcessor):
    """The walk of one walker up to the touch that ends its search.

    State: ``at`` (next step, displacement, path length, touches, and when its timer is due), ``early`` (steps by number that
    came before their turn: entries of the store, read one at a time) and ``ended``, a mark that is all that is left of a
    walker which has finished or timed out, for ``forget_ms``.
    """

    def __init__(self, centre, radius: float, side: float, max_touches: int, p: float, timeout_ms: int | None, forget_ms: int | None):
        self.centre, self.radius, self.side, self.max_touches, self.p = tuple(centre), radius, side, max_touches, p
        self.timeout_ms, self.forget_ms = timeout_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next int, x double, y double, z double, time double, touches int, due long")
        self.early = handle.getMapState("early", "step int", ", ".join(f"{f} double" for f in FIELDS[1:]))
        self.ended = handle.getValueState("ended", "ended boolean", self.forget_ms if self.timeout_ms is not None else None)

    def _touch(self, *position: float) -> bool:
        d2 = 0.0
        for a, b in zip(position, self.centre):
            d = abs(math.fmod(math.fmod(a, self.side) + self.side, self.side) - b)
            d2 += min(d, self.side - d) ** 2
        return d2 <= self.radius * self.radius

    def _walked(self, row):
        """Takes the next step; what is found, if it ends the search."""
        l, theta, phi, x0, y0, z0, u = row
        self.time, self.next = self.time + l, self.next + 1
        self.x, self.y, self.z = self.x + l * math.sin(phi) * math.cos(theta), self.y + l * math.sin(phi) * math.sin(theta), self.z + l * math.cos(phi)
        if not self._touch(x0 + self.x, y0 + self.y, z0 + self.z):
            return None
        self.touches += 1
        return (self.next - 1, self.touches, self.time) if self.touches >= max(1, self.max_touches) or u <= self.p else None

    def _end(self) -> None:
        self.at.clear()
        self.early.clear()
        self.ended.update((True,))

    def handleInputRows(self, key, rows, timerValues):
        if self.ended.exists():
            for _ in rows:  # what comes after the end
                pass
            return
        known = self.at.exists()
        self.next, self.x, self.y, self.z, self.time, self.touches, due = self.at.get() if known else (1, 0.0, 0.0, 0.0, 0.0, 0, None)
        found, waits = None, known and self.early.exists()
        for batch in rows:
            if found:
                continue
            for step, *row in batch[list(FIELDS)].sort_values("step").itertuples(index=False):
                if step > self.next:
                    self.early.updateValue((int(step),), tuple(map(float, row)))
                    waits = True
                elif step == self.next and not found:
                    found = self._walked(map(float, row))
            while waits and not found and self.early.containsKey((self.next,)):
                turn = (self.next,)
                found = self._walked(self.early.getValue(turn))
                self.early.removeKey(turn)
        if due is not None:
            self.handle.deleteTimer(due)
        if found:
            self._end()
            yield pd.DataFrame([(*key, *found)], columns=["trial_id", "walker_id", "step", "touch_no", "time"])
            return
        due = None
        if self.timeout_ms is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(due)
        self.at.update((self.next, self.x, self.y, self.z, self.time, self.touches, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._end()
        yield pd.DataFrame(columns=["trial_id", "walker_id", "step", "touch_no", "time"]).astype({"trial_id": "int64", "walker_id": "int64", "step": "int32", "touch_no": "int32", "time": "float64"})

    def close(self) -> None:
        pass


def first_passage_stream(steps: DataFrame, centre, radius: float, side: float, max_touches: int, p: float, timeout_ms: int | None = 600_000, forget_ms: int = 86_400_000) -> DataFrame:
    """Per walker the touch that ends its search, as soon as it is known. Same columns and rules as in batch.

    Steps come in any order: those whose turn it is are taken as they come, others wait in the state store, not in a task's
    memory. A step number that comes again is ignored once it was taken. A walker that finishes, or sends nothing for
    ``timeout_ms``, leaves one mark, which goes after ``forget_ms``: until then it doesn't begin again, whatever
    comes. Without a timeout (None: for streams that are drained and end) marks stay.
    Start it inside `state_store`.
    """
    walk = Passage(centre, radius, side, max_touches, p, timeout_ms, forget_ms)
    return steps.groupBy("trial_id", "walker_id").transformWithStateInPandas(walk, PASSAGE, "Append", "None" if timeout_ms is None else "ProcessingTime")


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in the store that first passage needs."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drains what is there now into a memory table and returns it: for reports and tests of bounded size."""
    with state_store(stream.sparkSession):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains what is there now into Parquet below ``path`` and returns it: no row passes the driver, however many there are."""
    with state_store(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_trials(stream: DataFrame, path: str, checkpoint: str):
    """Writes a trial stream to Parquet, each batch durable when it is done. A file is told by its path: `append_files` tells it by its content."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Folder of one file's rows in a table of `append_files`, and the column that tells it.
FILE = "file_digest"


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """The digests that a table of `append_files` holds, by the names of its folders; no file is opened."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{FILE} string")
    return files.select(F.regexp_extract("path", f"{FILE}=([0-9a-f]+)/", 1).alias(FILE)).distinct()


def append_files(spark: SparkSession, folder: str, path: str, checkpoint: str, variant: str = "surface", files_per_trigger: int = 1000):
    """Trial files of a folder, appended to the Parquet table ``path``; a content counts once.

    Rows lie in a folder per file content (a digest of its bytes), which is moved to its place whole. So a file that comes
    twice, under another name or in a batch that is run again after a failure, leaves what is there: its bytes are read for
    their digest, not its rows. Files must land whole. `compact` makes fewer files of them.
    """
    kinds = "path string, modificationTime timestamp, length long, content binary"
    text = spark.readStream.format("binaryFile").schema(kinds).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        own_files = batch.select("path", F.sha2("content", 256).alias(FILE)).groupBy(FILE).agg(F.min("path").alias("path"))
        new_files = own_files.join(_contents(own, path), FILE, "left_anti")  # files_per_trigger rows at most
        lines = batch.join(F.broadcast(new_files), "path").select(FILE, F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line", "value"))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema(variant).fields)
        rows = lines.where("line > 0 and value <> ''").select(F.from_csv("value", ddl).alias("r"), FILE).select("r.*", FILE)
        before = own.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            # A file's rows are in the task that read it: its folder is written there.
            rows.write.mode("overwrite").partitionBy(FILE).parquet(path)
        finally:
            own.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    return text.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str, to: str, rows_per_file: int = 1_000_000) -> None:
    """The rows of an appended table once more under ``to``, in files of up to so many rows; the column `FILE` stays, so a content is still known."""
    spark.read.parquet(path).sortWithinPartitions(FILE).coalesce(max(1, spark.sparkContext.defaultParallelism)).write.option("maxRecordsPerFile", rows_per_file).parquet(to)
