"""Rows that a stream holds back: the pending level of a streaming index.

A stream of single inserts would make a folder of a few rows for each
micro-batch.  Here rows wait in the state store, dealt to buckets by their id,
until a bucket has enough of them or its oldest has waited long enough; then the
bucket's rows go on together.  The state also knows every id that ever came, so
an id that comes again is refused where it meets its bucket: nothing is joined
with the base.  What waits is read back from the checkpoint as a table.

State is kept by RocksDB on the executors' disks and in the checkpoint folder,
a row for each id and each waiting row; memory holds one bucket's waiting rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources import store

#: Column of rows that come out: true for those refused.
REFUSED = "__refused"
_BUCKET, _WAITING = "__bucket", "waiting"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bucket(StatefulProcessor):
    """Known ids and waiting rows of one bucket."""

    def __init__(self, schema: T.StructType, most: int, wait_ms: int):
        self.schema, self.most, self.wait_ms = schema, most, wait_ms
        self.names = schema.names
        self.row = Row(*self.names, REFUSED)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", T.StructType([T.StructField("id", self.schema["id"].dataType)]), "known boolean")
        self.waiting = handle.getListState(_WAITING, self.schema)
        self.count = handle.getValueState("count", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState if isinstance(initialState, (list, Iterator)) else [initialState]
        for row in rows:
            self.known.updateValue((row["id"],), (True,))

    def _released(self, new: list[tuple]) -> Iterator[Row]:
        """All that waits, and the new rows; nothing waits then."""
        rows = [*map(tuple, self.waiting.get()), *new] if self.count.exists() else new
        self.waiting.clear()
        self.count.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        return (self.row(*row, False) for row in rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.count.get()[0] if self.count.exists() else 0
        new: list[tuple] = []
        for row in rows:
            values = tuple(row[c] for c in self.names)
            if row["id"] is None or self.known.containsKey((row["id"],)):
                yield self.row(*values, True)
                continue
            self.known.updateValue((row["id"],), (True,))
            new.append(values)
            if before + len(new) >= self.most:
                yield from self._released(new)
                before, new = 0, []
        if new:
            self.waiting.appendList(new)
            self.count.update((before + len(new),))
            if not before:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._released([])

    def close(self) -> None:
        pass


def held(stream: DataFrame, known: DataFrame, most: int, wait_ms: int, buckets: int) -> DataFrame:
    """The rows of a stream (id and more), held back; with ``REFUSED``.

    known: ids that are refused from the start, read by the first batch only.
    most: rows that wait in all buckets together, about; wait_ms: how long the
    oldest row of a bucket waits.  Rows without id are refused.  Of rows of one
    id in one batch any one is taken.
    """
    dealt = lambda rows: rows.withColumn(_BUCKET, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema])
    first = dealt(known.select(F.col("id").cast(schema["id"].dataType).alias("id")).distinct()).groupBy(_BUCKET)
    processor = _Bucket(schema, max(1, -(-most // buckets)), wait_ms)
    return dealt(stream).groupBy(_BUCKET).transformWithState(processor, T.StructType([*schema.fields, T.StructField(REFUSED, T.BooleanType())]), "Append", "ProcessingTime", first)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state by RocksDB; the session's own setting stays."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def committed(spark: SparkSession, checkpoint: str) -> int:
    """The last batch of a stream that is done; -1 before the first."""
    return max((int(n) for n in store.names(spark, f"{checkpoint}/commits") if n.isdigit()), default=-1)


def waiting(spark: SparkSession, checkpoint: str, batch: int) -> DataFrame | None:
    """The rows that waited after a batch, read from the state in the checkpoint."""
    if batch < 0:
        return None
    operators = spark.read.format("state-metadata").load(checkpoint).where("operatorName LIKE 'transformWithState%'")
    operator = operators.agg(F.max("operatorId")).first()[0]
    state = spark.read.format("statestore").option("operatorId", operator).option("batchId", batch).option("stateVarName", _WAITING)
    return state.load(checkpoint).select("list_element.*")
