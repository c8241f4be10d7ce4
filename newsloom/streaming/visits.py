"""The visit ledger as a stream.

``ledger_entries`` keeps, for each visitor, the days that have an entry, seeded from the stored ledger,
each forgotten when its time to live is over: the stream appends just what a batch of the same visits
would. ``first_entries`` needs no seed and less state, but forgets a day with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from newsloom.operators.visits import RETENTION_DAYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfDay(StatefulProcessor):
    """One map for each visitor: the day, and when its entry was."""

    def __init__(self, days: int, columns: list[str]):
        self.days, self.columns = days, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entered = handle.getMapState("entered", "visit_day date", "visited_at timestamp", self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        firsts: dict = {}
        for row in rows:
            held = firsts.get(row.visit_day)
            if held is None or (row.visited_at, row.id) < (held.visited_at, held.id):
                firsts[row.visit_day] = row
        for day in sorted(firsts):
            if not self.entered.containsKey((day,)):
                self.entered.updateValue((day,), (firsts[day].visited_at,))
                yield Row(**{c: firsts[day][c] for c in self.columns})

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.entered.updateValue((initialState.visit_day,), (initialState.visited_at,))

    def close(self) -> None:
        pass


def ledger_entries(stream: DataFrame, ledger: DataFrame | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """The first entry of each visitor and day that the ``ledger`` has not; of one batch's the earliest, ties by id.

    ``stream`` has id, visitor_key and visited_at; rows without any of these are no visits. Each visitor's days are
    kept for ``days`` after they were written. State is in RocksDB, which the session must name as its provider.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = stream.where("id IS NOT NULL AND visitor_key IS NOT NULL AND visited_at IS NOT NULL").withColumn("visit_day", F.to_date("visited_at"))
    schema = StructType(rows.schema.fields)
    seed = None if ledger is None else ledger.select("visitor_key", "visit_day", F.col("visited_at").cast("timestamp").alias("visited_at")).groupBy("visitor_key")
    return rows.groupBy("visitor_key").transformWithState(FirstOfDay(days, rows.columns), schema, "Append", "ProcessingTime", seed)


def first_entries(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first entry to arrive for each visitor and day, as long as the watermark remembers it; later ones are dropped."""
    days = stream.withColumn("visit_day", F.to_date("visited_at"))
    return days.withWatermark("visited_at", delay).dropDuplicatesWithinWatermark(["visitor_key", "visit_day"])


def write_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet files, restartable from the checkpoint; runs until what is there is read.

    Batches without data are off for it: state with a time to live would ask for another one for ever."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
