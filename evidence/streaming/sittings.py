"""Clock digits of a sitting read as they land: the state of the ordered scan outlives a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequential import resolve_clock

STATE = T.StructType([T.StructField("last", T.LongType()), T.StructField("day", T.IntegerType()), T.StructField("begun", T.BooleanType())])


class Clocks(StatefulProcessor):
    """Per sitting the last resolved time and its day; the rows of a batch are read in their order."""

    def __init__(self, key: list[str], pos: str, digits: str):
        self.key, self.pos, self.digits = key, pos, digits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if not parts:
            return
        f = pd.concat(parts).sort_values(self.pos, kind="stable")
        held = self.state.get() if self.state.exists() else None
        last, day = (held[0], held[1]) if held is not None and held[2] else (None, 0)
        at, last, day = resolve_clock([x if isinstance(x, str) else None for x in f[self.digits]], last=last, day=day)
        self.state.update((last if last is not None else 0, day, last is not None))
        yield f.assign(at=pd.array(at, dtype="Int64"))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State that processors keep needs the RocksDB store, and the coordinator that a session makes with its list of streams."""
    _ = spark.streams.active
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def clocks(rows: DataFrame, key: list[str], pos: str, digits: str) -> DataFrame:
    """Rows, streamed or not, with `at`, the resolved second of their sitting's first day.

    In a stream the rows of a sitting must land in order of pos, batch by batch; what was given for a row stays. Over the
    whole table at once the rows are those of `operators.sequential.ambiguous_clocks`.
    """
    use_state_store(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())])
    return rows.groupBy(*key).transformWithStateInPandas(Clocks(key, pos, digits), schema, "Append", "None")
