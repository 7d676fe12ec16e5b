"""Attempts counted as they come: per id how many there were, and whether it is accepted, abandoned or to be made again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """Keeps (attempts, accepted) of an id, and gives its state after every batch in which it occurs."""

    def __init__(self, key: str, accepted: str, most: int):
        self.key, self.accepted, self.most = key, accepted, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType()), StructField("ok", IntegerType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        n, ok = self.seen.get() if self.seen.exists() else (0, 0)
        for own in rows:
            n, ok = n + len(own), max(ok, int(own[self.accepted].fillna(False).astype(bool).any()))
        self.seen.update((n, ok))
        state = "accepted" if ok else "abandoned" if n >= self.most else "regenerate"
        yield pd.DataFrame({self.key: [key[0]], "n_attempts": [n], "state": [state]})

    def close(self) -> None:
        pass


def attempt_states(attempts: DataFrame, key: str, accepted: str, most: int) -> DataFrame:
    """(key, n_attempts, state) of a stream of attempts, for update mode: an id's state anew whenever attempts of it arrive.

    State is one small row per id in the executors' RocksDB stores and the checkpoint, so a stream goes on where it stopped. A
    null in `accepted` isn't an acceptance; rows without a key take no part.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = StructType([StructField(key, attempts.schema[key].dataType), StructField("n_attempts", LongType()), StructField("state", StringType())])
    known = attempts.where(attempts[key].isNotNull()).select(key, accepted)
    return known.groupBy(key).transformWithStateInPandas(Attempts(key, accepted, most), outputStructType=out, outputMode="Update", timeMode="None")
