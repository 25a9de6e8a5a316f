"""The newest records of each inbox as bounded state: every message is recorded once, across restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Fixed value: how many records an inbox remembers.
MOST = 200
_RECORD = "inbox string, id string, created_at timestamp, status string, severity string"
#: Setting that the state of this module needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class NewestRecords(StatefulProcessor):
    """Keeps the ids of an inbox's newest ``most`` messages and passes on each message that isn't among them.

    State is an id and a time per message, never more than ``most`` an inbox after a micro-batch. A message older than all
    that are kept passes each time it comes; of equal times the greater id is newer.
    """

    def __init__(self, most: int = MOST) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "created_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            fresh = []
            for i, (ident, at) in enumerate(zip(frame["id"], frame["created_at"], strict=True)):
                if not self.seen.containsKey((ident,)):
                    self.seen.updateValue((ident,), (at,))
                    fresh.append(i)
            yield frame.iloc[fresh]
        kept = sorted(((value[0], ident[0]) for ident, value in self.seen.iterator()), reverse=True)
        for _, ident in kept[self.most :]:
            self.seen.removeKey((ident,))

    def close(self) -> None:
        pass


def new_records(records: DataFrame, most: int = MOST) -> DataFrame:
    """The records (``inbox, id, created_at, status, severity``) of a stream that their inbox doesn't remember yet.

    The session needs the RocksDB state store (``STATE_STORE``).
    """
    columns = [c.split()[0] for c in _RECORD.split(", ")]
    return records.select(*columns).groupBy("inbox").transformWithStateInPandas(NewestRecords(most), _RECORD, "Append", "None")


def start_inbox(records: DataFrame, path: str, checkpoint: str, most: int = MOST) -> StreamingQuery:
    """Append new records below ``path``, a folder per micro-batch."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return new_records(records, most).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()


def newest(records: DataFrame, most: int = MOST) -> DataFrame:
    """Stored records, newest first: the feature's limit is what a person looks at."""
    return records.orderBy(records["created_at"].desc(), records["id"].desc()).limit(most)
