"""Unique names within archives whose files arrive in batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Names(StatefulProcessor):
    """Per archive, the names that are taken and, for each name asked for, the number to try next."""

    def __init__(self, style: str, idle_ms: int):
        self.before, self.after = style.split("{}")
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("names", "kind string, name string", "n long")

    def _first_free(self, name: str) -> str:
        dot = name.rfind(".")
        stem, rest = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        asked = ("asked", name)
        n, found = self.state.getValue(asked)[0] if self.state.containsKey(asked) else 1, None
        while found is None or self.state.containsKey(("taken", found)):
            found = name if n == 1 else f"{stem}{self.before}{n}{self.after}{rest}"
            n += 1
        self.state.updateValue(asked, (n,))
        self.state.updateValue(("taken", found), (0,))
        return found

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        # A batch's rows of an archive, which the trigger bounds; what earlier batches took stays in the store.
        batch = pd.concat(list(rows)).sort_values("ord")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["modified"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame({"archive_id": key[0], "ord": batch["ord"], "name": [self._first_free(n) for n in batch["name"]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def unique_names(stream: DataFrame, style: str = "-{}", delay: str = "1 day", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """archive_id, ord and name of a stream (archive_id, ord, name, modified), names made unique within the archive.

    Files are named in the order in which their batches arrive and, within a batch, of ord:
    as one batch over all of them would, if ord follows arrival, and also after a restart.
    State is keyed by archive and name; an archive's is dropped idle_ms after its last file,
    by the watermark, which follows modified at the delay; later files than that are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = dict(stream.dtypes)
    rows = stream.select("archive_id", "ord", "name", "modified").withWatermark("modified", delay)
    return rows.groupBy("archive_id").transformWithStateInPandas(
        _Names(style, idle_ms), f"archive_id {kinds['archive_id']}, ord {kinds['ord']}, name string", "Append", "EventTime"
    )
