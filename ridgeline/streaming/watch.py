"""Logs as they grow, with timers: a path is read when it has been quiet for a while, and a gap does not wait for ever (STR-01, 02, 03).

Each path has a state of its own: the offset reached, what is behind the last prompt, how the log
begins, and, apart from these, the pieces beyond a gap, by offset. A piece takes its place in time that
does not depend on what is there already. Two timers run for a path: one is set anew by each piece
and gives out the complete blocks' text (debounce); the other is set when a gap opens and, should
it still be open then, leaves it out and goes on with the next piece. So a state is never larger
than one block and the pieces that came within the gap's time.

The session needs the state store that keeps single entries:
spark.sql.streaming.stateStore.providerClass = ...state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ridgeline.streaming.ingest import Log, plain


class Watcher(StatefulProcessor):
    """quiet, gap: milliseconds that a path is quiet before it is read, and that a gap may stay open."""

    def __init__(self, quiet: int, gap: int):
        self.quiet, self.gap = quiet, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "reached long, seq long, tail binary, head binary")
        self.waiting = handle.getMapState("waiting", "offset long", "data binary")
        self.timers = handle.getValueState("timers", "quiet long, gap long")

    def close(self) -> None:
        pass

    def _log(self) -> Log:
        return Log(*self.known.get()) if self.known.exists() else Log()

    def _keep(self, log: Log) -> None:
        self.known.update((log.reached, log.seq, log.tail, log.head))

    def _due(self) -> tuple[int, int]:
        """When the timers run out (0: not set)."""
        return tuple(self.timers.get()) if self.timers.exists() else (0, 0)

    def _set(self, quiet: int, gap: int) -> None:
        old = self._due()
        for t in set(old) - {quiet, gap, 0}:
            self.handle.deleteTimer(t)
        for t in {quiet, gap} - set(old) - {0}:
            self.handle.registerTimer(t)
        self.timers.update((quiet, gap))

    def _fold(self, log: Log) -> None:
        """Takes the pieces that have waited for what is there now."""
        ready = True
        while ready:
            ready = sorted(k[0] for k in self.waiting.keys() if k[0] <= log.reached)
            for k in ready:
                log.add(k, bytes(self.waiting.getValue((k,))[0]))
                self.waiting.removeKey((k,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log, now = self._log(), timerValues.getCurrentProcessingTimeInMs()
        for row in pd.concat(list(rows)).sort_values("offset").itertuples():
            data = bytes(row.data)
            if row.offset <= log.reached:
                log.add(row.offset, data, bool(row.whole))
            elif not self.waiting.containsKey((row.offset,)) or len(self.waiting.getValue((row.offset,))[0]) < len(data):
                self.waiting.updateValue((row.offset,), (data,))
        self._fold(log)
        self._keep(log)
        opened = any(True for _ in self.waiting.keys())
        self._set(now + self.quiet, (self._due()[1] or now + self.gap) if opened else 0)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        log, at = self._log(), expiredTimerInfo.getExpiryTimeInMs()
        quiet, gap = self._due()
        if gap and at >= gap:
            beyond = sorted(k[0] for k in self.waiting.keys())
            if beyond:
                log.skip(beyond[0])
                self._fold(log)
            gap = timerValues.getCurrentProcessingTimeInMs() + self.gap if any(True for _ in self.waiting.keys()) else 0
        seq, out = log.seq, log.complete()
        self._keep(log)
        self._set(0 if at >= quiet else quiet, gap)
        if out:
            yield pd.DataFrame({"path": [key[0]], "seq": [seq], "text": [out]})


def quiet_text(pieces: DataFrame, quiet: int = 500, gap: int = 60_000) -> DataFrame:
    """path, seq, text as complete_text() has them, of paths that have been quiet for so many milliseconds."""
    return plain(pieces).groupBy("path").transformWithStateInPandas(Watcher(quiet, gap), "path string, seq long, text string", "append", "processingTime")
