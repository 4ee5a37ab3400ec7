"""A poll loop over a stream that ends between batches: once, or again and again until it is told to drain."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class _Drained(RuntimeError):
    """A batch was not begun, since the loop is to end."""


class _Progress(StreamingQueryListener):
    def __init__(self, loop: PollLoop) -> None:
        self.loop = loop

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.loop.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class PollLoop:
    """Hands batches of ``source`` to ``handle(batch, number)``; the checkpoint remembers which are done.

    ``run(once=True)`` takes what is there and ends. ``run()`` looks again every ``poll_seconds``. After ``drain()``, from any
    thread, the batch that is being handled is brought to its end and committed, none is begun, and ``run`` returns; the next
    run goes on with the batch after it. ``handle`` may see a batch again, under the same number, only if the process died in it.
    """

    def __init__(self, source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, poll_seconds: float = 5.0) -> None:
        self.source, self.handle, self.checkpoint, self.poll_seconds = source, handle, checkpoint, poll_seconds
        #: (number, rows) of the batches that ended, as the listener heard of them.
        self.batches: list[tuple[int, int]] = []
        self._stop = threading.Event()

    def drain(self) -> None:
        self._stop.set()

    def _batch(self, batch: DataFrame, number: int) -> None:
        if self._stop.is_set():
            raise _Drained
        self.handle(batch, number)

    def _start(self) -> StreamingQuery:
        return self.source.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def run(self, once: bool = False) -> None:
        spark = self.source.sparkSession
        listener = _Progress(self)
        spark.streams.addListener(listener)
        try:
            while not self._stop.is_set():
                query = self._start()
                try:
                    query.awaitTermination()
                except Exception:
                    # The batch that was refused is not committed; it is the first of the next run.
                    if not self._stop.is_set() or _Drained.__name__ not in str(query.exception()):
                        raise
                if once or self._stop.wait(self.poll_seconds):
                    return
        finally:
            spark.streams.removeListener(listener)
