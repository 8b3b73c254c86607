"""The facade: a change log to a callback, in batch or as a stream; ``replica`` and ``decode.printed`` are such callbacks."""

from __future__ import annotations

import logging
import signal
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.session import shared_folder
from tidelog.sources import cdclog

log = logging.getLogger("tidelog")


class CdcEngine:
    """A log and its metadata tables, given as paths."""

    def __init__(self, spark: SparkSession, path: str, generations: str | None = None, ring: str | None = None, tokens: str | None = None, now_ms: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.options = {k: str(v) for k, v in {"path": path, "generations": generations, "ring": ring, "tokens": tokens, "now_ms": now_ms}.items() if v is not None}
        self.running: list[StreamingQuery] = []

    def batch(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def stream(self) -> DataFrame:
        cdclog.register(self.spark)
        return self.spark.readStream.format("cdclog").options(**self.options).load()

    def fetch_changes(self, consume: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
        """Call ``consume(batch, batch_id)`` for every batch; at least once each, so it should be idempotent by id."""
        writer = self.stream().writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint)
        q = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
        self.running.append(q)
        return q

    def read_once(self) -> DataFrame:
        """All that the stream delivers up to now, through a folder in the session's shared one."""
        folder = f"{shared_folder(self.spark)}/stream-{uuid.uuid4().hex}"
        self.fetch_changes(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/b={i}"), f"{folder}/checkpoint", once=True).awaitTermination()
        return self.spark.read.parquet(f"{folder}/out").drop("b")

    def finish(self) -> None:
        for q in self.running:
            q.stop()

    def stop_on_interrupt(self) -> None:
        signal.signal(signal.SIGINT, lambda *_: self.finish())


class ProgressLog(StreamingQueryListener):
    """Logs what each batch read, at most every ``every_s`` seconds, and why a query ended."""

    def __init__(self, every_s: float = 10.0) -> None:
        self.every_s, self.last, self.rows = every_s, float("-inf"), 0

    def onQueryStarted(self, event) -> None:
        log.info("query %s started", event.id)

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if time.monotonic() - self.last >= self.every_s:
            self.last = time.monotonic()
            log.info("batch %d: %d changes, %d in all", event.progress.batchId, event.progress.numInputRows, self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("query %s ended%s", event.id, f": {event.exception}" if event.exception else "")
