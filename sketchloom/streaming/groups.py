"""Consumer groups: each message is delivered to the group once, and worked on until it is acknowledged.

A group reads a stream of messages (message_id, ts, ...) under one checkpoint.
``receive`` cuts it into batches, leaving out messages whose id came before
within the watermark, and gives each batch to the consumer that calls.  A batch
is pending until it is acknowledged; pending batches of a consumer that is lost
are claimed by another one.  Results are written by batch, so a batch that two
consumers worked on counts once.

Deliveries, claims and acknowledgements are small files that are created
exclusively, so of two consumers that claim a batch one gets it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Files


class ConsumerGroup:
    """Consumers that share the messages of one stream."""

    def __init__(self, spark: SparkSession, folder: str, late: str = "1 hour"):
        self.spark, self.folder, self.late = spark, folder.rstrip("/"), late
        self.files = Files(spark, self.folder)

    def _log(self, kind: str, batch: int, attempt: int, consumer: str) -> bool:
        record = {"batch": batch, "attempt": attempt, "consumer": consumer, "at": time.time()}
        return self.files.create(f"{self.folder}/{kind}/{batch}-{attempt}.json", json.dumps(record))

    def _records(self, kind: str) -> list[dict]:
        found = []
        for name, _ in self.files.names(f"{self.folder}/{kind}"):
            if name.endswith(".json"):
                text = self.files.read(f"{self.folder}/{kind}/{name}")
                if text.endswith("}"):  # else it is being written
                    found.append(json.loads(text))
        return found

    def receive(self, stream: DataFrame, consumer: str) -> list[int]:
        """Cut what the stream has into batches for this consumer; returns those that are new.

        Messages are (message_id, ts, ...).  Ids are remembered as long as the
        watermark allows: a message that is sent again within ``late`` is left
        out.
        """
        before = self._known()

        def deliver(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/messages/batch={batch}")
            self._log("deliveries", batch, 0, consumer)  # a batch that comes again keeps its first consumer

        distinct = stream.withWatermark("ts", self.late).dropDuplicatesWithinWatermark(["message_id"])
        writer = distinct.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{self.folder}/offsets")
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(self._known() - before)

    def _known(self) -> set[int]:
        return {r["batch"] for r in self._records("deliveries")}

    def messages(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/messages/batch={batch}")

    def pending(self) -> DataFrame:
        """(batch, consumer, deliveries, idle): batches without acknowledgement, whose they are, and for how many seconds."""
        rows = [(r["batch"], r["consumer"], r["attempt"] + 1, max(0.0, time.time() - r["at"])) for r in self._owners() if r["batch"] not in self._done()]
        return self.spark.createDataFrame(sorted(rows), "batch long, consumer string, deliveries int, idle double")

    def _owners(self) -> list[dict]:
        last: dict[int, dict] = {}
        for r in self._records("deliveries"):
            if r["batch"] not in last or last[r["batch"]]["attempt"] < r["attempt"]:
                last[r["batch"]] = r
        return list(last.values())

    def _done(self) -> set[int]:
        return {r["batch"] for r in self._records("acks")}

    def claim(self, consumer: str, idle: float) -> list[int]:
        """Take over batches that have been pending for ``idle`` seconds; returns those that this consumer got."""
        done, now, got = self._done(), time.time(), []
        for r in self._owners():
            if r["batch"] not in done and now - r["at"] >= idle and self._log("deliveries", r["batch"], r["attempt"] + 1, consumer):
                got.append(r["batch"])
        return sorted(got)

    def work(self, batches: list[int], f: Callable[[DataFrame], DataFrame]) -> None:
        """Write f(messages) of each batch, then acknowledge it; a batch that fails stays pending."""
        for batch in batches:
            f(self.messages(batch)).write.mode("overwrite").parquet(f"{self.folder}/results/batch={batch}")
            self.acknowledge(batch)

    def acknowledge(self, batch: int) -> bool:
        """True for the first acknowledgement of a batch."""
        return self._log("acks", batch, 0, "")

    def results(self) -> DataFrame:
        """What ``work`` wrote of acknowledged batches, each once."""
        done = sorted(self._done())
        if not done:
            raise ValueError("no batch is acknowledged yet")
        read = self.spark.read.option("basePath", f"{self.folder}/results")
        return read.parquet(*[f"{self.folder}/results/batch={b}" for b in done])

    def lag(self) -> DataFrame:
        """(consumer, pending, acknowledged) of each consumer's batches."""
        done = self._done()
        rows = [(r["consumer"], int(r["batch"] not in done), int(r["batch"] in done)) for r in self._owners()]
        df = self.spark.createDataFrame(rows, "consumer string, p int, a int")
        return df.groupBy("consumer").agg(F.sum("p").alias("pending"), F.sum("a").alias("acknowledged"))
