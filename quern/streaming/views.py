"""Views maintained from change feeds.

Every micro-batch is folded per key and written as a delta; after DELTAS of them they are folded
into a new base, so a batch costs what it brings and not what the view holds. What belongs to the
view stands in one file that is replaced at the end of a batch: a batch that is run again is not counted again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import contiguous
from ..sources.files import Files

#: Deltas that a read folds at most.
DELTAS = 16


class FoldedView:
    """The latest row per key of a stream, with a count of the key's events; deletions stay inside as tombstones."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: Sequence[str], deleted: Column):
        self.spark, self.key, self.order, self.deleted = spark, key, list(order), deleted
        self.files = Files(spark, root)

    def _at(self) -> dict:
        return json.loads(self.files.read("at.json")) if self.files.exists("at.json") else {"batch": -1, "parts": [], "old": [], "seq": 0, "stale": True}

    def _fold(self, rows: DataFrame) -> DataFrame:
        payload = F.struct(*[c for c in rows.columns if c not in (self.key, "events")])
        out = rows.groupBy(self.key).agg(F.max_by(payload, F.struct(*self.order)).alias("r"), F.sum("events").alias("events"))
        return out.select(self.key, "r.*", "events")

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("gone", self.deleted).withColumn("events", F.lit(1).cast("long"))

    def _take(self, batch: DataFrame, at: dict) -> DataFrame | None:
        """The rows of a batch that the view applies; what it has seen is noted in at."""
        return batch

    def _write(self, rows: DataFrame) -> str:
        name = f"parts/{uuid.uuid4().hex}"
        rows.write.parquet(self.files.at(name))
        return name

    def _merge(self, batch: DataFrame, number: int) -> None:
        at = self._at()
        if number <= at["batch"]:
            return
        rows = self._take(batch, at)
        if rows is not None:
            at["parts"].append(self._write(self._fold(self._counted(rows))))
        done = []
        if len(at["parts"]) > DELTAS:
            done, at["old"] = at["old"], at["parts"]  # readers of the view before may go on until the next time
            at["parts"] = [self._write(self._fold(self._parts(at["old"])))]
        self.files.replace("at.json", json.dumps(at | {"batch": number}))
        for name in done:
            self.files.remove(name)

    def _parts(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*map(self.files.at, names))

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self._merge).option("checkpointLocation", self.files.at("checkpoint")).trigger(**(trigger or {"availableNow": True})).start()

    def current(self) -> DataFrame:
        """The live rows of the view, with the number of events of their key."""
        names = self._at()["parts"]
        if not names:
            raise LookupError("the view has seen no batch yet")
        return self._fold(self._parts(names)).where("not gone").drop("gone")


class FollowedView(FoldedView):
    """A view that loads a snapshot and then follows a feed of dense numbers.

    Events that were applied already are left out. After a gap the view is stale: it keeps what it had up to
    there, applies nothing more, and says so until a new snapshot is loaded. Before the first one it is stale, too.
    A batch is put in order first, so what is out of order within it is no gap.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, seq: str, deleted: Column):
        super().__init__(spark, root, key, [seq], deleted)
        self.seq = seq

    @property
    def stale(self) -> bool:
        return self._at()["stale"]

    @property
    def last_seq(self) -> int:
        return self._at()["seq"]

    def load(self, snapshot: DataFrame, seq: int) -> None:
        """Start anew from a snapshot with the columns of the feed, which holds all events up to seq."""
        at = self._at()
        name = self._write(self._fold(self._counted(snapshot)))
        self.files.replace("at.json", json.dumps(at | {"parts": [name], "old": at["old"] + at["parts"], "seq": seq, "stale": False}))

    def _take(self, batch: DataFrame, at: dict) -> DataFrame | None:
        if at["stale"]:
            return None
        end, beyond = contiguous(batch, self.seq, at["seq"])
        new = batch.where((F.col(self.seq) > at["seq"]) & (F.col(self.seq) <= end)).dropDuplicates([self.seq])
        changed = end > at["seq"]
        at["seq"], at["stale"] = end, beyond
        return new if changed else None


def windowed_counts(stream: DataFrame, ts: str, kind: str, *, window: str, late: str) -> DataFrame:
    """Extension: tumbling event-time counts with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n"))


def once(stream: DataFrame, token: str, ts: str, late: str) -> DataFrame:
    """The first use of every token within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([token])
