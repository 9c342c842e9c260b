"""A reorder buffer as a stateful streaming operator, and stateless streaming steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "domain long, seq long, etype int, name string, late boolean"
GAP = 255
#: State store that the operator needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stall_ms(latency_ms: float, pending: int, fill: float) -> float:
    """How long to wait for a hole: twice the latency within 50 to 500 ms, less under pressure."""
    if pending > 1000 or fill > 0.8:
        return 0
    if pending > 100 or fill > 0.5:
        return 10
    return min(max(2 * latency_ms, 50), 500)


class Reorder(StatefulProcessor):
    """Emits a domain's changes by number; a hole is waited for, then reported as a gap and passed.

    State: the next number, and the changes held. Changes below the next number are late: they are
    emitted at once and flagged, never dropped. A number comes once; a repeated one is dropped while held.
    """

    def __init__(self, latency_ms: float = 100, capacity: int = 100_000):
        self.latency_ms, self.capacity = latency_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.held = handle.getMapState("held", "seq long", "etype int, name string")

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["domain", "seq", "etype", "name", "late"])

    def _drain(self, domain: int, at: int, held: dict[int, tuple], force: bool) -> tuple[list[tuple], int]:
        out = []
        for seq in sorted(held):
            if seq > at:
                if not force:
                    break
                out.append((domain, at, GAP, f"GAP-{at}-{seq - 1}", False))
            out.append((domain, seq, *held[seq], False))
            at = seq + 1
        return out, at

    def _settle(self, domain: int, at: int, before: set[int], held: dict[int, tuple], force: bool) -> list[tuple]:
        out, at = self._drain(domain, at, held, force)
        left = {s: v for s, v in held.items() if s >= at}
        for s in before - left.keys():
            self.held.removeKey((s,))
        for s in left.keys() - before:
            self.held.updateValue((s,), left[s])
        self.next.update((at,))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        domain = int(key[0])
        held = {int(k[0]): (int(v[0]), v[1]) for k, v in self.held.iterator()}
        before = set(held)
        new = sorted((int(s), int(e), n) for pdf in rows for s, e, n in zip(pdf["seq"], pdf["etype"], pdf["name"], strict=True))
        if self.next.exists():
            at = int(self.next.get()[0])
        elif new:
            at = new[0][0]
        else:
            return
        late = []
        for seq, etype, name in new:
            if seq < at:
                late.append((domain, seq, etype, name, True))
            else:
                held.setdefault(seq, (etype, name))
        wait = stall_ms(self.latency_ms, len(held), len(held) / self.capacity)
        out = late + self._settle(domain, at, before, held, force=wait == 0)
        if wait and any(True for _ in self.held.iterator()):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + int(wait))
        if out:
            yield self._out(out)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        held = {int(k[0]): (int(v[0]), v[1]) for k, v in self.held.iterator()}
        if held and self.next.exists():
            out = self._settle(int(key[0]), int(self.next.get()[0]), set(held), held, force=True)
            if out:
                yield self._out(out)

    def close(self) -> None:
        pass


def reordered(changes: DataFrame, latency_ms: float = 100, wait: bool = True) -> DataFrame:
    """Streaming (domain, seq, etype, name) by number with gaps reported; parallel by domain.

    Without ``wait`` a hole is reported at the end of its batch: the mode for a stream that ends, as
    timers keep a query alive.
    """
    return changes.select("domain", "seq", "etype", "name").groupBy("domain").transformWithStateInPandas(
        statefulProcessor=Reorder(latency_ms, 100_000 if wait else 1), outputStructType=OUT, outputMode="append",
        timeMode="processingTime" if wait else "none",
    )


def counted(events: DataFrame, window: str, delay: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and key; late rows beyond the delay don't change closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window), *keys).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start_s"), *keys, "n")


def repairs_once(events: DataFrame, delay: str, *keys: str) -> DataFrame:
    """A repair that is in flight isn't asked for again."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))
