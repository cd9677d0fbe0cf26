"""Tasks whose parts arrive out of order, given out once when all parts are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A bucket has the parts of a BUCKETS-th of the ids that a batch brings.
BUCKETS = 1 << 14


class _Parts(StatefulProcessor):
    """Holds the parts of a task as a map, so a new part writes itself only, and their number, so they are read once, at the end."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "idx int", "results array<string>", self.ttl_ms)
        self.held = handle.getValueState("held", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, expected = (self.held.get() or (0,))[0], None
        for batch in rows:
            for idx, results, wanted in zip(batch["idx"], batch["results"], batch["expected"], strict=True):
                expected = int(wanted)
                if not self.parts.containsKey((int(idx),)):
                    self.parts.updateValue((int(idx),), (list(results),))
                    n += 1
        if expected is None or n < expected:
            self.held.update((n,))
            return
        found = sorted((k[0], list(v[0])) for k, v in self.parts.iterator())
        self.parts.clear()
        self.held.clear()
        yield pd.DataFrame({"id": [key[0]], "results": [[r for _, part in found for r in part]]})

    def close(self) -> None:
        pass


class _Open(StatefulProcessor):
    """The open tasks of a bucket of ids. The parts that a batch leaves open are added in one call, and a bucket's are written anew only when one of its held tasks ends; a task that a batch brings whole writes nothing."""

    def __init__(self, id_type: str):
        self.shape = f"id {id_type}, idx int, results array<string>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", self.shape)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, tasks, wanted, new = [(i, idx, list(results)) for i, idx, results in self.open.get()], {}, {}, []
        for i, idx, results in held:
            tasks.setdefault(i, {})[idx] = results
        for batch in rows:
            for i, idx, results, expected in zip(*(batch[c].tolist() for c in ("id", "idx", "results", "expected")), strict=True):
                wanted[i], parts = expected, tasks.setdefault(i, {})
                if idx not in parts:
                    parts[idx] = list(results)
                    new.append((i, idx, parts[idx]))
        done = [i for i, n in wanted.items() if len(tasks[i]) >= n]
        ended = set(done)
        new = [x for x in new if x[0] not in ended]
        if any(x[0] in ended for x in held):
            self.open.clear()
            new = [x for x in held if x[0] not in ended] + new
        if new:
            self.open.appendList(new)
        if done:
            yield pd.DataFrame({"id": done, "results": [[r for _, part in sorted(tasks[i].items()) for r in part] for i in done]})

    def close(self) -> None:
        pass


def completed_stream(parts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(id, results) in append mode, from a stream of (id, idx, results array<string>, expected); ids keep their type, be they numbers or texts.

    State is held for open tasks only, in RocksDB, which the session is set to use: it goes when the task is given out, or, with
    ttl_ms, that long after its last change, and then the task's later parts open it again. Without ttl_ms, state is read and written for buckets of ids, as a call for each task
    takes longer than its work; with it, each task has its own, so that its time is its own too. The first of repeated parts of an open task
    counts. Rows without id, idx, results or expected are left out, a task whose parts never all come is not given out, and
    a part that comes after its task was given out opens that task again. Other columns are ignored.
    """
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    clean = parts.select("id", F.col("idx").cast("int"), "results", F.col("expected").cast("int")).dropna()
    kind = parts.schema["id"].dataType.simpleString()
    shape = f"id {kind}, results array<string>"
    if ttl_ms:
        return clean.groupBy("id").transformWithStateInPandas(_Parts(ttl_ms), shape, "Append", "ProcessingTime")
    return clean.withColumn("__bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).groupBy("__bucket").transformWithStateInPandas(_Open(kind), shape, "Append", "None")
