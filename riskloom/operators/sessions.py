"""Sessions of activity by secondary sort and one linear scan of each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def _scanner(gap_ms: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sessions of one sorted partition. State is one open session and the last event, whatever the partition holds."""
        open_: list | None = None  # key, start, end, events
        last_event = None
        first = True  # the next session to be given out is the partition's first
        for batch in batches:
            if not len(batch):
                continue
            key, ts, event = batch["k"].to_numpy(), batch["ts"].to_numpy(np.int64), batch["event"].to_numpy()
            same = np.empty(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[0] = open_ is not None and open_[0] == key[0]
            before = np.empty(len(ts), np.int64)
            before[1:], before[0] = ts[:-1], open_[2] if open_ is not None else 0
            starts = ~(same & (ts - before <= gap_ms))
            repeat = np.empty(len(key), bool)
            named = batch["event"].notna().to_numpy()
            repeat[1:] = same[1:] & named[1:] & (ts[1:] == ts[:-1]) & (event[1:] == event[:-1])
            repeat[0] = bool(same[0] and named[0] and ts[0] == before[0] and event[0] == last_event)
            at = np.flatnonzero(starts)
            ends = np.append(at[1:], len(key)) - 1
            counts = np.add.reduceat(~repeat, at) if len(at) else np.empty(0, np.int64)
            head = int(np.count_nonzero(~repeat[: at[0] if len(at) else len(key)]))
            upto = (at[0] if len(at) else len(key)) - 1
            if upto >= 0:  # the batch goes on with the open session
                open_[2], open_[3] = int(ts[upto]), open_[3] + head
            last_event = event[-1]
            if not len(at):
                continue
            rows = [[key[i], int(ts[i]), int(ts[j]), int(n)] for i, j, n in zip(at, ends, counts)]
            closed = ([open_] if open_ is not None else []) + rows[:-1]
            open_ = rows[-1]
            if closed:
                out = pd.DataFrame(closed, columns=["k", "start_ms", "end_ms", "n_events"])
                out["edge"] = False
                if first:
                    out.loc[0, "edge"], first = True, False
                yield out
        if open_ is not None:
            yield pd.DataFrame([[*open_, True]], columns=["k", "start_ms", "end_ms", "n_events", "edge"])

    return scan


def sessionize(events: DataFrame, key: str, ts: str, event: str, gap_ms: int) -> DataFrame:
    """Sessions per key: a new one begins when more than ``gap_ms`` lie between an event and the one before.

    Rows are range-partitioned and sorted by (key, ts, event), so that a key with a third of all rows spreads over as
    many partitions as its share needs. Each partition is scanned once, in Arrow batches, with one open session as
    state. Only the first and last session of a partition can go on in its neighbours; those few (two a partition)
    are merged afterwards by the same gap rule. What the scan emits is written once: range bounds are sampled, so a
    second evaluation could cut the partitions elsewhere, and inner and edge sessions would no longer fit together.

    Result: key column, start_ms, end_ms, duration_ms, n_events. Rows with null key or ts are left out. Rows that agree
    in key, ts and a non-null ``event`` (an id) are one event; null ids count one each. Empty input: no rows.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast("string").alias("k"), F.col(ts).cast("long").alias("ts"), F.col(event).cast("string").alias("event")
    )
    ordered = rows.repartitionByRange("k", "ts").sortWithinPartitions("k", "ts", "event")
    pieces = cut(ordered.mapInPandas(_scanner(gap_ms), "k string, start_ms long, end_ms long, n_events long, edge boolean"))
    whole = pieces.where(~F.col("edge")).drop("edge")
    order = Window.partitionBy("k").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = (
        pieces.where("edge")
        .withColumn("new", F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0))
        .withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    merged = numbered.groupBy("k", "no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events")).drop("no")
    return whole.unionByName(merged).select(
        F.col("k").alias(key), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events"
    )
