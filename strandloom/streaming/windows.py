"""Windows over a stream of reads: running node counts, and sessions of calls that come one by one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.operators.graph import gene_mers


def node_counts(reads: DataFrame, k: int) -> DataFrame:
    """Coverage of each node so far, of a stream of whole reads; for update or complete mode."""
    return gene_mers(reads, k).groupBy("node_id").agg(F.count("*").alias("coverage"))


def windowed_counts(reads: DataFrame, k: int, ts: str, delay: str, width: str) -> DataFrame:
    """Coverage per node and span of time; reads later than ``delay`` don't count."""
    walk = reads.withWatermark(ts, delay)
    rows = walk.select(F.col(ts), "calls", "read_id")
    from strandloom.functions.arrays import canonical_windows

    nodes = rows.select(ts, F.explode(canonical_windows(F.col("calls"), F.lit(None).cast("array<struct<start:int,end:int>>"), k)).alias("w")).select(ts, "w.node_id")
    return nodes.groupBy(F.window(ts, width), "node_id").agg(F.count("*").alias("coverage"))


def window_stream(calls: DataFrame, k: int, timeout_ms: int = 3_600_000) -> DataFrame:
    """Windows of reads whose calls (read_id, ts, call) come one by one; the state is the last k - 1 calls of a read."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, held = state.get if state.exists else (0, [])
        held = list(held)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for call in rows["call"]:
            held.append(call)
            if len(held) == k:
                out.append((key[0], n, list(held)))
                n += 1
                held.pop(0)
        state.update((n, held))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["read_id", "pos", "win"])

    return calls.groupBy("read_id").applyInPandasWithState(step, "read_id string, pos long, win array<string>", "n long, held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
