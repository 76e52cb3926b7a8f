"""Structured Streaming: running statistics, rate limiter, alerts, metric states, watching a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelake.operators.ingest import scan


def tool_stats(events: DataFrame) -> DataFrame:
    """Running uses, success rate and mean time of each tool; for complete or update mode."""
    return events.groupBy("tool_name").agg(F.count("*").alias("uses"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.avg("execution_time"), 6).alias("avg_time"), F.max("ts").alias("last_used"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Uses of each tool in tumbling windows; events later than ``late`` are dropped, which bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "tool_name").agg(F.count("*").alias("uses")).select("window.start", "window.end", "tool_name", "uses")


def rate_limited(events: DataFrame, limit: int = 30, window_s: float = 60.0, idle_ms: int | None = None) -> DataFrame:
    """Decision for each event of each key: key, seq, allowed, retry_after.

    ``events`` has key, seq and t (seconds). The state of a key holds the times
    of its accepted events within the window; with ``idle_ms`` it goes after
    that time without events. Events of one batch are taken in the order of
    seq. Without it a run over what is available ends by itself.
    """
    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        g = pd.concat(list(batches)).sort_values("seq")
        ok, retry = [], []
        for t in g["t"]:
            kept = [x for x in kept if x > t - window_s]
            if len(kept) < limit:
                kept.append(float(t))
                ok.append(True)
                retry.append(0.0)
            else:
                ok.append(False)
                retry.append(round(kept[0] - (t - window_s), 6))
        state.update((kept,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": key[0], "seq": g["seq"].to_numpy(), "allowed": ok, "retry_after": retry})

    return events.groupBy("key").applyInPandasWithState(decide, "key string, seq long, allowed boolean, retry_after double", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def slow_tool_alerts(events: DataFrame, size: int = 10, limit: float = 2.0) -> DataFrame:
    """Events from the eleventh of a tool on at which the mean of its last ten times exceeds the limit: tool_name, seq, mean_time."""
    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        g = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s, t in zip(g["seq"], g["execution_time"], strict=True):
            if t == t and t:
                last, n = [*last, float(t)][-size:], n + 1
                mean = sum(last) / len(last)
                if n > size and mean > limit:
                    out.append((key[0], int(s), round(mean, 4)))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["tool_name", "seq", "mean_time"])

    return events.groupBy("tool_name").applyInPandasWithState(watch, "tool_name string, seq long, mean_time double", "last array<double>, n long", "append", GroupStateTimeout.NoTimeout)


def last_values(metrics: DataFrame) -> DataFrame:
    """The last value of each metric with its limits; for update mode."""
    return metrics.groupBy("name").agg(F.max_by(F.struct("value", "unit", "warn", "crit"), "ts").alias("m")).select("name", "m.*")


def publish(stream: DataFrame, handlers: dict[str, list[Callable[[DataFrame], None]]], kind: str = "event_type"):
    """Writer that hands each batch's events to the handlers of their kind; a handler that fails doesn't stop the others."""
    def fan_out(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for k, fs in handlers.items():
            for f in fs:
                try:
                    f(batch.filter(F.col(kind) == k))
                except Exception as e:  # noqa: BLE001
                    print(f"handler of {k} failed in batch {epoch}: {e}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(fan_out)


def watch_tree(spark, folder: str, on_items: Callable[[DataFrame, int], None]):
    """Writer that scans the changed files of a tree in each batch and hands their items on."""
    from codelake.sources.tree import CodeTree

    spark.dataSource.register(CodeTree)
    files = spark.readStream.format("codetree").option("path", folder).load()
    return files.writeStream.foreachBatch(lambda batch, epoch: on_items(scan(batch), epoch))
