"""Signals as streams: windowed counts, sessions, cooldown, deduplication and the journal."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(signals: DataFrame, late: str) -> DataFrame:
    """With a watermark on ``time``, which has to be an instant for it."""
    return signals.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)


def counts_by_type(signals: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Signals of each type and window; a window closes once the watermark has passed it, and later signals are left out."""
    grouped = _timed(signals, late).groupBy(F.window("time", window).alias("w"), "type")
    return grouped.agg(F.count("*").alias("signals")).select(F.col("w.start").alias("start"), "type", "signals")


def sessions(signals: DataFrame, idle: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each agent, which end after ``idle`` without a signal."""
    grouped = _timed(signals, late).groupBy("agent", F.session_window("time", idle).alias("w"))
    return grouped.agg(F.count("*").alias("signals")).select("agent", F.col("w.start").alias("started"), "signals")


def first_arrivals(signals: DataFrame, late: str = "1 day") -> DataFrame:
    """Each id once, however often its signal is delivered within the watermark."""
    return _timed(signals, late).dropDuplicatesWithinWatermark(["id"])


def cooled_down(signals: DataFrame, key: list[str], seconds: int = 3600, forget: str = "1 day") -> DataFrame:
    """Ids that are let through: a key's next one comes ``seconds`` or more after its last.

    Signals of one micro-batch are taken in order of time, one that is older
    than the last one let through is held back.  A key that is silent for
    ``forget`` beyond the watermark loses its state.
    """
    micro = pd.Timedelta(forget).value // 1_000_000

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        # Arrow hands a key's share of a micro-batch over in bounded pieces; their times are all that is sorted.
        arrived = pd.concat([pdf[["time", "id"]] for pdf in batches]).sort_values(["time", "id"])
        kept = []
        for t, i in zip(arrived["time"], arrived["id"], strict=True):
            now = t.value // 1000
            if last is None or now - last >= seconds * 1_000_000:
                kept.append(i)
                last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + max(micro, 1))
        yield pd.DataFrame({"id": kept})

    grouped = _timed(signals, "10 minutes").groupBy(*key)
    return grouped.applyInPandasWithState(run, "id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def journal(signals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append signals to Parquet, a folder for each day, until what has arrived is written; exactly once, from ``checkpoint`` on."""
    daily = signals.withColumn("day", F.to_date("time"))
    return daily.writeStream.partitionBy("day").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounded_journals(signals: DataFrame, max_size: int, key: str = "agent", late: str = "10 minutes") -> DataFrame:
    """``(key, id, recorded)`` as a stream: what enters each key's journal, and what leaves it.

    A full journal gives up its oldest tenth (one at least) before it records
    the next signal.  The state of a key is the ids that it holds, in order:
    ``max_size`` at most.  Signals of one micro-batch are recorded in order of
    time, then id; a repeated id is a recording of its own.
    """
    tenth = max(1, max_size // 10)

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        # A key's share of a micro-batch arrives in pieces; ids and times alone are put in order.
        for _, i in sorted((t, i) for pdf in batches for t, i in zip(pdf["time"], pdf["id"], strict=True)):
            gone = []
            if len(held) >= max_size:
                gone, held = held[:tenth], held[tenth:]
            held.append(i)
            yield pd.DataFrame({"journal": [name[0]] * (len(gone) + 1), "id": [*gone, i], "recorded": [False] * len(gone) + [True]})
        state.update((held,))

    return _timed(signals, late).groupBy(key).applyInPandasWithState(run, "journal string, id long, recorded boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)
