"""Change streams as Structured Streaming.

Events name a unit and a file, or nothing known. Per unit the pending files are kept as
state, up to a limit beyond which the unit is marked unknown and must be listed anew; no
watermark drops a late event, for a lost one would make an answer wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Files that a unit keeps as pending before it counts as unknown.
MOST_PENDING = 2000


def pending_state(events: DataFrame, most: int = MOST_PENDING) -> DataFrame:
    """``unit, pending, unknown`` after each trigger, for units with events in it. ``events``:
    ``unit, rel`` (null: something unknown changed)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, unknown = state.get if state.exists else ([], False)
        files = set(held)
        for b in batches:
            if not unknown:
                unknown = bool(b["rel"].isna().any())
                files.update(b["rel"].dropna())
            unknown = unknown or len(files) > most
            files = set() if unknown else files
        state.update((sorted(files), unknown))
        yield pd.DataFrame({"unit": [key[0]], "pending": [len(files)], "unknown": [unknown]})

    return events.groupBy("unit").applyInPandasWithState(update, "unit string, pending long, unknown boolean", "files array<string>, unknown boolean", "update", GroupStateTimeout.NoTimeout)


def bursts(events: DataFrame, quiet: str) -> DataFrame:
    """``unit, start, end, events``: runs of events with no quiet time between them; a rebuild
    is due at ``end``. Works on streams with a watermark and on tables alike."""
    w = F.session_window("ts", quiet)
    return events.groupBy("unit", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("unit", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet folder, each trigger with its
    number, and reads the folder."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # a trigger that is run again overwrites what it wrote before
        batch.withColumn("trigger", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/trigger={number}".replace("trigger=", "t-"))

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def follow(events: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str = "200 milliseconds") -> StreamingQuery:
    """Hands each trigger's changed files, each once, to ``rebuild``; its failure fails the
    trigger, which then runs again with the same files."""

    def each(batch: DataFrame, number: int) -> None:
        changed = batch.select("unit", "rel").distinct()
        if not changed.isEmpty():
            rebuild(changed, number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
