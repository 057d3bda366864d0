"""The sequential monitor and log compaction as Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidora.operators.corpus import current
from evidora.session import cut
from evidora.sources.files import exists

OUT = "run string, turn bigint, llr double, fired boolean"
STATE = "llr double, last bigint"


def watch(values: DataFrame, bound: float = 19.0) -> DataFrame:
    """(run, turn, llr, fired) for every arriving (run, turn, x): the test of
    :func:`evidora.operators.measure.monitor`, its sum kept as state per run. A
    turn at or before the last one counted is ignored, so a replayed turn
    counts once; a null ``x`` leaves the sum."""
    edge = math.log(bound)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        llr, last = state.get if state.exists else (0.0, -(2**62))
        arrived = pd.concat(list(batches)).sort_values("turn")
        out: list[tuple[Any, ...]] = []
        for turn, x in zip(arrived["turn"], arrived["x"]):
            if turn <= last:
                continue
            last = int(turn)
            if x == x and x is not None:
                x = min(1 - 1e-6, max(1e-6, x))
                llr += 4 * math.log((1 - x) / x)
            fired = abs(llr) >= edge
            out.append((key[0], last, llr, fired))
            llr = 0.0 if fired else llr
        state.update((llr, last))
        yield pd.DataFrame(out, columns=["run", "turn", "llr", "fired"])

    rows = values.select("run", F.col("turn").cast("bigint").alias("turn"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, kind: str = "purchase", late: str = "2 days") -> DataFrame:
    """(day, n, share): each day's events and the share of one kind, over a
    stream with late rows up to ``late``."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(day).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == kind).cast("double")).alias("share"))
    return out.select(F.col("window.start").alias("day"), "n", "share")


BUCKETS = 64


def compact_into(log: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keeps the current row of each document of a streamed change log at
    ``path``, in ``buckets`` folders by the document's hash. A batch touches
    only the folders of its documents: their rows are merged with the batch and
    put in their place. A replayed batch changes nothing, as the last row by
    ``seq`` stays. :func:`compacted` reads the store."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("doc_id").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        if exists(spark, path):
            rows = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*rows.columns).unionByName(rows)
        cut(current(rows)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
