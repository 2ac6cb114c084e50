"""JSON-lines streams: decoded messages, progress, and bounded work on the way."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuesheet.functions import jsonio


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the JSON-lines files that arrive in a folder; malformed lines are left out."""
    return jsonio.messages(spark.readStream.text(folder))


def drain(stream: DataFrame, path: str, checkpoint: str, name: str | None = None) -> None:
    """Write what is there as Parquet and end; a later call goes on where this one stopped."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.queryName(name) if name else writer).start().awaitTermination()


def progress_stream(messages: DataFrame, tell: Callable[[dict], None], checkpoint: str) -> StreamingQuery:
    """Calls tell with {source: segments so far in this batch} for each micro-batch: one row per source."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.filter("type = 'segment'").groupBy("source").count().collect()  # a row per file in work
        tell({"batch": number, "segments": {r["source"]: r["count"] for r in rows}})

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_retries(df: DataFrame, call: Callable[[str, str | None], str], column: str, out: str = "result", attempts: int = 5, threads: int = 4, wait: float = 0.0) -> DataFrame:
    """df with out and out_error: the answer of a slow call per row, tried anew with the last error as a hint.

    Requests of a partition run at most `threads` at a time and come back in row order; a row whose attempts all
    fail has a null answer and the last error. Partitions bound how many run on the cluster.
    """
    schema = df.withColumn(out, F.lit(None).cast("string")).withColumn(f"{out}_error", F.lit(None).cast("string")).schema

    def one(value: str) -> tuple[str | None, str | None]:
        hint = None
        for i in range(attempts):
            try:
                return call(value, hint), None
            except Exception as e:  # noqa: BLE001  whatever the service raises becomes the row's error
                hint = str(e)
                if wait:
                    time.sleep(wait * (i + 1))
        return None, hint

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                done = list(pool.map(one, pdf[column]))
                yield pdf.assign(**{out: [d[0] for d in done], f"{out}_error": [d[1] for d in done]})

    return df.mapInPandas(run, schema)


def until_cancelled(df: DataFrame, call: Callable[[str], str], column: str, marker: str, out: str = "result") -> DataFrame:
    """df with out and out_status: rows are answered until a marker file appears, which is looked for before every batch of rows.

    Rows that came before it keep their answers (`done`); the others are null (`cancelled`). marker: a path in a
    folder that all executors see.
    """
    schema = df.withColumn(out, F.lit(None).cast("string")).withColumn(f"{out}_status", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if os.path.exists(marker.removeprefix("file://")):
                yield pdf.assign(**{out: None, f"{out}_status": "cancelled"})
            else:
                yield pdf.assign(**{out: [call(v) for v in pdf[column]], f"{out}_status": "done"})

    return df.mapInPandas(run, schema)


def longest_attempt(attempts: DataFrame, keys: list[str], attempt: str, length: str, plausible: str) -> DataFrame:
    """One attempt of each key: the first of a plausible length, else the longest (the first of equals)."""
    good = F.min(F.when(F.col(length) >= F.col(plausible), F.struct(attempt, length))).alias("good")
    best = F.max(F.struct(F.col(length).alias("l"), (-F.col(attempt)).alias("a"))).alias("best")
    chosen = attempts.groupBy(*keys).agg(good, best)
    return chosen.select(*keys, F.coalesce(F.col(f"good.{attempt}"), -F.col("best.a")).alias(attempt), F.coalesce(F.col(f"good.{length}"), F.col("best.l")).alias(length))


def longest_take(make: Callable[[str, int], list], plausible: Callable[[str], float], attempts: int = 4) -> Callable[[str], list]:
    """A function that tries seeds until a take is plausibly long, and else returns the longest."""

    def run(value: str) -> list:
        best: list = []
        for seed in range(attempts):
            take = make(value, seed)
            if len(take) > len(best):
                best = take
            if len(best) >= plausible(value):
                break
        return best

    return run
