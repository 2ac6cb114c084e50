"""Step graphs with persisted state: status, the first ready step, state logs and planned runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.operators.manifests import latest

#: The dubbing steps in order, and what each needs done.
STEPS = ["切割视频", "拆分音轨", "转换文字", "文本翻译", "人声分离", "人声生成", "重新混音", "合成音轨", "人物锚定", "口型匹配", "人脸增强", "合成视频"]
NEEDS = {
    "转换文字": ["拆分音轨"],
    "文本翻译": ["转换文字"],
    "人声分离": ["拆分音轨"],
    "人声生成": ["人声分离", "文本翻译"],
    "重新混音": ["人声生成"],
    "合成音轨": ["拆分音轨", "文本翻译"],
    "人物锚定": ["人声生成"],
    "口型匹配": ["人声生成"],
    "人脸增强": ["口型匹配"],
    "合成视频": ["口型匹配", "重新混音"],
}


def steps(spark: SparkSession, names: list[str] = STEPS) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "step string, ord int")


def edges(spark: SparkSession, needs: dict[str, list[str]] = NEEDS) -> DataFrame:
    return spark.createDataFrame([(s, n) for s, ns in needs.items() for n in ns], "step string, needs string")


def _literal(df: DataFrame, *columns: str, most: int = 1000) -> Column:
    """The rows of a small table, a step list, as an array of structs; more than `most` are an error."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} steps or needs")
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows]).cast(f"array<struct<{kinds}>>")


def status(states: DataFrame, step_list: DataFrame, edge_list: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, ord, status: locked if a step it needs is not done, else the stored state, or ready.

    states: keys, step, state; keys without any row in it are not known. Steps that are not in the list are locked.
    """
    known = states.select(*keys).distinct()
    full = known.withColumn("__s", F.explode(_literal(step_list, "step", "ord"))).select(*keys, "__s.*").join(states, [*keys, "step"], "left")
    need = known.withColumn("__e", F.explode(_literal(edge_list, "step", "needs"))).select(*keys, "__e.*").join(states.select(*keys, F.col("step").alias("needs"), F.col("state").alias("needed")), [*keys, "needs"], "left")
    locked = need.groupBy(*keys, "step").agg(F.bool_or(F.coalesce(F.col("needed") != "done", F.lit(True))).alias("locked"))
    out = full.join(locked, [*keys, "step"], "left")
    listed = out.select(*keys, "step", "ord", F.when(F.col("locked"), "locked").otherwise(F.coalesce("state", F.lit("ready"))).alias("status"))
    unknown = states.join(step_list.select("step"), "step", "left_anti").select(*keys, "step", F.lit(None).cast("int").alias("ord"), F.lit("locked").alias("status"))
    return listed.unionByName(unknown)


def first_ready(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the first step, in order, that is ready; keys without one are left out."""
    return statuses.filter("status = 'ready'").groupBy(*keys).agg(F.min(F.struct("ord", "step")).alias("x")).select(*keys, F.col("x.step").alias("step"))


def state_of(log: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest state of each step from an append-only log."""
    return latest(log, [*keys, "step"], [time, tie])


def marked(log: DataFrame, entry: DataFrame, names: list[str] = STEPS) -> DataFrame:
    """The log with an entry appended; a step that is not in the list is an error."""
    good = F.when(F.col("step").isin(names), True).otherwise(F.raise_error(F.concat(F.lit("unknown step "), F.col("step"))).cast("boolean"))
    return log.unionByName(entry.filter(good))


def history_tail(log: DataFrame, keys: list[str], time: str, tie: str, n: int) -> DataFrame:
    """The last n entries of each key, newest first: keys, place, and the entry's columns."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    # A filter on the row number of a window is pushed below its shuffle: n rows of a key leave each task, however hot it is.
    rows = log.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n)
    return rows.select(*keys, (F.col("__n") - 1).alias("place"), *[c for c in log.columns if c not in keys])


def plan(named: list[tuple[str, Callable]], enabled: dict[str, bool]) -> list[tuple[str, Callable]]:
    """The enabled steps, in order."""
    return [(n, f) for n, f in named if enabled.get(n, True)]


def run_plan(df: DataFrame, planned: list[tuple[str, Callable]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The result of running steps one after another, and what came of each: done or skipped (it returned None).

    An exception ends the run.
    """
    out = []
    for name, step in planned:
        result = step(df)
        out.append((name, "skipped" if result is None else "done"))
        df = df if result is None else result
    return df, out


def active(spark: SparkSession) -> list[str]:
    """Names of the streaming queries that run now."""
    return [q.name or str(q.id) for q in spark.streams.active]


def shut_down(spark: SparkSession, seconds: float = 5.0) -> bool:
    """Stop all streaming queries; whether all ended in time."""
    for q in spark.streams.active:
        q.stop()
    return all(q.awaitTermination(int(max(1, seconds))) is not False for q in spark.streams.active)


def state_order(state: Column) -> Column:
    """Places of states for sorting: locked, ready, running, done, failed."""
    return F.array_position(F.array(*[F.lit(s) for s in ("locked", "ready", "running", "done", "failed")]), state)
