"""Validated JSON: arrays of strings, tagged message lines, nested records, project documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text

#: Union of the tagged messages that the worker processes send, a line each.
MESSAGE = "type string, source string, start double, end double, text string, language string, message string, ev string, done int, total int, error string, results array<string>"
#: A project document; step payloads are kept as JSON text.
PROJECT = "name string, created_at string, updated_at string, video_path string, workspace_dir string, steps map<string,string>, step_data map<string,string>, history array<struct<timestamp:string,step:string,action:string,detail:string>>"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a Column that is used twice is otherwise written out twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_array(raw: Column, expected: Column, clean=text.clean_commentary) -> Column:
    """struct<ok array<string>, err string> of the outermost JSON array in a text.

    Errors: `no array`, `not json`, `wrong length`, `not a string`, `empty item`; the first that holds. Code
    fences are removed; items are cleaned.
    """

    def outermost(t: Column) -> Column:
        start = F.call_function("instr", t, F.lit("["))
        end = F.char_length(t) - F.call_function("instr", F.reverse(t), F.lit("]")) + 1
        return F.when((start > 0) & F.contains(t, F.lit("]")) & (end > start), F.substr(t, start, end - start + 1))

    def checked(found: Column) -> Column:
        items = found["items"]
        # Items keep their JSON text: a string is told from a number by the type of the parsed value.
        shape = (
            F.when(found["body"].isNull(), "no array")
            .when(found["kind"].isNull() | items.isNull(), "not json")
            .when(F.size(items) != expected, "wrong length")
            .when((found["kind"] != "ARRAY<STRING>") & (F.size(items) > 0), "not a string")
        )
        good = F.when(shape.isNull(), F.transform(items, lambda x: clean(x)))
        return F.struct(shape.alias("shape"), good.alias("good"))

    def verdict(r: Column) -> Column:
        err = F.coalesce(r["shape"], F.when(F.exists(r["good"], lambda x: F.coalesce(x, F.lit("")) == ""), "empty item"))
        return F.struct(F.when(err.isNull(), r["good"]).alias("ok"), err.alias("err"))

    def parsed(body: Column) -> Column:
        items = F.from_json(F.concat(F.lit('{"a":'), body, F.lit("}")), "a array<string>").getField("a")
        return F.struct(body.alias("body"), F.schema_of_variant(F.try_parse_json(body)).alias("kind"), items.alias("items"))

    t = text.strip(F.regexp_replace(raw, r"```(?:json)?\s*", ""))
    return let(t, lambda t: let(outermost(t), lambda b: let(parsed(b), lambda p: let(checked(p), verdict))))


def messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """The messages of JSON lines, as columns; lines that are no JSON object with a `type` or `ev` are left out."""
    parsed = lines.withColumn("__m", F.from_json(F.col(column), MESSAGE, {"mode": "PERMISSIVE"}))
    return parsed.filter("__m.type is not null or __m.ev is not null").select(*[c for c in lines.columns if c != column], "__m.*")


def encode_batch(df: DataFrame, keys: list[str], item: Column, order: str) -> DataFrame:
    """keys and `payload`: the items of a batch as one JSON array, in order, characters kept as they are."""
    rows = df.withColumn("__i", item).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "__i"))).alias("__a"))
    return rows.select(*keys, F.to_json(F.transform("__a", lambda s: s["__i"])).alias("payload"))


def training_record(df: DataFrame, split: str, source: str, body: str, answer: str, idx: str) -> DataFrame:
    """The nested record of a reinforcement sample from a flat row and its index."""
    prompt = F.array(
        F.struct(F.lit("user").alias("role"), F.col(body).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")),
    )
    return df.select(
        F.lit(source).alias("data_source"),
        prompt.alias("prompt"),
        F.lit("text-to-speech").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col(answer).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(idx).cast("bigint").alias("index"), F.col(body).alias("text")).alias("extra_info"),
    )


def decode_project(raw: Column) -> Column:
    """A project document with the defaults of missing fields."""
    doc = F.from_json(raw, PROJECT)
    names = [f.split(" ")[0] for f in PROJECT.split(", ")]
    defaults = {"name": F.lit(""), "steps": F.create_map().cast("map<string,string>"), "step_data": F.create_map().cast("map<string,string>"), "history": F.array().cast("array<struct<timestamp:string,step:string,action:string,detail:string>>")}
    return F.struct(*[(F.coalesce(doc[n], defaults[n]) if n in defaults else doc[n]).alias(n) for n in names])


def encode_project(doc: Column) -> Column:
    return F.to_json(doc, {"ignoreNullFields": "false"})


def merge_objects(first: Column, second: Column) -> Column:
    """Two maps as one; keys of the second win."""
    rest = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(rest, second)
