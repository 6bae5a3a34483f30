"""JSON found in text, template marks, and differences of documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A template's mark, and commas before a closing bracket (fixed values).
TEMPLATE, TRAILING_COMMA = r"\{[a-zA-Z_][a-zA-Z0-9_]*\}", r",(\s*[\]}])"


def extract_json(text: Column) -> Column:
    """The JSON in a response as text, or null: what stands in a fence (or all, trimmed), as it is or without commas
    before closing brackets, else from the first { to the last }, likewise."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    body = F.trim(F.coalesce(fenced, text))
    inner = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    tries = [body, F.regexp_replace(body, TRAILING_COMMA, "$1"), inner, F.regexp_replace(inner, TRAILING_COMMA, "$1")]
    return F.coalesce(*(F.to_json(F.try_parse_json(t)) for t in tries))


def parse_stage(text: Column) -> Column:
    """Which try of a JSON text parses: 1 as it is, 2 without trailing commas, 0 none; null for null."""
    return F.when(text.isNull(), None).when(F.try_parse_json(text).isNotNull(), 1).when(F.try_parse_json(F.regexp_replace(text, TRAILING_COMMA, "$1")).isNotNull(), 2).otherwise(0)


def template_marks(text: Column) -> Column:
    """All {name} marks left in a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({TEMPLATE})"), 1)


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def clear_fields(record: Column, names: list[str]) -> Column:
    """A struct with fields set to null."""
    for n in names:
        record = record.withField(n, F.lit(None))
    return record


def leaves(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., path, value) of every scalar of a JSON column, nulls and empty containers included, with paths like
    $.a[0]; what doesn't parse has none."""
    kept = df.select(*keys, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", path string, value string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                try:
                    todo = [("$", json.loads(text))] if text is not None else []
                except (ValueError, RecursionError):
                    continue
                while todo:
                    path, v = todo.pop()
                    if isinstance(v, dict) and v:
                        todo.extend((f"{path}.{k}", x) for k, x in v.items())
                    elif isinstance(v, list) and v:
                        todo.extend((f"{path}[{k}]", x) for k, x in enumerate(v))
                    else:
                        at.append(i)
                        paths.append(path)
                        values.append(json.dumps(v, ensure_ascii=False, separators=(",", ":")))
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(idx) for k in keys), pa.array(paths, pa.string()), pa.array(values, pa.string())], [*keys, "path", "value"])

    return kept.mapInArrow(walk, schema)


def deep_diff(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., path, change, old_value, new_value): the scalars that were added, removed or changed between documents
    of the same keys."""
    o = leaves(old, keys, column).withColumnRenamed("value", "old_value")
    n = leaves(new, keys, column).withColumnRenamed("value", "new_value")
    both = o.join(n, [*keys, "path"], "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return both.select(*keys, "path", F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed").alias("change"), "old_value", "new_value")
