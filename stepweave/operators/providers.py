"""Verdicts on sequences from pluggable providers: rules, recorded verdicts, or a user's function.

A provider takes rows with tokens and gives them back with valid, reason and bad_idx. Nothing here calls a model or a
simulator; what those said can be joined from a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import clean_indices, rubric

Provider = Callable[[DataFrame], DataFrame]


def by_rules(vocabulary: DataFrame, **options) -> Provider:
    """The deterministic rubric, with the names known in a row's domain (one small row per domain)."""
    known = vocabulary.groupBy(F.col("domain").alias("_d")).agg(F.collect_set("token").alias("_known"))

    def judge(df: DataFrame) -> DataFrame:
        joined = df.join(known, F.col("domain").eqNullSafe(F.col("_d")), "left").withColumn("_v", rubric(F.col("tokens"), F.coalesce("_known", F.array().cast("array<string>")), **options))
        return joined.select(*df.columns, F.coalesce("_v.valid", F.lit(False)).alias("valid"), F.col("_v.reason").alias("reason"), F.coalesce("_v.bad_idx", F.array().cast("array<int>")).alias("bad_idx"))

    return judge


def by_table(recorded: DataFrame) -> Provider:
    """Verdicts recorded as (tokens, valid, reason, bad_idx), one per tokens; an empty sequence is valid, one without a
    verdict isn't. Indices are cut to those within the sequence."""
    r = recorded.select(F.col("tokens").alias("_t"), "valid", "reason", F.col("bad_idx").alias("_i")).dropDuplicates(["_t"])

    def judge(df: DataFrame) -> DataFrame:
        joined = df.join(r, F.col("tokens") == F.col("_t"), "left")
        empty = F.size("tokens") == 0
        return joined.select(*df.columns, F.when(empty, True).otherwise(F.coalesce("valid", F.lit(False))).alias("valid"), F.when(~empty, F.coalesce("reason", F.when(F.col("_t").isNull(), "no verdict"))).alias("reason"), clean_indices(F.coalesce("_i", F.array().cast("array<double>")), F.col("tokens")).alias("bad_idx"))

    return judge


def by_function(function: Callable[[list[list[str]]], list[tuple[bool, str | None, list[int]]]]) -> Provider:
    """A user's function of a batch of sequences, run in Arrow batches."""

    def judge(df: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", valid boolean, reason string, bad_idx array<int>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = function([s or [] for s in b.column("tokens").to_pylist()])
                v, r, i = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.bool_()), pa.array(r, pa.string()), pa.array(i, pa.list_(pa.int32()))], [*b.schema.names, "valid", "reason", "bad_idx"])

        return df.mapInArrow(run, schema)

    return judge


def ladder(rungs: list[tuple[str, Callable[[DataFrame], DataFrame]]], entries: DataFrame) -> DataFrame:
    """entries with rung and evolved: each rung's function gives the entries that are left a success column, and those that
    succeed keep its result; what no rung settles stays as it was, with rung `original` and evolved false. A rung may
    itself be with_retries(). What has been settled isn't computed again."""
    from ..session import cut

    left, out = entries, None
    for name, attempt in rungs:
        tried = cut(attempt(left))
        done = tried.where("success").select(*entries.columns, F.lit(name).alias("rung"), F.lit(True).alias("evolved"))
        out = done if out is None else out.unionByName(done)
        left = tried.where("not success").select(*entries.columns)
    rest = left.select("*", F.lit("original").alias("rung"), F.lit(False).alias("evolved"))
    return rest if out is None else out.unionByName(rest)


def with_retries(attempt: Callable[[DataFrame, int], DataFrame], repair: Callable[[DataFrame, int], DataFrame], entries: DataFrame, patches: int = 3) -> DataFrame:
    """The state machine of validation with patches over whole tables: attempt() gives entries a success column;
    those that failed are repaired and tried again, up to `patches` times. Returns all rows with retries_used. What has
    been settled isn't computed again."""
    from ..session import cut

    tried = cut(attempt(entries, 0).withColumn("retries_used", F.lit(0)))
    done = []
    for k in range(1, patches + 1):
        done.append(tried.where("success"))
        failed = tried.where("not success").drop("success", "retries_used")
        if not failed.limit(1).count():
            break
        tried = cut(attempt(repair(failed, k), k).withColumn("retries_used", F.lit(k)))
    else:
        done.append(tried.where("success"))
    out = tried.where("not success")
    for d in done:
        out = out.unionByName(d)
    return out
