"""Folders of tables in the shape of the test tables: empty ones, and ones with rows of nulls, repeats and extra columns."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .oracle import DATA

#: Names that operators use for columns of their own.
CLASHING = ["at", "day", "salt", "asks", "delta", "exists", "target", "ref_key", "src_table", "label", "steps", "path", "attrs", "kind", "schema", "value", "field", "records", "n", "k", "src", "items", "item", "weight", "term", "bucket", "bit", "bitmap", "chunk", "pattern", "support", "ids", "n_tokens", "size", "part", "container", "bin", "fill", "prior", "words", "hard_share", "copies", "of", "spread", "change"]


def write(spark, folder, empty: bool) -> str:
    for name in os.listdir(DATA):
        df = spark.read.parquet(f"{DATA}/{name}")
        if empty:
            out = df.limit(0)
        else:
            nulls = df.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
            some = df.limit(40)
            out = some.unionByName(some.limit(7)).unionByName(nulls)
            extra = [c for c in CLASHING if c not in {f.lower() for f in df.columns}]
            out = out.select("*", *(F.lit(str(i)).alias(c) for i, c in enumerate(extra)))
        out.coalesce(1).write.parquet(f"{folder}/{name}")
    return str(folder)
