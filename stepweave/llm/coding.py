"""Names as numbers, before anything is shuffled.

Names repeat endlessly, so their canonical form is worked out once per distinct spelling of an Arrow batch, and sequences
travel as small numbers instead of texts. Numbers are in the order of the names, so that sorting means the same for both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Form = Callable[[str], "str | None"]
#: Distinct names up to which they are numbered; with more, names travel as they are.
MOST_NAMES = 200_000


@lru_cache(100_000)
def name_form(name: str) -> str | None:
    """functions.text.name_form of one text."""
    return re.sub("[^a-z]+", "_", name.lower()).strip("_") or None


def formed(lists: pa.Array, form: Form | None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, names, lengths) of an array of lists of texts: the distinct forms in no order, the place of each element's
    form among them (-1 for null and what has no form), and the length of each list, 0 for null."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    place: dict[str, int] = {}
    to = [-1 if x is None or (f := x if form is None else form(x)) is None else place.setdefault(f, len(place)) for x in flat.dictionary.to_pylist()]
    index = pc.fill_null(flat.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array([*to, -1], np.int64)[index], list(place), lengths


def names_of(df: DataFrame, column: str, form: Form | None = None, most: int = MOST_NAMES) -> list[str] | None:
    """The distinct forms of the texts in an array column, sorted; None where there are more than `most`. Each batch gives
    its own distinct forms, so what is shuffled and collected grows with names, not with rows."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            _, names, _ = formed(b.column(0), form)
            new = [n for n in names if n not in seen]
            if len(seen) < most:
                seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], ["name"])

    found = df.select(F.col(column).alias("items")).mapInArrow(distinct, "name string").distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted(r.name for r in found)


def coded(df: DataFrame, column: str, form: Form | None = None, most: int = MOST_NAMES) -> tuple[DataFrame, list[str] | None]:
    """df with an array column of texts as numbers of their forms, and the names by number; texts without a form are left
    out, a null list is an empty one. With more than `most` names the forms themselves take their place, and names is
    None. One pass for the names, one for the numbers."""
    names = names_of(df, column, form, most)
    sent = df.sparkSession.sparkContext.broadcast(names)
    kind = "string" if names is None else "int"
    spec = ", ".join(f"`{f.name}` " + (f"array<{kind}>" if f.name == column else f.dataType.simpleString()) for f in df.schema.fields)
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None if sent.value is None else {n: i for i, n in enumerate(sent.value)}
        for b in batches:
            codes, forms, lengths = formed(b.column(place), form)
            kept = codes >= 0
            rows = np.repeat(np.arange(len(lengths)), lengths)[kept]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lengths)))]).astype(np.int32))
            if number is None:
                flat = pa.array(forms, pa.string()).take(pa.array(codes[kept]))
            else:
                flat = pa.array(np.array([*(number[f] for f in forms), -1], np.int32)[codes[kept]])
            columns = list(b.columns)
            columns[place] = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, spec), names
