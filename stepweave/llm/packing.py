"""Filling fixed-capacity containers, by sum-of-squares packing.

Each item goes where the sum, over all residual gaps, of the squared number of open containers with that gap becomes
smallest. Items are packed in groups of a bounded size; containers that a group leaves with too much room are opened
again and their items packed together with those of other groups, until one group is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items packed by one task, and the fill in percent from which a container stays closed.
GROUP, CLOSED = 20_000, 99


class SumOfSquares:
    """An open packing of containers of one capacity. place() gives the container of an item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # containers per gap; full ones and those of gap 0 don't count
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        c = self.capacity
        if size <= 0:
            if not self.made:
                self._put(0, c)
                self.made = 1
            return 0
        gaps = np.arange(size, c)
        best, gain = c, (2 * self.open[c - size] + 1) if size < c else 0
        have = gaps[self.open[size:c] > 0]
        if len(have):
            left = have - size
            change = np.where(left > 0, 2 * self.open[left] + 2, 1) - 2 * self.open[have]
            k = int(np.argmin(change))  # of equal ones, the container with the least gap
            if change[k] <= gain:
                best = int(have[k])
        if best < c:
            i = self.by_gap[best].pop()
            self.open[best] -= 1
        elif self.by_gap[c]:
            i = self.by_gap[c].pop()
        else:
            i = self.made
            self.made += 1
        self._put(i, best - size)
        return i

    def _put(self, i: int, gap: int) -> None:
        if gap:
            self.by_gap[gap].append(i)
            if gap < self.capacity:
                self.open[gap] += 1


def _pack_groups(items: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    schema = items.schema
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", bin bigint, fill bigint"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        t = t.sort_by([("size", "descending"), *((k, "ascending") for k in keys)])
        packing = SumOfSquares(capacity)
        sizes = t.column("size").to_numpy()
        bins = np.fromiter((packing.place(int(s)) for s in sizes), np.int64, len(sizes))
        fill = np.zeros(max(packing.made, 1), np.int64)
        np.add.at(fill, bins, sizes)
        t = t.append_column("bin", pa.array(bins)).append_column("fill", pa.array(fill[bins]))
        yield from t.to_batches()

    return items.groupBy("group").applyInArrow(pack, spec)


def fill_containers(sizes: DataFrame, capacity: int, id_column: str = "doc_id", group: int = GROUP, closed: int = CLOSED) -> DataFrame:
    """(id_column, part, start, size, container, fill) of sizes (id_column, size).

    An item larger than the capacity is cut into full containers and a rest; no other is split. part counts the parts
    of an item from 0, start is where a part begins in it. Items of size 0, and null or negative sizes, which count as
    0, get a container too and take no room. Repeated ids are items of their own. container names a container; fill is
    the sum of its sizes. Every task packs at most about `group` items, whatever
    the sizes or ids are, as groups are drawn by row; a round opens
    less than half as many items as the last or ends the search. An empty input gives an empty result."""
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0))
    items = sizes.select(id_column, size.alias("whole"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)).cast("int"))
    pieces = items.withColumn("part", F.explode(parts)).select(id_column, "part", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.col("whole") - F.col("part").cast("long") * capacity, F.lit(capacity).cast("long")).alias("size"))
    pieces = cut(pieces.withColumn("nr", F.monotonically_increasing_id()))
    full = pieces.where(F.col("size") == capacity).select(id_column, "part", "start", "size", F.concat_ws("-", F.lit("full"), "nr").alias("container"), F.col("size").alias("fill"))
    done, left, round_no = [cut(full)], pieces.where(F.col("size") < capacity), 0
    n, last = left.count(), None
    while n:
        groups = max(1, -(-n // group))
        spread = F.pmod(F.xxhash64("nr" if round_no == 0 else "was"), F.lit(groups)).cast("int")
        columns = left.withColumn("group", spread).select(id_column, "part", "start", "size", "group")
        packed = cut(_pack_groups(columns, capacity, ["part", "start"]).withColumn("container", F.concat_ws("-", F.lit(round_no), "group", "bin")))
        final = groups == 1 or (last is not None and n * 2 > last)
        keep = F.lit(True) if final else F.col("fill") * 100 >= closed * capacity
        done.append(packed.where(keep).select(id_column, "part", "start", "size", "container", "fill"))
        if final:
            break
        left = packed.where(~keep).withColumn("was", F.col("container"))
        last, n, round_no = n, left.count(), round_no + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
