"""A varied subset of given size: max-sum dispersion by local search over composable core-sets.

Equal sequences are one candidate. Candidates are dealt into blocks of a bounded size; each block gives the subset
that local search finds in it (its core-set), the core-sets together are dealt again until one block is left, and the
subset of that one is the answer. The distance is the Jaccard distance of the sets of steps and of adjacent steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut
from .coding import Form, coded

#: Candidates of a block, and the share of the mean pairwise distance below which a gain is rounding noise.
BLOCK, NOISE = 4_000, 1e-9


class Distances:
    """Jaccard distances among lists of steps. row() gives those of one list to all. Lists are kept as the features that
    they share with others, and features as the lists that have them: as much as the lists themselves hold."""

    def __init__(self, lists: list[list]):
        features = [{*steps, *zip(steps, steps[1:])} for steps in lists]
        held = Counter(f for s in features for f in s)
        index = {f: i for i, f in enumerate(f for f, n in held.items() if n > 1)}  # others are shared with no list
        self.mine = [np.fromiter((index[f] for f in s if f in index), np.int64) for s in features]
        at = np.repeat(np.arange(len(lists)), list(map(len, self.mine)))
        flat = np.concatenate(self.mine) if lists else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.holders, self.begins = at[order], np.searchsorted(flat[order], np.arange(len(index) + 1))
        self.size = np.fromiter(map(len, features), np.int64, len(lists))

    def row(self, i: int) -> np.ndarray:
        sharing = [self.holders[self.begins[f] : self.begins[f + 1]] for f in self.mine[i]]
        both = np.bincount(np.concatenate(sharing), minlength=len(self.size)) if sharing else np.zeros(len(self.size), np.int64)
        either = self.size + self.size[i] - both
        out = 1 - both / np.where(either > 0, either, 1)
        out[either == 0] = 0
        out[i] = 0
        return out.astype(np.float64)


def dispersed(lists: list[list], k: int) -> list[int]:
    """The places of k lists whose sum of pairwise distances no single swap raises.
    Starts from farthest-first choice; ties go to the first place. All places when there are no more than k."""
    n = len(lists)
    if n <= k:
        return list(range(n))
    d = Distances(lists)
    chosen = [0]
    rows = [d.row(0)]
    nearest = rows[0].copy()
    taken = np.zeros(n, bool)
    taken[0] = True
    while len(chosen) < k:
        v = int(np.where(taken, -1.0, nearest).argmax())
        chosen.append(v)
        taken[v] = True
        rows.append(d.row(v))
        np.minimum(nearest, rows[-1], out=nearest)
    m = np.array(rows)
    if k < 2:
        return chosen
    while True:
        total = m.sum(0)  # of each candidate, the distances to the chosen
        worth = total[chosen]
        gain = np.where(taken, -np.inf, total)[None, :] - m - worth[:, None]
        u, v = divmod(int(gain.argmax()), n)
        if gain[u, v] <= NOISE * max(worth.sum() / (k * (k - 1)), 1e-9):
            return sorted(chosen)
        taken[chosen[u]], taken[v] = False, True
        chosen[u] = v
        m[u] = d.row(v)


def varied_subset(candidates: DataFrame, k: int, block: int = BLOCK, form: Form | None = None) -> DataFrame:
    """(domain, src, id, items, copies, spread): for each domain k sequences of candidates (domain, src, id, items) with
    a large sum of pairwise distances; spread is a sequence's mean distance to the others chosen.

    Candidates with equal items are one, standing for all of its copies, however many; of them the least (src, id) is
    named. A domain with fewer distinct sequences than k gives all of them; a null or empty sequence is a candidate
    like others. Null ids are ids. form, if given, makes a step of each item, or None; null items are no steps. Items are
    numbered before anything is shuffled. Equal rows count once. No task sees more than about `block` candidates."""
    named, names = coded(candidates.select("domain", "src", "id", "items"), "items", form)
    known = candidates.sparkSession.sparkContext.broadcast(names)
    left = cut(named.distinct().groupBy("domain", "items").agg(F.min(F.struct("src", "id")).alias("of"), F.count(F.lit(1)).alias("copies")))
    spec = left.schema
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.fields)

    def choose(t: pa.Table) -> pa.Table:
        lists = t.column("items").to_pylist()
        order = sorted(range(len(lists)), key=lists.__getitem__)
        lists = [lists[i] for i in order]
        places = dispersed(lists, k)
        d = Distances([lists[i] for i in places])
        spread = [float(d.row(i).sum()) / max(len(places) - 1, 1) for i in range(len(places))]
        out = t.drop_columns(["bucket"]).take(pa.array([order[i] for i in places], pa.int64()))
        return out.append_column("spread", pa.array(spread, pa.float64()))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("items").to_pylist()
            if known.value is not None:
                lists = [[known.value[i] for i in s] for s in lists]
            columns = list(b.columns)
            columns[b.schema.names.index("items")] = pa.array(lists, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    last = None
    while True:
        sizes = cut(left.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("domain", "d"))
        largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
        over = largest > max(block, 2 * k) and (last is None or largest < last)
        blocks = F.ceil(F.col("n") / max(block, 2 * k)) if over else F.lit(1)
        dealt = left.join(checked_broadcast(sizes), F.col("domain").eqNullSafe(F.col("d"))).select(*spec.names, F.pmod(F.xxhash64("items"), blocks).cast("int").alias("bucket"))
        picked = dealt.groupBy("domain", "bucket").applyInArrow(choose, text + ", spread double")
        if not over:
            return picked.mapInArrow(spelled, text.replace("array<int>", "array<string>") + ", spread double").select("domain", "of.src", "of.id", "items", "copies", "spread")
        last, left = largest, cut(picked.drop("spread"))
