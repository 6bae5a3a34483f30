"""Pools of sequences and k-medoids, plain and with frozen centers.

A pool has a stated size; pools, one per domain or run, are spread over the cluster. The distance matrix of a pool of up
to POOL sequences is kept in its task; of larger ones rows are worked out when they are asked for, with the same result.
Sequences of any number are then assigned to the medoids as a given set (distance.to_set, distance.to_sets).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distance import Costs, DomainCosts, Encoded
from .ngram import _mix

#: Sequences of a pool whose matrix is kept, rows that are worked out at once, and rounds of one run.
POOL, ROWS, MAX_ROUNDS = 5_000, 500, 100


def unique_pool(attempts: DataFrame, size: int, keep=None) -> DataFrame:
    """(domain, idx, tokens): of attempts (domain, attempt, tokens) that keep (a column of tokens) lets through, the
    first `size` distinct sequences per domain, in the order of their first attempts."""
    made = attempts if keep is None else attempts.where(keep)
    first = made.groupBy("domain", "tokens").agg(F.min("attempt").alias("attempt"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("attempt")))
    return ranked.where(F.col("place") <= size).select("domain", (F.col("place") - 1).alias("idx"), "tokens")  # limited before the sort


class Rows:
    """The distances of a pool without its matrix: indexing by rows and columns works them out."""

    def __init__(self, lists: list[list[str]], costs: Costs):
        self.coded, self.n = Encoded(lists, costs), len(lists)

    def __len__(self) -> int:
        return self.n

    def between(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        x, y = (m.ravel() for m in np.meshgrid(np.asarray(rows), np.asarray(columns), indexing="ij"))
        return self.coded.distances(x, y).reshape(len(rows), len(columns)) / 100.0


class Matrix(Rows):
    """The same with the matrix kept."""

    def __init__(self, d: np.ndarray):
        self.d, self.n = d, len(d)

    def between(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.d[np.ix_(rows, columns)]


def matrix(lists: list[list[str]], costs: Costs) -> np.ndarray:
    """All distances of a pool: each pair once, mirrored."""
    out = np.zeros((len(lists), len(lists)))
    i, j = np.triu_indices(len(lists), 1)
    out[i, j] = Encoded(lists, costs).distances(i, j) / 100.0
    return out + out.T


def _draws(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) >> np.uint64(11)) / float(1 << 53)


def _to(d: Rows, columns: list[int]) -> np.ndarray:
    """The distances of all points to some."""
    return np.concatenate([d.between(np.arange(at, min(at + ROWS, len(d))), columns) for at in range(0, len(d), ROWS)]) if len(d) else np.zeros((0, len(columns)))


def init(d: np.ndarray | Rows, k: int, seed: int = 0, frozen: list[int] = (), pool: np.ndarray | None = None) -> list[int]:
    """k new medoids, each drawn with a weight of the squared distance to the nearest center so far, frozen ones
    included; the first uniformly where nothing is frozen. Only points of pool are drawn; all weights zero: uniformly
    among those left, or with frozen centers none."""
    d = d if isinstance(d, Rows) else Matrix(d)
    n = len(d)
    allowed = np.ones(n, bool) if pool is None else pool.copy()
    allowed[list(frozen)] = False
    us = _draws(seed, k)
    chosen: list[int] = []
    nearest = _to(d, list(frozen)).min(1) if len(frozen) else None
    for step in range(k):
        if not allowed.any():
            break
        weights = np.where(allowed, nearest**2 if nearest is not None else 1.0, 0.0)
        if weights.sum() <= 0:
            if len(frozen):
                break
            weights = allowed.astype(float)
        c = np.cumsum(weights)
        i = min(int(np.searchsorted(c, us[step] * c[-1], side="right")), n - 1)
        chosen.append(i)
        allowed[i] = False
        own = _to(d, [i])[:, 0]
        nearest = own if nearest is None else np.minimum(nearest, own)
    return chosen


def assign(d: np.ndarray | Rows, medoids: list[int]) -> np.ndarray:
    """The place of the nearest medoid; the first on ties."""
    return _to(d if isinstance(d, Rows) else Matrix(d), medoids).argmin(1)


def update(d: np.ndarray | Rows, labels: np.ndarray, medoids: list[int], frozen: int = 0, pool: np.ndarray | None = None, bias: np.ndarray | None = None) -> list[int]:
    """Each free medoid's best place: the member (of pool) with the least sum of distances to all members, or mean less
    bias; the first on ties. Clusters without a candidate keep their medoid; the first `frozen` ones never move."""
    d = d if isinstance(d, Rows) else Matrix(d)
    out = list(medoids)
    for c in range(frozen, len(medoids)):
        members = np.flatnonzero(labels == c)
        candidates = members if pool is None else members[pool[members]]
        if len(candidates):
            cost = np.concatenate([d.between(candidates[at : at + ROWS], members).sum(1) for at in range(0, len(candidates), ROWS)])
            if bias is not None:
                cost = cost / len(members) - bias[candidates]
            out[c] = int(candidates[cost.argmin()])
    return out


def run(d: np.ndarray | Rows, k: int, seed: int = 0, frozen: list[int] = (), pool: np.ndarray | None = None, bias: np.ndarray | None = None, max_rounds: int = MAX_ROUNDS) -> tuple[list[int], np.ndarray]:
    """(medoids, labels), frozen ones first; ends when the set of medoids repeats. Without frozen centers this is plain
    k-medoids."""
    medoids = [*frozen, *init(d, k, seed, frozen, pool)]
    if not medoids:
        return [], np.zeros(len(d), int)
    for _ in range(max_rounds):
        new = update(d, assign(d, medoids), medoids, len(frozen), pool, bias)
        if set(new) == set(medoids):
            break
        medoids = new
    return medoids, assign(d, medoids)


def k_medoids(pools: DataFrame, k: int, costs: Costs | DomainCosts, seed: int = 0, bias: float = 0.0) -> DataFrame:
    """(domain, idx, tokens, cluster_idx, medoid_idx, distance) of pools (domain, idx, tokens, is_frozen).

    One pool per domain. Rows with is_frozen keep their place as centers; clusters of frozen centers aren't given, and
    new ones are numbered from 0. bias takes that much of a sequence's share of WRITE actions off its mean distance.
    A pool of any size is taken by one task, whose memory is bounded. One with fewer points than k where others are
    frozen is an error."""
    kind = pools.schema["idx"].dataType.simpleString()

    def cluster(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        lists, idx, is_frozen = t.column("tokens").to_pylist(), t.column("idx").to_pylist(), np.array(t.column("is_frozen").to_pylist(), bool)
        own = costs.of(t.column("domain")[0].as_py())
        frozen = [int(i) for i in np.flatnonzero(is_frozen)]
        if frozen and len(lists) - len(frozen) < k:
            raise ValueError("fewer sequences than clusters")
        d = Matrix(matrix(lists, own)) if len(lists) <= POOL else Rows(lists, own)
        writes = None
        if bias and own.types is not None:
            writes = bias * np.array([sum(own.types.get(x) == "WRITE" for x in s) / len(s) if s else 0.0 for s in lists])
        medoids, labels = run(d, k, seed, frozen, ~is_frozen if frozen else None, writes)
        keep = [i for i in range(len(lists)) if labels[i] >= len(frozen) and not is_frozen[i]]
        return pa.table({"domain": t.column("domain").take(pa.array(keep, pa.int64())), "idx": pa.array([idx[i] for i in keep], t.column("idx").type), "tokens": t.column("tokens").take(pa.array(keep, pa.int64())), "cluster_idx": pa.array([int(labels[i]) - len(frozen) for i in keep], pa.int32()), "medoid_idx": pa.array([idx[medoids[labels[i]]] for i in keep], t.column("idx").type), "distance": pa.array([float(d.between([i], [medoids[labels[i]]])[0, 0]) for i in keep], pa.float64())})

    return pools.select("domain", "idx", "tokens", "is_frozen").groupBy("domain").applyInArrow(cluster, f"domain string, idx {kind}, tokens array<string>, cluster_idx int, medoid_idx {kind}, distance double")


def assemble(members: DataFrame) -> DataFrame:
    """(domain, cluster_idx, medoid_idx, members): members ordered by distance, then by idx."""
    m = F.array_sort(F.collect_list(F.struct("distance", "idx", "tokens")))
    return members.groupBy("domain", "cluster_idx", "medoid_idx").agg(m.alias("members"))


def splice(clusters: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """clusters with the rows of replacements in the place of those of the same keys."""
    return clusters.join(replacements.select(*keys), keys, "left_anti").unionByName(replacements.select(*clusters.columns))
