"""Distances between sequences."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut

#: Substitution costs in hundredths for the same type and group, the same type, different types; insertions.
SAME_GROUP, SAME_TYPE, OTHER_TYPE, INDEL = 33, 66, 100, 100
#: Distinct tokens of a pair for which the built-in distance can be used.
ALPHABET = "".join(map(chr, range(0x4E00, 0x4E00 + 4000)))
#: Pairs that are computed at once.
BATCH = 4096


#: Where characters for more distinct tokens begin, and how many there are.
PLANES, MOST_TOKENS = 0x10000, 0x100000


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays, in the JVM: tokens become characters, numbered within the pair, by a table for
    up to 4,000 distinct tokens and by code points beyond. Null for a null array. A pair with more than a million
    distinct tokens, whose table of distances no machine could fill, is an error."""
    names = F.array_distinct(F.concat(a, b))
    place = lambda t: F.array_position(names, t)
    few = lambda t: F.substring(F.lit(ALPHABET), place(t).cast("int"), F.lit(1))
    many = lambda t: F.decode(F.unhex(F.lpad(F.hex(place(t) + (PLANES - 1)), 8, "0")), "UTF-32")
    spelled = lambda to: F.levenshtein(*(F.array_join(F.transform(s, to), "") for s in (a, b)))
    n = F.size(names)
    return F.when(names.isNull(), None).when(n <= len(ALPHABET), spelled(few)).when(n <= MOST_TOKENS, spelled(many)).otherwise(F.raise_error(F.lit("more than a million distinct tokens")).cast("int"))


def normalized(a: Column, b: Column) -> Column:
    """The edit distance by the longer length; 0 for two empty ones."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edit_distance(a, b) / longest)


class Costs:
    """Substitution costs from types and groups; without types every substitution costs OTHER_TYPE. Unknown tokens are
    GENERIC, GENERIC counts as READ, and a group is what stands before the first underscore unless a map has it."""

    def __init__(self, types: Mapping[str, str] | None, groups: Mapping[str, str] | None = None):
        self.types, self.groups = types, groups or {}

    def of(self, domain: str | None) -> Costs:
        return self

    def matrix(self, names: list[str]) -> np.ndarray:
        n = len(names)
        out = np.full((n, n), OTHER_TYPE, np.int32)
        if self.types is not None:
            kinds = [self.types.get(t) or "GENERIC" for t in names]
            kinds = np.array(["READ" if k == "GENERIC" else k for k in kinds], dtype=object)
            groups = np.array([self.groups.get(t, t.split("_", 1)[0]) for t in names], dtype=object)
            same = kinds[:, None] == kinds[None, :]
            out[same] = SAME_TYPE
            out[same & (groups[:, None] == groups[None, :])] = SAME_GROUP
        np.fill_diagonal(out, 0)
        return out

    def marks(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the types and of the groups of names, from which substitution() has what matrix() has; without types
        every name is a type of its own."""
        if self.types is None:
            return np.arange(len(names)), np.arange(len(names))
        numbers: tuple[dict, dict] = ({}, {})
        kinds = [self.types.get(t) or "GENERIC" for t in names]
        kinds = ["READ" if k == "GENERIC" else k for k in kinds]
        groups = [self.groups.get(t, t.split("_", 1)[0]) for t in names]
        return tuple(np.array([of.setdefault(x, len(of)) for x in marks], np.int64) for of, marks in zip(numbers, (kinds, groups)))


class DomainCosts:
    """Costs by domain, for a token may have another type elsewhere; a domain that isn't known has no types."""

    def __init__(self, types: Mapping[str | None, Mapping[str, str]]):
        self.costs = {d: Costs(t) for d, t in types.items()}

    def of(self, domain: str | None) -> Costs:
        return self.costs.get(domain) or Costs({})


class Encoded:
    """Lists of tokens as a padded matrix of numbers, with the costs among the tokens that occur."""

    def __init__(self, lists: list[list[str]], costs: Costs):
        lists = [[t for t in s if t is not None] for s in lists]  # null tokens are no steps
        names = sorted({t for s in lists for t in s})
        place = {t: i for i, t in enumerate(names)}
        self.cost = costs.matrix(names) if names else np.zeros((1, 1), np.int32)
        self.lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.codes = np.zeros((len(lists), max(int(self.lengths.max()) if len(lists) else 0, 1)), np.int32)
        for i, s in enumerate(lists):
            self.codes[i, : len(s)] = [place[t] for t in s]

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted edit distances of the lists at a to those at b, in hundredths: one dynamic program over many pairs at
        once. Pairs are taken in the order of their lengths, so that short ones don't wait for long ones."""
        out = np.zeros(len(a), np.int64)
        order = np.lexsort((self.lengths[b], self.lengths[a]))
        for at in range(0, len(a), BATCH):
            idx = order[at : at + BATCH]
            ia, ib = a[idx], b[idx]
            la, lb = self.lengths[ia], self.lengths[ib]
            ca, cb, rows = self.codes[ia], self.codes[ib], np.arange(len(idx))
            row = np.tile(np.arange(lb.max() + 1, dtype=np.int64)[:, None] * INDEL, (1, len(idx)))
            done = np.where(la == 0, row[lb, rows], -1)
            for i in range(la.max()):
                new = np.empty_like(row)
                new[0] = (i + 1) * INDEL
                sub = self.cost[ca[:, i, None], cb[:, : lb.max()]].T
                for j in range(lb.max()):
                    new[j + 1] = np.minimum(np.minimum(row[j + 1], new[j]) + INDEL, row[j] + sub[j])
                row = new
                ended = la == i + 1
                if ended.any():
                    done[ended] = row[lb[ended], rows[ended]]
            out[idx] = done
        return out


#: Texts of a sweep that share a table of gains, patterns beside each other, bytes of a row of states, of states, of a table
#: of gains, and cells of padded texts.
TEXTS, SIDE, ROW_BYTES, STATE_BYTES, GAIN_BYTES, CELLS = 1_024, 128, 1 << 17, 1 << 22, 1 << 25, 1 << 22
#: Steps by which texts are sorted.
SORTED = 32


class Swept:
    """Lists of tokens as numbers, for the distances of all of some to all of others."""

    def __init__(self, columns: list[pa.ChunkedArray], costs: Costs):
        lists = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
        n, values = len(lists), lists.flatten()
        owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        if values.null_count:  # null tokens are no steps
            owner, values = owner[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
        coded = values.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.kind, self.group = costs.marks(coded.dictionary.to_pylist())
        self.plain = costs.types is None
        self.lengths = np.bincount(owner, minlength=n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        costs_of_one = [2 * INDEL, OTHER_TYPE] if self.plain else [2 * INDEL, OTHER_TYPE, SAME_TYPE, SAME_GROUP]
        self.unit = int(np.gcd.reduce(costs_of_one))

    def padded(self, at: np.ndarray, most: int | None = None) -> np.ndarray:
        """The numbers of lists, as rows of equal length that are filled up with -1."""
        width = int(self.lengths[at].max(initial=0)) if most is None else most
        place = np.arange(width)
        inside = place < self.lengths[at][:, None]
        out = np.full(inside.shape, -1, np.int64)
        out[inside] = self.codes[(self.starts[at][:, None] + place)[inside]]
        return out

    def gains(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """What it saves to put tokens u in the place of tokens v, against taking one out and putting one in."""
        cost = np.full((len(u), len(v)), OTHER_TYPE, np.int64)
        if not self.plain:
            same = self.kind[u][:, None] == self.kind[v]
            cost[same] = SAME_TYPE
            cost[same & (self.group[u][:, None] == self.group[v])] = SAME_GROUP
        cost[u[:, None] == v] = 0
        return np.maximum(2 * INDEL - cost, 0) // self.unit

    def sweep(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in a, places in b, what is saved in units), whose blocks cover all pairs of a and b once. Places in b
        are ordered by length, then as in b.

        The weighted edit distance is INDEL for each step of both, less unit times the most that an alignment saves: a
        table of small numbers, in which padding saves nothing. Texts of a are sorted and share the rows of equal
        beginnings; patterns of b of about the same length stand side by side."""
        first = self.padded(a, SORTED)
        a = a[np.lexsort(first.T[::-1])]
        b_places = np.argsort(self.lengths[b], kind="stable")
        longest = [int(self.lengths[x].max(initial=0)) for x in (a, b)]
        many = min(TEXTS, max(1, CELLS // max(1, longest[0])))
        for at in range(0, len(a), many):
            texts = a[at : at + many]
            la, rows = self.lengths[texts], self.padded(texts)
            u = np.unique(rows[rows >= 0])
            tokens = np.searchsorted(u, rows)
            differs = rows[1:] != rows[:-1]
            shared = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1) if differs.size else 0, rows.shape[1])])
            shared[1:] = np.minimum(shared[1:], np.minimum(la[1:], la[:-1]))
            side = min(SIDE, max(1, GAIN_BYTES // max(1, 2 * len(u) * longest[1])))
            for to in range(0, len(b), side):
                patterns = b[b_places[to : to + side]]
                yield texts, patterns, self._saved(tokens, la, shared, u, patterns)

    def _saved(self, tokens: np.ndarray, la: np.ndarray, shared: np.ndarray, u: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """The most that alignments of texts with patterns save, in units. shared: steps that a text has in common with the
        one before."""
        lb, columns = self.lengths[patterns], self.padded(patterns).T
        width, n = columns.shape
        most = 2 * INDEL // self.unit * min(int(la.max(initial=0)), width)
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64
        out = np.zeros((len(la), n), kind)
        if not width or not len(u):
            return out
        v = np.unique(columns[columns >= 0])
        gain = self.gains(u, v).astype(kind).T[np.searchsorted(v, columns)]  # of places, patterns and tokens
        gain[columns < 0] = 0
        gain = np.ascontiguousarray(gain.transpose(0, 2, 1))
        at_once = max(1, min(ROW_BYTES, STATE_BYTES // (width + 1)) // (n * out.itemsize))
        for at in range(0, len(la), at_once):
            steps, ends, common = tokens[at : at + at_once], la[at : at + at_once], shared[at : at + at_once]
            node, state = np.zeros(len(ends), np.int64), np.zeros((width + 1, 1, n), kind)
            for step in range(int(ends.max())):
                alive = np.flatnonzero(ends > step)
                new = common[alive] <= step
                new[0] = True
                begin = alive[new]
                parents, step_of, row = node[begin], steps[begin, step], state
                if len(begin) > 0.8 * state.shape[1] and (np.diff(parents) > 0).all():  # one child each: rows stay where they are, few of them unused
                    step_of = np.zeros(state.shape[1], np.int64)
                    step_of[parents] = steps[begin, step]
                else:
                    row = state.take(parents, axis=1)
                    node[alive] = np.cumsum(new) - 1
                by = gain.take(step_of, axis=1)
                by += row[:-1]
                np.maximum(by, row[1:], out=row[1:])
                for j in range(2, width + 1):
                    np.maximum(row[j], row[j - 1], out=row[j])
                state = row
                if len(ended := np.flatnonzero(ends == step + 1)):
                    out[at + ended] = state[width][node[ended]]
        return out


def _summable(saved: np.ndarray, *weights: np.ndarray) -> np.ndarray:
    """A matrix of whole numbers as floats whose sums by weights are exact: single ones where they fit."""
    most = float(saved.max(initial=0)) * max(w.sum() for w in weights)
    return saved.astype(np.float32 if most < 1 << 24 else np.float64)


def _weighed(floats: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (floats @ w.astype(floats.dtype)).astype(np.int64)


def pair_distances(a: list[list[str]], b: list[list[str]], costs: Costs) -> np.ndarray:
    """Weighted edit distances of pairs of lists, in hundredths."""
    n = len(a)
    return Encoded([*a, *b], costs).distances(np.arange(n), np.arange(n, 2 * n)) if n else np.zeros(0, np.int64)


def weighted(df: DataFrame, a: str, b: str, costs: Costs | DomainCosts, to: str = "distance", by: str = "domain") -> DataFrame:
    """df with the weighted edit distance of its arrays a and b, null where one is null. One pass in Arrow batches. Costs
    of domains go by the column `by`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{to}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lb = batch.column(a).to_pylist(), batch.column(b).to_pylist()
            null = np.array([x is None or y is None for x, y in zip(la, lb)], bool)
            groups: dict = {}
            for i, g in enumerate(batch.column(by).to_pylist() if isinstance(costs, DomainCosts) else [None] * len(la)):
                groups.setdefault(g, []).append(i)
            d = np.zeros(len(la), np.int64)
            for g, at in groups.items():
                d[at] = pair_distances([la[i] or [] for i in at], [lb[i] or [] for i in at], costs.of(g))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d / 100.0, pa.float64(), mask=null)], [*batch.schema.names, to])

    return df.mapInArrow(run, schema)


def to_set(df: DataFrame, tokens: str, by: str, given: Mapping[object, list[list[str]]], costs: Costs | None = None, normalize: bool = True) -> DataFrame:
    """df with min_distance, nearest (the first place in the set on ties) and mean_distance of each sequence to the given
    set of its group. The set is a parameter, sent to the workers; rows are never paired with each other. Sequences
    without a set get nulls, for one has no distance to an empty set; so do null sequences."""
    if sum(map(len, given.values())) > MOST_GIVEN:
        raise ValueError(f"more than {MOST_GIVEN} rows in a given set; to_sets() takes any number")
    sent = df.sparkSession.sparkContext.broadcast((dict(given), costs or Costs(None)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", min_distance double, nearest int, mean_distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, cost = sent.value
        for batch in batches:
            n = batch.num_rows
            best, which, mean = np.full(n, np.nan), np.full(n, -1), np.full(n, np.nan)
            groups: dict = {}
            for i, (g, s) in enumerate(zip(batch.column(by).to_pylist(), batch.column(tokens).to_pylist())):
                if s is not None and sets.get(g):
                    groups.setdefault(g, []).append((i, s))
            for g, rows in groups.items():
                idx = np.array([i for i, _ in rows])
                total, n_rows = np.zeros(len(rows)), len(rows)
                coded = Encoded([*(s for _, s in rows), *sets[g]], cost)
                for place in range(len(sets[g])):
                    d = coded.distances(np.arange(n_rows), np.full(n_rows, n_rows + place)) / 100.0
                    if normalize:
                        longest = np.maximum(coded.lengths[:n_rows], coded.lengths[n_rows + place])
                        d = d / np.where(longest > 0, longest, 1)
                    total += d
                    closer = (which[idx] < 0) | (d < best[idx])
                    best[idx[closer]], which[idx[closer]] = d[closer], place
                mean[idx] = total / len(sets[g])
            none = which < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, mask=none), pa.array(which.astype(np.int32), mask=none), pa.array(mean, mask=none)], [*batch.schema.names, "min_distance", "nearest", "mean_distance"])

    return df.mapInArrow(run, schema)


#: Rows of a set at most, over all groups, that to_set() sends to the workers.
MOST_GIVEN = 100_000

#: Sequences of a group that one task of to_sets() compares (up to FOLD times as many where a group has over MOST_BLOCKS
#: blocks, for its set is sent once for each), and members of its set.
ROWS, FOLD, MOST_BLOCKS, PLACES = 4_000, 4, 32, 8_000


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by keys of tasks, over all cores: pairs make the work, not the few bytes by which partitions are put together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def to_sets(df: DataFrame, sets: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(domain, tokens, min_distance, nearest, mean_distance) of the distinct sequences of df (domain, tokens), to sets
    (domain, place, tokens) of any size: what to_set() gives with normalize, but blocks of sequences and of PLACES
    places meet in tasks, so that neither side goes through the driver. Equal members of a set are measured once. Null
    domains and null sequences are left out, as are domains without a set."""
    left = cut(df.select("domain", "tokens").where("domain is not null and tokens is not null").distinct().withColumn("_id", F.monotonically_increasing_id()))
    found = numbered_to_sets(left, sets, costs)
    return left.join(found, "_id").select("domain", "tokens", "min_distance", "nearest", "mean_distance")


def numbered_to_sets(left: DataFrame, sets: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(_id, min_distance, nearest, mean_distance) of distinct sequences (_id, domain, tokens) that were cut, as to_sets()
    has them: results go by number, not by sequence."""
    left = left.select("_id", "domain", "tokens").where("domain is not null and tokens is not null")
    given = sets.select("domain", F.col("place").cast("int").alias("place"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    size = F.count(F.lit(1))
    blocks = left.groupBy("domain").agg(F.greatest(F.ceil(size / (ROWS * FOLD)), F.least(F.ceil(size / ROWS), F.lit(MOST_BLOCKS))).cast("int").alias("_n"))
    blocks = checked_broadcast(cut(blocks.join(given.groupBy("domain").agg(F.floor(F.max("place") / PLACES).cast("int").alias("_last")), "domain")))
    given = given.groupBy("domain", "tokens").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("w"))
    given = given.join(blocks, "domain").withColumns({"b": F.floor(F.col("place") / PLACES).cast("int"), "a": F.explode(F.sequence(F.lit(0), F.col("_n") - 1))})
    dealt = left.join(blocks, "domain").withColumns({"a": F.pmod(F.xxhash64("tokens"), F.col("_n")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("_last")))})
    cost = costs or Costs(None)

    def measure(rows: pa.Table, places: pa.Table) -> pa.Table:
        n = rows.num_rows if places.num_rows else 0
        places = places.sort_by("place")
        place, w = (places.column(c).to_numpy() for c in ("place", "w"))
        best, which, total = np.full(n, np.inf), np.full(n, -1), np.zeros(n)
        if n:
            coded = Swept([rows.column("tokens"), places.column("tokens")], cost)
            for x, y, saved in coded.sweep(np.arange(n), np.arange(n, n + len(place))):
                la, lb = coded.lengths[x], coded.lengths[y]
                for at in np.flatnonzero(np.diff(lb, prepend=-1)):  # for patterns of one length, who saves most is nearest
                    own = slice(at, np.searchsorted(lb, lb[at], "right"))
                    longest, both, weight = np.maximum(la, lb[at]), INDEL * (la + lb[at]), w[y[own] - n]
                    per = np.where(longest > 0, longest, 1)
                    total[x] += (both * weight.sum() - coded.unit * _weighed(_summable(saved[:, own], weight), weight)) / 100.0 / per
                    most = saved[:, own].argmax(1)  # the first place of them
                    d, p = (both - coded.unit * saved[np.arange(len(x)), at + most].astype(np.int64)) / 100.0 / per, place[y[at + most] - n]
                    closer = (d < best[x]) | ((d == best[x]) & (p < which[x]))
                    best[x[closer]], which[x[closer]] = d[closer], p[closer]
        return pa.table({"_id": rows.column("_id")[:n], "best": pa.array(best), "place": pa.array(which.astype(np.int32)), "total": pa.array(total), "n": pa.array(np.full(n, w.sum(), np.int64))})

    sides = [_dealt(side, "domain", "a", "b").groupBy("domain", "a", "b") for side in (dealt.select("domain", "a", "b", "_id", "tokens"), given.select("domain", "a", "b", "place", "w", "tokens"))]
    parts = sides[0].cogroup(sides[1]).applyInArrow(measure, "_id long, best double, place int, total double, n long")
    whole = parts.groupBy("_id").agg(F.min(F.struct("best", "place")).alias("x"), (F.sum("total") / F.sum("n")).alias("mean_distance"))
    return whole.select("_id", F.col("x.best").alias("min_distance"), F.col("x.place").alias("nearest"), "mean_distance")


#: Sequences of a block of a pool.
BLOCK = 250


def all_pairs(pools: DataFrame, costs: Costs | DomainCosts) -> DataFrame:
    """(domain, i, j, distance), i < j, of pools (domain, idx, tokens): the upper triangle of each pool's matrix.

    Pools may have any size; each pair of blocks of one is a task of BLOCK by BLOCK pairs at most. The matrix grows with
    the square of a pool, which is what is asked for: a pool is a stated number of sequences. For distances of any number
    of sequences to a given set see to_set() and to_sets()."""
    kept = pools.select("domain", F.col("idx").cast("int").alias("idx"), "tokens")
    block = F.floor(F.col("idx") / BLOCK).cast("int")
    sizes = kept.groupBy("domain").agg(F.floor(F.max("idx") / BLOCK).cast("int").alias("_last")).withColumnRenamed("domain", "_d")
    placed = kept.withColumn("block", block).join(sizes, F.col("domain").eqNullSafe(F.col("_d")))
    both = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    dealt = both.select("domain", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "idx", "tokens")

    def measure(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("idx").to_pylist(), t.column("block").to_pylist(), t.column("tokens").to_pylist()), key=lambda r: r[0])
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        idx, block = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        x, y = np.triu_indices(len(rows), 1)
        use = (block[x] == a) & (block[y] == b)
        x, y = x[use], y[use]
        d = Encoded([r[2] or [] for r in rows], costs.of(t.column("domain")[0].as_py())).distances(x, y) / 100.0
        domain = pa.array([t.column("domain")[0].as_py()] * len(x), pa.string())
        return pa.table({"domain": domain, "i": pa.array(idx[x].astype(np.int32)), "j": pa.array(idx[y].astype(np.int32)), "distance": pa.array(d, pa.float64())})

    return dealt.groupBy("domain", "a", "b").applyInArrow(measure, "domain string, i int, j int, distance double")


#: Sequences of a block of a cluster: PART where that gives MOST_PARTS blocks at most, for all cores to have work, and WHOLE
#: where that gives more, for each sequence is sent once for each block.
PART, MOST_PARTS, WHOLE = 2_000, 16, 8_000


def medoid_costs(members: DataFrame, costs: Costs | DomainCosts, key: str = "cluster_key") -> DataFrame:
    """(key, tokens, cost): for each distinct sequence of a cluster (domain, key, tokens), the sum of its weighted distances
    to all of the cluster's members, copies included: the least one is the cluster's best medoid.

    Equal sequences are one, with their number as a weight. Blocks of a cluster's sequences meet in pairs, in tasks of
    WHOLE by WHOLE at most, each of which gives sums only, not pairs. Null sequences count as empty ones; null keys are none."""
    filled = F.coalesce("tokens", F.array().cast("array<string>"))
    one = members.where(F.col(key).isNotNull()).groupBy("domain", key, filled.alias("tokens")).agg(F.count(F.lit(1)).alias("w"))
    one = cut(one.withColumn("_id", F.monotonically_increasing_id()))
    size = F.count(F.lit(1))
    blocks = one.groupBy(F.col(key).alias("_k")).agg(F.greatest(F.ceil(size / WHOLE), F.least(F.ceil(size / PART), F.lit(MOST_PARTS))).cast("int").alias("_n"))
    dealt = one.join(blocks, F.col(key) == F.col("_k")).withColumn("block", F.pmod(F.xxhash64("tokens"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("domain", key, "_id", "tokens", "w", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def measure(t: pa.Table) -> pa.Table:
        block, w = t.column("block").to_numpy(), t.column("w").to_numpy()
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        cost = np.zeros(t.num_rows, np.int64)
        coded = Swept([t.column("tokens")], costs.of(t.column("domain")[0].as_py()))
        for x, y, saved in coded.sweep(left, right):
            floats = _summable(saved, w[x], w[y])
            for p, q, m in ((x, y, floats), (y, x, floats.T))[: 1 + (a != b)]:
                out = INDEL * (coded.lengths[p] * w[q].sum() + (w[q] * coded.lengths[q]).sum())
                cost[p] += out - coded.unit * _weighed(m, w[q])
        return pa.table({"_id": t.column("_id"), "cost": pa.array(cost)})

    parts = _dealt(dealt, "domain", key, "a", "b").groupBy("domain", key, "a", "b").applyInArrow(measure, "_id long, cost long")
    return parts.groupBy("_id").agg(F.sum("cost").alias("cost")).join(one, "_id").groupBy(key, "tokens").agg((F.sum("cost") / 100.0).alias("cost"))
