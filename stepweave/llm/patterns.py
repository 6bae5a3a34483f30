"""Frequent subsequences with gaps, by direct sequence comparison.

Within a chunk of sequences, each sequence stands at its least k-step subsequence (its k-minimum) among those whose
first k-1 steps are frequent. With the sequences ordered by it and a threshold d, the first and the d-th entry are
compared: when they are equal that pattern is frequent and its sequences move on to their next one; when they differ,
no pattern between them can be frequent, and all sequences before the d-th move to their least subsequence from there
on, so that infrequent candidates are skipped without being counted.

Chunks have a bounded size. A pattern that reaches the threshold overall reaches its share in at least one chunk;
those that other chunks skipped are counted there by name, unless the sum of what these can still hold is too small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut
from .coding import Form, coded

#: Sequences that one task mines, and their steps; a chunk has more only where a single sequence has.
CHUNK, STEPS = 20_000, 2_000_000
END = np.iinfo(np.int64).max


class Chunk:
    """Sequences as flat arrays: of each item its places, in the order of rows and positions. Items are numbers in the
    order of the names. Beside the places stand the first and last one of each row and item: as only items that are
    frequent in the chunk are kept, that is a few numbers per step at most."""

    def __init__(self, names: list, flat: np.ndarray, lengths: np.ndarray):
        self.names, self.n = names, len(lengths)
        rows = np.repeat(np.arange(self.n), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.width = int(lengths.max()) + 1 if self.n else 1
        self.first = np.full((self.n, len(names)), self.width, np.int32)
        self.last = np.full((self.n, len(names)), -1, np.int32)
        np.minimum.at(self.first, (rows, flat), at)
        np.maximum.at(self.last, (rows, flat), at)
        order = np.argsort(flat, kind="stable")
        self.places = (rows * self.width + at)[order]
        self.begins = np.searchsorted(flat[order], np.arange(len(names) + 1))

    @classmethod
    def of(cls, items: pa.Array, least: int, only: set | None = None) -> Chunk:
        """Of an array of lists of names or numbers without nulls; those in fewer than `least` sequences are left out, as are
        those outside of `only`."""
        flat = items.flatten().dictionary_encode()
        lengths = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = flat.dictionary.to_pylist()
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        held = np.bincount(np.unique(rows * max(len(words), 1) + ids) % max(len(words), 1), minlength=len(words)) if len(ids) else np.zeros(len(words), np.int64)
        kept = sorted((w, i) for i, w in enumerate(words) if held[i] >= least and (only is None or w in only))
        new = np.full(len(words) + 1, -1)
        for k, (_, i) in enumerate(kept):
            new[i] = k
        ids = new[ids]
        use = ids >= 0
        return cls([w for w, _ in kept], ids[use], np.bincount(rows[use], minlength=len(lengths)))

    def after(self, rows: np.ndarray, ends: np.ndarray, item: int) -> np.ndarray:
        """The first place of an item after ends, in rows that have it there."""
        mine = self.places[self.begins[item] : self.begins[item + 1]]
        start = rows.astype(np.int64) * self.width
        return (mine[np.searchsorted(mine, start + ends + 1)] - start).astype(np.int32)

    def count(self, pattern: list) -> int:
        """The sequences that hold a pattern."""
        where = {w: i for i, w in enumerate(self.names)}
        rows, ends = np.arange(self.n), np.full(self.n, -1, np.int32)
        for name in pattern:
            if (item := where.get(name)) is None:
                return 0
            has = self.last[rows, item] > ends
            rows, ends = rows[has], ends[has]
            ends = self.after(rows, ends, item)
        return len(rows)


def _extend(c: Chunk, prefixes: list[tuple[tuple[int, ...], np.ndarray, np.ndarray]], d: int):
    """The frequent patterns one step longer than prefixes (sorted; pattern, rows that hold it, ends of its leftmost
    place in them), with the same, by direct comparison."""
    rows = np.unique(np.concatenate([r for _, r, _ in prefixes]))
    m, p, v = len(rows), len(prefixes), len(c.names)
    ends = np.full((p, m), -1, np.int32)
    for j, (_, r, e) in enumerate(prefixes):
        ends[j, np.searchsorted(rows, r)] = e
    last = c.last[rows]
    furthest = last.max(1)
    ends[ends >= furthest] = -1  # nothing follows there
    next_prefix = np.full((p + 1, m), p, np.int32)
    for j in range(p - 1, -1, -1):
        next_prefix[j] = np.where(ends[j] >= 0, j, next_prefix[j + 1])
    every = np.arange(m)
    key = np.full(m, END)

    def move(idx: np.ndarray, j: int, t: int) -> None:
        """Rows idx to their least pattern from prefix j and item t on."""
        if t < v:
            e = ends[j, idx]
            has = last[idx, t:] > e[:, None]
            k = has.argmax(1)
            ok = has[np.arange(len(idx)), k] & (e >= 0)
            key[idx[ok]] = j * v + t + k[ok]
            idx = idx[~ok]
        to = next_prefix[j + 1, idx]
        over = to == p
        key[idx[over]] = END
        idx, to = idx[~over], to[~over]
        if len(idx):
            key[idx] = to.astype(np.int64) * v + (last[idx] > ends[to, idx][:, None]).argmax(1)

    if m < d:
        return
    to = next_prefix[0]
    idx = every[to < p]
    key[idx] = to[idx].astype(np.int64) * v + (last[idx] > ends[to[idx], idx][:, None]).argmax(1)
    while True:
        low = np.partition(key, d - 1)
        dth, least = int(low[d - 1]), int(low[:d].min())
        if dth == END:
            return
        if least == dth:
            who = np.flatnonzero(key == least)
            j, t = divmod(least, v)
            held = rows[who]
            yield (*prefixes[j][0], t), held, c.after(held, ends[j, who], t)
            move(who, j, t + 1)
        else:
            j, t = divmod(dth, v)
            move(np.flatnonzero(key < dth), j, t)


def frequent(c: Chunk, d: int, shortest: int = 3, longest: int = 5) -> Iterator[tuple[list, int]]:
    """The patterns of shortest to longest steps in at least d sequences, with their counts. Patterns of up to two steps
    are found by counting, one first pair of steps at a time is then mined, so that memory stays that of one pair."""
    n, v = c.n, len(c.names)
    if n < d or not v:
        return
    names = c.names
    for a in range(v):
        after_a = c.last > c.first[:, a][:, None]
        held_a = np.flatnonzero(c.last[:, a] >= 0)
        if shortest <= 1 and len(held_a) >= d:
            yield [names[a]], len(held_a)
        for b in np.flatnonzero(after_a.sum(0) >= d):
            rows = np.flatnonzero(after_a[:, b])
            level = [((a, int(b)), rows, c.after(rows, c.first[rows, a], int(b)))]
            if shortest <= 2 <= longest:
                yield [names[a], names[b]], len(rows)
            for k in range(3, longest + 1):
                level = list(_extend(c, level, d))
                if not level:
                    break
                if k >= shortest:
                    for pattern, r, _ in level:
                        yield [names[i] for i in pattern], len(r)


def frequent_patterns(sequences: DataFrame, least: int = 10, share: int = 8, shortest: int = 3, longest: int = 5, chunk: int = CHUNK, form: Form | None = None, steps: int = STEPS) -> DataFrame:
    """(src, domain, pattern array<string>, support, n) of sequences (src, domain, seq_id, items array<string>).

    The result holds each ordered pattern of shortest to longest steps (steps may repeat, others may lie between) that
    at least `least` and at least one in `share` of the n sequences of its src and domain hold, with its exact
    support. A sequence counts once per seq_id, also when its items are null or empty; sequences without an id are
    told apart by their items. form, if given, makes a step of each item, or None. Null items are no steps. Null domains
    are a domain. Items are numbered before anything is shuffled. Repeated rows collapse before they are sent to chunks. One
    task mines about `chunk` sequences and `steps` steps, drawn by a hash of ids, whatever the sizes of domains are; what
    tasks return is bounded by patterns that are frequent in a chunk, not by sequences."""
    rows, names = coded(sequences.select("src", "domain", "seq_id", "items"), "items", form)
    known = sequences.sparkSession.sparkContext.broadcast(names)
    rows = rows.select("src", "domain", F.when(F.col("seq_id").isNull(), F.xxhash64("items")).otherwise(F.col("seq_id").cast("long")).alias("seq_key"), "items")
    rows = cut(rows.groupBy("src", "domain", "seq_key").agg(F.first("items").alias("items")))
    sizes = rows.groupBy("src", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("items").cast("long")).alias("steps"))
    chunks_of = F.greatest(F.ceil(F.col("n") / chunk), F.least(F.col("n"), F.ceil(F.col("steps") / steps))).alias("chunks_of")
    sizes = cut(sizes.select(F.col("src").alias("s"), F.col("domain").alias("d"), "n", chunks_of, F.greatest(F.lit(least), F.ceil(F.col("n") / share)).cast("long").alias("least")))
    mine = F.col("src").eqNullSafe(F.col("s")) & F.col("domain").eqNullSafe(F.col("d"))
    placed = rows.join(checked_broadcast(sizes), mine).select("src", "domain", F.pmod(F.xxhash64("seq_key"), F.col("chunks_of")).cast("int").alias("chunk"), "seq_key", "items", "n", "least")

    def mine_chunk(key: tuple, t: pa.Table) -> pa.Table:
        lists, size = t.column("items").combine_chunks(), t.num_rows
        n, needed = t.column("n")[0].as_py(), t.column("least")[0].as_py()
        d = -(-needed * size // n)
        found = [(None, d)]
        if size >= d:
            found += ((p if known.value is None else [known.value[i] for i in p], k) for p, k in frequent(Chunk.of(lists, d), d, shortest, longest))
        m = len(found)
        return pa.table({"src": pa.array([key[0].as_py()] * m, pa.string()), "domain": pa.array([key[1].as_py()] * m, pa.string()), "chunk": pa.array([key[2].as_py()] * m, pa.int32()), "n": pa.array([n] * m, pa.int64()), "least": pa.array([needed] * m, pa.int64()), "pattern": pa.array([p for p, _ in found], pa.list_(pa.string())), "held": pa.array([k for _, k in found], pa.int64()), "d": pa.array([d] * m, pa.int64())})

    local = cut(placed.groupBy("src", "domain", "chunk").applyInArrow(mine_chunk, "src string, domain string, chunk int, n long, least long, pattern array<string>, held long, d long"))
    keys = ["src", "domain"]
    null_safe = lambda a, b: F.col(f"{a}.src").eqNullSafe(F.col(f"{b}.src")) & F.col(f"{a}.domain").eqNullSafe(F.col(f"{b}.domain"))
    chunks = local.where("pattern is null").select(*keys, "chunk", "d")
    slack = chunks.groupBy(*keys).agg(F.sum(F.col("d") - 1).alias("slack"), F.count(F.lit(1)).alias("chunks"))
    summed = local.where("pattern is not null").groupBy(*keys, "pattern").agg(F.sum("held").alias("held"), F.sum(F.col("d") - 1).alias("counted"), F.count(F.lit(1)).alias("seen"), F.first("n").alias("n"), F.first("least").alias("least"))
    possible = cut(summed.alias("c").join(slack.alias("k"), null_safe("c", "k")).where(F.col("held") + F.col("slack") - F.col("counted") >= F.col("least")).select("c.*", "chunks"))
    open_ = possible.where(F.col("seen") < F.col("chunks"))
    todo = open_.alias("o").join(chunks.alias("k"), null_safe("o", "k")).select("o.src", "o.domain", "k.chunk", "o.pattern")
    done = local.where("pattern is not null").select(F.col("src").alias("s"), F.col("domain").alias("d_"), F.col("chunk").alias("c_"), F.col("pattern").alias("p_"))
    todo = todo.join(done, F.col("src").eqNullSafe(F.col("s")) & F.col("domain").eqNullSafe(F.col("d_")) & (F.col("chunk") == F.col("c_")) & (F.col("pattern") == F.col("p_")), "left_anti")

    def count_chunk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = right.column("pattern").to_pylist()
        counts = []
        if wanted and left.num_rows:
            number = None if known.value is None else {n: i for i, n in enumerate(known.value)}
            spelled = wanted if number is None else [[number[x] for x in p] for p in wanted]
            c = Chunk.of(left.column("items").combine_chunks(), 1, {x for p in spelled for x in p})
            counts = [c.count(p) for p in spelled]
        m = len(counts)
        return pa.table({"src": pa.array([key[0].as_py()] * m, pa.string()), "domain": pa.array([key[1].as_py()] * m, pa.string()), "pattern": pa.array(wanted[:m], pa.list_(pa.string())), "more": pa.array(counts, pa.int64())})

    more = placed.select("src", "domain", "chunk", "seq_key", "items").groupBy("src", "domain", "chunk").cogroup(todo.groupBy("src", "domain", "chunk")).applyInArrow(count_chunk, "src string, domain string, pattern array<string>, more long")
    more = more.groupBy(*keys, "pattern").agg(F.sum("more").alias("more"))
    whole = possible.alias("p").join(more.alias("m"), null_safe("p", "m") & (F.col("p.pattern") == F.col("m.pattern")), "left")
    return whole.select("p.src", "p.domain", "p.pattern", (F.col("held") + F.coalesce("more", F.lit(0))).alias("support"), "n", "least").where(F.col("support") >= F.col("least")).drop("least")
