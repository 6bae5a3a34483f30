"""How often every term occurs and in how many records, from a vertical layout of compressed bitmaps.

Record ids are cut into buckets of 65,536. A term has one container per bucket that it occurs in: the sorted low halves of
the ids, 2 bytes each, or beyond 4,095 of them a bitmap of 8 KB. Beside it stand the occurrences in parallel: 1 for each
id, but for the ids that are listed with their own counter. Every part of the input builds its own containers, no
record is ever shuffled; containers of the same term and bucket merge by union, in any grouping, and an id that several
parts hold (copies of a record) counts once, with its counter. The layout is a table that can be kept, and united with
that of later records. A term's document frequency is the sum of its containers' cardinalities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coding import Form, formed

#: The term under which the records themselves are kept; it is no name form.
ALL = ""
#: Fewer records than this make a term rare; a share above 1 in COMMON makes it common.
RARE, COMMON = 3, 2
#: Ids from which a container is a bitmap, and the bits of an id within a bucket.
DENSE, BITS = 4_096, 16
#: Postings that a task gathers before it makes containers, and containers of one term and bucket that are united at once.
GATHERED, UNITED = 2_000_000, 64

_MORE = np.dtype([("low", "<u2"), ("times", "<u4")])
_NAMES = ["domain", "term", "bucket", "n", "occurrences", "ids", "more"]
_SCHEMA = "domain string, term string, bucket long, n int, occurrences long, ids binary, more binary"


def pack(low: np.ndarray, times: np.ndarray) -> tuple[int, int, bytes, bytes | None]:
    """(n, occurrences, ids, more) of sorted distinct low halves and the occurrences of each."""
    if len(low) < DENSE:
        ids = low.astype("<u2").tobytes()
    else:
        bits = np.zeros(1 << BITS, bool)
        bits[low] = True
        ids = np.packbits(bits, bitorder="little").tobytes()
    often = np.flatnonzero(times > 1)
    more = np.zeros(len(often), _MORE)
    more["low"], more["times"] = low[often], times[often]
    return len(low), int(times.sum()), ids, more.tobytes() if len(often) else None


def unpack(ids: bytes, more: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted low halves of a container and the occurrences of each."""
    if len(ids) < 2 * DENSE:
        low = np.frombuffer(ids, "<u2").astype(np.int64)
    else:
        low = np.flatnonzero(np.unpackbits(np.frombuffer(ids, np.uint8), bitorder="little"))
    times = np.ones(len(low), np.int64)
    if more:
        m = np.frombuffer(more, _MORE)
        times[np.searchsorted(low, m["low"])] = m["times"]
    return low, times


def union(containers: list[tuple[bytes, bytes | None]]) -> tuple[int, int, bytes, bytes | None]:
    """One container of several: an id that more than one holds counts once, with its largest counter."""
    low, times = (np.concatenate(x) for x in zip(*(unpack(*c) for c in containers)))
    order = np.lexsort((times, low))
    low, times = low[order], times[order]
    last = np.ones(len(low), bool)
    last[:-1] = low[1:] != low[:-1]
    return pack(low[last], times[last])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)


def _by_content(domain: str | None, terms: list[str]) -> int:
    """The id of a record without one; below zero."""
    h = hashlib.blake2b("\x00".join([domain or "", *terms]).encode(), digest_size=8).digest()
    return -1 - (int.from_bytes(h, "little") >> 1)


def merged(layout: DataFrame) -> DataFrame:
    """A layout whose containers of the same term and bucket are united. Only containers are shuffled; a task holds at most
    UNITED of one term and bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def closed():
            if len(held) == 1:
                return (*key, *held[0])
            return (*key, *union([h[2:] for h in held]))

        for b in batches:
            out = []
            for d, t, k, n, times, ids, more in zip(*(c.to_pylist() for c in b.columns)):
                if (d, t, k) != key:
                    if held:
                        out.append(closed())
                    key, held = (d, t, k), []
                elif len(held) >= UNITED:
                    held = [closed()[3:]]
                held.append((n, times, ids, more))
            yield _batch(out)
        if held:
            yield _batch([closed()])

    by = ["domain", "term", "bucket"]
    return layout.select(*_NAMES).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _SCHEMA)


def term_bitmaps(records: DataFrame, form: Form | None = None) -> DataFrame:
    """The vertical layout (domain, term, bucket, n, occurrences, ids, more) of records (domain, seq_id, terms
    array<string>): n is the cardinality of the container ids, occurrences the sum of its counters.

    form, if given, makes a term of each element, or None. A record that is repeated counts once; rows of one id that
    differ are one record, with the terms of all. Records without an id are told apart by their content. Null terms are
    none; a null or empty array is a record without terms. The term ALL has all records. Records stay where they are: a
    domain or a term with most of the rows is spread over the parts of the input and over its buckets."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {ALL: 0}
        domains: dict[str | None, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            where, term, ids, times = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((times, ids, term, where))
            where, term, ids, times = where[order], term[order], ids[order], times[order]
            change = (where[1:] != where[:-1]) | (term[1:] != term[:-1])
            last = np.append(change | (ids[1:] != ids[:-1]), True)
            where, term, ids, times = where[last], term[last], ids[last], times[last]
            bucket = ids >> BITS
            begins = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (term[1:] != term[:-1]) | (bucket[1:] != bucket[:-1])))
            low, names, places, out = ids & ((1 << BITS) - 1), list(numbers), list(domains), []
            for s, e in zip(begins, [*begins[1:], len(ids)]):
                out.append((places[where[s]], names[term[s]], int(bucket[s]), *pack(low[s:e], times[s:e])))
            parts.clear()
            return _batch(out)

        for b in batches:
            if not b.num_rows:
                continue
            codes, names, lengths = formed(b.column("terms"), form)
            where = np.array([domains.setdefault(d, len(domains)) for d in b.column("domain").to_pylist()], np.int64)
            ids = b.column("seq_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not known.all():
                ends = np.cumsum(lengths)
                for i in np.flatnonzero(~known):
                    ids[i] = _by_content(b.column("domain")[int(i)].as_py(), [names[c] for c in codes[ends[i] - lengths[i] : ends[i]] if c >= 0])
            to = np.array([numbers.setdefault(n, len(numbers)) for n in names] + [0], np.int64)
            row, use = np.repeat(np.arange(len(ids)), lengths), codes >= 0
            if ALL in names:
                use &= codes != names.index(ALL)
            pair, times = np.unique(row[use] * len(numbers) + to[codes[use]], return_counts=True)
            row, term = np.divmod(pair, len(numbers))
            parts.append((np.concatenate([where, where[row]]), np.concatenate([np.zeros(len(ids), np.int64), term]), np.concatenate([ids, ids[row]]), np.concatenate([np.ones(len(ids), np.int64), times])))
            size += len(ids) + len(term)
            if size >= GATHERED:
                yield flush()
                size = 0
        if parts:
            yield flush()

    built = records.select("domain", F.col("seq_id").cast("long").alias("seq_id"), "terms").mapInArrow(build, _SCHEMA)
    return merged(built)


def term_frequencies(bitmaps: DataFrame, vocabulary: DataFrame | None = None, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(domain, term, total, n_records, n, mark) per term of the bitmaps and of the vocabulary (domain, term); mark is
    `rare`, `common` or null. n is the number of the domain's records. Vocabulary terms that no record holds have
    zeros, also in a domain without records. A null domain is a domain of its own."""
    counts = bitmaps.select("domain", "term", "occurrences", F.col("n").cast("long").alias("held"))
    if vocabulary is not None:
        zero = F.lit(0).cast("long")
        counts = counts.unionByName(vocabulary.where(F.col("term").isNotNull()).select("domain", "term", zero.alias("occurrences"), zero.alias("held")))
    per_term = counts.groupBy("domain", "term").agg(F.sum("occurrences").alias("total"), F.sum("held").alias("n_records"))
    sizes = per_term.where(F.col("term") == ALL).select(F.col("domain").alias("d"), F.col("n_records").alias("n"))
    joined = per_term.where(F.col("term") != ALL).join(sizes, F.col("domain").eqNullSafe(F.col("d")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mark = F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") * common > F.col("n"), "common")
    return joined.select("domain", "term", "total", "n_records", "n", mark.alias("mark"))
