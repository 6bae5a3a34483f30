from __future__ import annotations

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepweave.llm import patterns as P
from stepweave.llm.coding import coded

SCHEMA = "src string, domain string, seq_id long, items array<string>, n int, pattern string, chunk int"


def brute(lists, d, shortest=3, longest=5):
    count = Counter()
    for s in lists:
        s = [x for x in s or [] if x is not None]
        count.update({p for k in range(shortest, longest + 1) for p in itertools.combinations(s, k)})
    return {p: c for p, c in count.items() if c >= d}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=8), min_size=1, max_size=25), st.integers(1, 6), st.sampled_from([(3, 5), (1, 3), (2, 4), (3, 3)]))
def test_chunk_against_brute_force(lists, d, lengths):
    chunk = P.Chunk.of(pa.array(lists, pa.list_(pa.string())), d)
    found = list(P.frequent(chunk, d, *lengths))
    assert len({tuple(p) for p, _ in found}) == len(found)
    assert {tuple(p): c for p, c in found} == brute(lists, d, *lengths)
    assert all(chunk.count(p) == c for p, c in found)


@pytest.mark.parametrize("chunk", [20_000, 60])
def test_chunks_add_up_to_the_whole(spark, chunk):
    rnd = random.Random(2)
    data = [("m", rnd.choice(["x", "y", None]), i, [rnd.choice(["a", "b", "c", "d", None]) for _ in range(rnd.randint(0, 16))] if i % 17 else None, 0, "", 0) for i in range(400)]
    data += data[:50] + [("m", "few", 1000 + i, ["a", "b", "c"], 0, "", 0) for i in range(9)] + [("m", "ten", 2000 + i, ["a", "b", "c"], 0, "", 0) for i in range(10)]
    got = P.frequent_patterns(spark.createDataFrame(data, SCHEMA), chunk=chunk).collect()
    want = {}
    for dom in {r[1] for r in data}:
        seqs = {r[2]: r[3] for r in data if r[1] == dom}
        n = len(seqs)
        want |= {("m", dom, p): (c, n) for p, c in brute(seqs.values(), max(10, -(-n // 8))).items()}
    assert {(r.src, r.domain, tuple(r.pattern)): (r.support, r.n) for r in got} == want and len(got) == len(want) and len(want) > 50


def test_memory_of_one_long_sequence_and_of_many_rare_names():
    import tracemalloc

    short = [["a", "b", "c"]] * 3_000
    rare = [["a", "b", "c", *(f"r{i}_{k}" for k in range(5))] for i in range(20_000)]
    for lists, most in ((short + [["a", "b"] * 25_000], 60), (rare, 120)):
        array = pa.array(lists, pa.list_(pa.string()))
        tracemalloc.start()
        d = len(lists) // 8
        found = {tuple(p): n for p, n in P.frequent(P.Chunk.of(array, d), d)}
        counted = P.Chunk.of(array, 1, {"a", "b"}).count(["a", "b", "a"])
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most and found["a", "b", "c"] >= len(lists) - 1 and counted == (len(lists) == 3_001)


def test_chunks_are_bounded_by_steps_and_names_may_be_many(spark, monkeypatch):
    rnd = random.Random(3)
    data = [("m", "x", i, [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))], 0, "", 0) for i in range(150)]
    want = {p: c for p, c in brute([r[3] for r in data], 19).items()}
    for most in (200_000, 3):
        monkeypatch.setattr(P, "coded", lambda df, column, form, most=most: coded(df, column, form, most))
        got = P.frequent_patterns(spark.createDataFrame(data, SCHEMA), steps=300)
        assert {tuple(r.pattern): r.support for r in got.collect()} == want != {}


def test_empty_null_and_long(spark):
    assert P.frequent_patterns(spark.createDataFrame([], SCHEMA)).count() == 0
    no_id = [(None, None, None, ["a"] * i, 0, "", 0) for i in range(12)] * 2
    assert [tuple(r) for r in P.frequent_patterns(spark.createDataFrame(no_id, SCHEMA), least=9).select("pattern", "support", "n").collect()] == [(["a"] * 3, 9, 12)]
    long = [("m", "d", i, ["a"] * 20_000 + ["b"], 0, "", 0) for i in range(10)]
    assert P.frequent_patterns(spark.createDataFrame(long, SCHEMA)).count() == 6
