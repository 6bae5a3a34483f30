from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np

from stepweave.llm import pairs as A
from stepweave.llm import terms as T
from stepweave.llm.coding import name_form

TERMS = "domain string, seq_id long, terms array<string>, bit int, n int, bucket string"
BASKETS = "src string, domain string, items array<string>, n int, weight string"


def test_terms_against_counting(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["x", "y", None]), i * 9_973, [rnd.choice(["a", "b", "c", "d", None, "rare" if i == 5 else "a"]) for _ in range(rnd.randint(0, 6))] if i % 11 else None, 0, 0, "") for i in range(300)]
    vocabulary = spark.createDataFrame([("x", "a"), ("x", "never"), ("empty", "never"), (None, None)], "domain string, term string")
    got = {(r.domain, r.term): (r.total, r.n_records, r.n, r.mark) for r in T.term_frequencies(T.term_bitmaps(spark.createDataFrame(data + data[:20], TERMS)), vocabulary).collect()}
    want = {("x", "never"): (0, 0, sum(r[0] == "x" for r in data), "rare"), ("empty", "never"): (0, 0, 0, "rare")}
    for dom in ("x", "y", None):
        n = sum(r[0] == dom for r in data)
        total = Counter(t for r in data if r[0] == dom for t in r[2] or [] if t is not None)
        held = Counter(t for r in data if r[0] == dom for t in {*(r[2] or [])} if t is not None)
        want |= {(dom, t): (total[t], k, n, "rare" if k < 3 else "common" if 2 * k > n else None) for t, k in held.items()}
    assert got == want


def test_bitmaps_hold_the_records(spark):
    df = spark.createDataFrame([("x", i, ["t"] * 3, 0, 0, "") for i in (1, 2, 40_000)] + [("x", None, ["t"], 0, 0, "")] * 2, TERMS)
    rows = T.term_bitmaps(df).where("term = 't'").collect()
    assert sorted((r.n, r.occurrences) for r in rows) == [(1, 1), (3, 9)]
    assert sorted(T.unpack(r.ids, r.more)[0].tolist() for r in rows if r.bucket == 0) == [[1, 2, 40_000]]
    assert T.term_frequencies(T.term_bitmaps(spark.createDataFrame([], TERMS))).count() == 0


def test_containers_come_back_and_unite():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, T.DENSE - 1, T.DENSE, 60_000):
        low = np.sort(rnd.choice(1 << T.BITS, n, replace=False))
        times = rnd.integers(1, 4, n)
        size, total, ids, more = T.pack(low, times)
        back = T.unpack(ids, more)
        assert (size, total) == (n, times.sum()) and (back[0] == low).all() and (back[1] == times).all() and len(ids) <= 8192
        parts = [T.pack(low[i::3], times[i::3])[2:] for i in range(3)]
        assert T.union([*parts, parts[0]]) == (size, total, ids, more) == T.union([T.union(parts[:2])[2:], parts[2]])


def test_parts_merged_in_any_grouping_give_the_same(spark, rows, monkeypatch):
    rnd = random.Random(5)
    data = [("x", rnd.randrange(200_000), [rnd.choice("abc") for _ in range(rnd.randint(0, 5))], 0, 0, "") for _ in range(900)]
    data += data[:300]
    part = lambda r: T.term_bitmaps(spark.createDataFrame(r, TERMS))
    want = rows(part(data))
    a, b, c = (part(data[i::3]) for i in range(3))
    assert rows(T.merged(a.unionByName(T.merged(b.unionByName(c))))) == rows(T.merged(a.unionByName(b).unionByName(c))) == want
    monkeypatch.setattr(T, "UNITED", 2)
    monkeypatch.setattr(T, "GATHERED", 100)
    assert rows(part(data)) == want


def test_forms_and_records_that_differ(spark):
    df = spark.createDataFrame([("x", 1, ["A b", "a-b", "?"], 0, 0, ""), ("x", 1, ["a_b", "C"], 0, 0, "")], TERMS)
    got = {r.term: (r.total, r.n_records, r.n) for r in T.term_frequencies(T.term_bitmaps(df, name_form)).collect()}
    assert got == {"a_b": (2, 1, 1), "c": (1, 1, 1)}


def test_pairs_of_a_large_basket(spark, monkeypatch):
    monkeypatch.setattr(A, "ITEMS", 3)
    items = [f"i{k:02}" for k in range(11)]
    df = spark.createDataFrame([("s", "d", items, 0, "")] * 2 + [("s", "d", items[:3], 0, ""), ("s", "d", items[4:8], 0, "")], BASKETS)
    got = {(r.src, r.domain, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in A.pair_counts(A.collapse(df)).collect()}
    assert got == brute([tuple(r) for r in df.collect()])
    monkeypatch.setattr(A, "ITEMS", 256)
    large = spark.range(1).selectExpr("'s' src", "'d' domain", "sort_array(transform(sequence(1, 2000), x -> concat('item', x))) items", "1L weight")
    assert A._pairs(large).count() == 2000 * 1999 // 2


def brute(baskets):
    n, single, pair = Counter(), Counter(), Counter()
    for src, dom, items, *_ in baskets:
        n[src, dom] += 1
        items = sorted({*(items or [])})
        single.update((src, dom, i) for i in items)
        pair.update((src, dom, *p) for p in itertools.combinations(items, 2))
    return {k: (c, single[k[0], k[1], k[2]], single[k[0], k[1], k[3]], n[k[0], k[1]]) for k, c in pair.items()}


def test_pairs_against_brute_force_with_and_without_pruning(spark):
    rnd = random.Random(4)
    data = [("s", rnd.choice(["x", None]), sorted({rnd.choice("aaaabbbccdefghij") for _ in range(rnd.randint(0, 6))}), 0, "") for _ in range(300)] + [("s", "x", [], 0, ""), ("s", "x", None, 0, "")]
    weighted = A.collapse(spark.createDataFrame(data, BASKETS))
    key = lambda r: (r.src, r.domain, r.item_a, r.item_b)
    want = brute(data)
    all_ = A.pair_counts(weighted).collect()
    assert {key(r): (r.n_ab, r.n_a, r.n_b, r.n) for r in all_} == want and len(all_) == len(want)
    assert all(abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9 for r in all_)
    assert all((r.conviction is None) == (r.n_a == r.n_ab) for r in all_)
    some = A.pair_counts(weighted, min_count=5, min_share=20).collect()
    assert {key(r): (r.n_ab, r.n_a, r.n_b, r.n) for r in some} == {k: v for k, v in want.items() if v[0] >= 5 and v[0] * 20 >= v[3]}


def test_baskets_of_rows(spark, rows):
    df = spark.createDataFrame([("s", "d", "t", 1, "b"), ("s", "d", "t", 1, "a"), ("s", "d", "t", 1, "a"), ("s", "d", "t", 2, None), ("s", None, None, None, "z")], "src string, domain string, task_id string, trial int, item string")
    assert rows(A.baskets_of_rows(df, ["task_id", "trial"])) == sorted([("s", "d", ["a", "b"]), ("s", "d", []), ("s", None, ["z"])], key=repr)
    assert A.pair_counts(A.collapse(spark.createDataFrame([], BASKETS)), 5, 200).count() == 0
