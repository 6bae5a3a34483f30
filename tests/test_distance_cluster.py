from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepweave.operators import cluster as C
from stepweave.operators import distance as D
from stepweave.operators import lengths as L
from stepweave.operators import select as V

TYPES = {"get_a": "READ", "get_b": "READ", "find_c": "READ", "put_d": "WRITE", "put_e": "WRITE", "calc": "GENERIC"}
words = st.lists(st.sampled_from([*TYPES, "new_f"]), max_size=7)


def slow(a, b, costs):
    names = sorted({*a, *b})
    m = costs.matrix(names) if names else None
    t = [[100 * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 100, t[i][j - 1] + 100, t[i - 1][j - 1] + int(m[names.index(a[i - 1]), names.index(b[j - 1])]))
    return t[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words, words), max_size=6))
def test_weighted_distance_is_exact_and_a_lower_bound_of_the_plain_one(pairs):
    weighted, plain = D.Costs(TYPES), D.Costs(None)
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    w, p = D.pair_distances(a, b, weighted), D.pair_distances(a, b, plain)
    assert w.tolist() == [slow(x, y, weighted) for x, y in pairs] == D.pair_distances(b, a, weighted).tolist()
    assert p.tolist() == [slow(x, y, plain) for x, y in pairs] and (w <= p).all()


def test_costs():
    m = D.Costs(TYPES).matrix(["get_a", "get_b", "find_c", "put_d", "put_e", "calc"])
    assert m[0].tolist() == [0, 33, 66, 100, 100, 66] and m[3, 4] == 33
    assert D.Costs(TYPES, {"get_a": "x", "find_c": "x"}).matrix(["get_a", "find_c"])[0, 1] == 33


def test_column_distances(spark):
    rows = [("abc", "abc", 0, 0.0), ("abc", "axc", 1, 1 / 3), ("ab", "abc", 1, 1 / 3), ("abc", "xyz", 3, 1.0), ("ab", "abcd", 2, 0.5), ("", "", 0, 0.0), ("", "ab", 2, 1.0)]
    df = spark.createDataFrame([(list(a), list(b), d, n) for a, b, d, n in rows] + [(None, ["a"], None, None)], "a array<string>, b array<string>, d int, n double")
    out = D.weighted(df, "a", "b", D.Costs(None)).withColumns({"x": D.edit_distance(F.col("a"), F.col("b")), "y": D.normalized(F.col("a"), F.col("b"))}).collect()
    for r in out[:-1]:
        assert (r.x, r.distance) == (r.d, r.d) and r.y == pytest.approx(r.n)
    assert (out[-1].x, out[-1].distance) == (None, None)


def test_distances_to_a_set(spark):
    df = spark.createDataFrame([("d", list("abc")), ("d", []), ("e", ["a"]), ("d", None)], "domain string, tokens array<string>")
    out = [tuple(r)[2:] for r in D.to_set(df, "tokens", "domain", {"d": [list("xy"), list("abc"), list("pq"), list("abc")]}).collect()]
    assert out[0] == (0.0, 1, 0.5) and out[1] == (1.0, 0, 1.0) and out[2] == out[3] == (None, None, None)
    one = [tuple(r)[2:] for r in D.to_set(df.limit(1), "tokens", "domain", {"d": [list("ab"), list("ax"), list("xy")]}).collect()]
    assert one[0][:2] == (pytest.approx(1 / 3), 0)


@pytest.mark.parametrize("block", [250, 3])
def test_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    lists = [[t for t in w] for w in ("abc", "abd", "", "xyz", "ab", "ba", "c", "dd")]
    df = spark.createDataFrame([(dom, i, t) for dom in ("p", None) for i, t in enumerate(lists)], "domain string, idx int, tokens array<string>")
    got = D.all_pairs(df, D.Costs(None)).collect()
    assert len(got) == 2 * 28 and all(r.i < r.j and r.distance * 100 == slow(lists[r.i], lists[r.j], D.Costs(None)) for r in got)


def two_groups(n=8):
    return [["a"] * 5 + ["b"] * (i % 2) for i in range(n)] + [["z"] * 9 + ["y"] * (i % 2) for i in range(n)]


def test_k_medoids_finds_groups_and_keeps_frozen_ones(spark):
    lists = two_groups()
    rows = [("d", i, t, False) for i, t in enumerate(lists)] + [("e", i, t, i == 0) for i, t in enumerate(lists)]
    out = C.k_medoids(spark.createDataFrame(rows, "domain string, idx int, tokens array<string>, is_frozen boolean"), 2, D.Costs(None), seed=1).collect()
    d = [r for r in out if r.domain == "d"]
    assert len(d) == 16 and len({(r.cluster_idx, r.tokens[0]) for r in d}) == 2
    e = [r for r in out if r.domain == "e"]
    assert all(r.medoid_idx != 0 and r.idx != 0 for r in e) and {r.cluster_idx for r in e} <= {0, 1}
    made = C.assemble(spark.createDataFrame(d)).collect()
    assert all([m.distance for m in r.members] == sorted(m.distance for m in r.members) for r in made)


def test_medoid_update_and_ties():
    d = np.array([[0, 1, 1, 9], [1, 0, 1, 9], [1, 1, 0, 9], [9, 9, 9, 0]], float)
    assert C.assign(d, [3, 0, 1]).tolist() == [1, 2, 1, 0]
    assert C.update(d, np.array([0, 0, 0, 1]), [2, 3]) == [0, 3]
    assert C.update(d, np.array([0, 0, 0, 0]), [2, 3]) == [0, 3]
    assert C.update(d, np.array([0, 0, 0, 1]), [2, 3], frozen=1) == [2, 3]
    assert C.update(d, np.array([0, 0, 0, 1]), [2, 3], bias=np.array([0, 0, 0.5, 0])) == [2, 3]
    assert C.init(np.zeros((3, 3)), 2, 1, frozen=[0]) == [] and len(C.init(np.zeros((3, 3)), 2, 1)) == 2


def test_pools_larger_than_a_kept_matrix_give_the_same(spark, monkeypatch):
    pool = [(d, i, t, d == "e" and i == 3) for d in "de" for i, t in enumerate(two_groups(20))]
    df = spark.createDataFrame(pool, "domain string, idx int, tokens array<string>, is_frozen boolean")
    costs = D.DomainCosts({"d": {"a": "READ", "z": "WRITE"}})
    want = sorted(map(tuple, C.k_medoids(df, 3, costs, seed=5, bias=0.2).collect()))
    monkeypatch.setattr(C, "POOL", 10)
    monkeypatch.setattr(C, "ROWS", 7)
    assert sorted(map(tuple, C.k_medoids(df, 3, costs, seed=5, bias=0.2).collect())) == want


def test_more_distinct_tokens_than_the_alphabet(spark):
    n = len(D.ALPHABET)
    a, b = [f"t{i}" for i in range(n + 50)], [f"t{i}" for i in range(n + 50) if i % 1000]
    df = spark.createDataFrame([(a, b, 1), (a, a[:-1] + ["new"], 1), (["x"], ["y"], 1)], "a array<string>, b array<string>, k int")
    assert [r[0] for r in df.select(D.edit_distance(F.col("a"), F.col("b"))).collect()] == [5, 1, 1]


def test_costs_go_by_domain(spark):
    df = spark.createDataFrame([("d", ["get_a"], ["get_b"]), ("e", ["get_a"], ["get_b"]), (None, ["get_a"], ["put_b"])], "domain string, a array<string>, b array<string>")
    costs = D.DomainCosts({"d": {"get_a": "READ", "get_b": "READ"}, "e": {"get_a": "READ", "get_b": "WRITE"}})
    assert [r.distance for r in D.weighted(df, "a", "b", costs).collect()] == [0.33, 1.0, 0.66]


@pytest.mark.parametrize("block", [250, 2])
def test_medoid_costs(spark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    lists = [list(w) for w in ("abc", "abd", "", "xyz", "ab", "ab", "c")]
    df = spark.createDataFrame([("d", k, t) for k in (1, 2) for t in lists[: 3 * k + 1]] + [("d", None, ["q"]), ("d", 3, None)], "domain string, cluster_key long, tokens array<string>")
    got = {(r.cluster_key, tuple(r.tokens)): r.cost for r in D.medoid_costs(df, D.Costs(None)).collect()}
    want = {(k, tuple(t)): sum(slow(t, o, D.Costs(None)) for o in lists[: 3 * k + 1]) / 100 for k in (1, 2) for t in lists[: 3 * k + 1]}
    assert got == want | {(3, ()): 0.0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from([*TYPES, "new_f", None]), max_size=7)), max_size=9), st.integers(0, 9), st.sampled_from([1, 2, 1 << 20]))
def test_sweeps_have_all_pairs(lists, cut_at, small):
    sizes = {k: getattr(D, k) for k in ("TEXTS", "SIDE", "ROW_BYTES", "SORTED")}
    n = min(cut_at, len(lists))
    try:
        for k in sizes:
            setattr(D, k, min(sizes[k], small))
        for costs in (D.Costs(TYPES), D.Costs(None), D.Costs({}), D.Costs(TYPES, {"get_a": "x", "find_c": "x"})):
            swept, got = D.Swept([pa.chunked_array([pa.array(x, pa.list_(pa.string()))]) for x in (lists[:n], lists[n:])], costs), {}
            for x, y, saved in swept.sweep(np.arange(n), np.arange(n, len(lists))):
                d = D.INDEL * (swept.lengths[x][:, None] + swept.lengths[y]) - swept.unit * saved.astype(np.int64)
                assert (np.diff(swept.lengths[y] * 10 + y) > 0).all() and not got.keys() & {(i, j) for i in x for j in y}
                got |= {(i, j): v for i, line in zip(x, d.tolist()) for j, v in zip(y, line)}
            steps = [[t for t in s or [] if t is not None] for s in lists]
            assert got == {(i, j): slow(steps[i], steps[j], costs) for i in range(n) for j in range(n, len(lists))}
    finally:
        for k, v in sizes.items():
            setattr(D, k, v)


@pytest.mark.parametrize("types", [TYPES, None])
def test_sweeps_take_a_small_part_of_the_time_of_pairs(types):
    draw = np.random.default_rng(1)
    lists = [draw.choice([*TYPES, "new_f"], n).tolist() for n in draw.integers(5, 16, 2000)]
    swept, pairs = D.Swept([pa.chunked_array([pa.array(lists)])], D.Costs(types)), D.Encoded(lists, D.Costs(types))
    some, every = np.arange(0, 2000, 10), np.arange(2000)
    for _ in range(2):  # the first isn't counted
        began = time.process_time()
        total = sum(int((D.INDEL * (swept.lengths[x][:, None] + swept.lengths[y]) - swept.unit * saved.astype(np.int64)).sum()) for x, y, saved in swept.sweep(some, every))
        between = time.process_time()
        assert pairs.distances(np.repeat(some, 2000), np.tile(every, 200)).sum() == total
        ended = time.process_time()
    assert (between - began) * 5 < ended - between


def test_costs_of_clusters_in_blocks_of_both_kinds(spark, monkeypatch):
    lists = [[*w] for w in ("abc", "abd", "", "xyz", "ab", "ab", "c", "abc", "cab", "bca", "a", "b")]
    df = spark.createDataFrame([(dom, k, t) for k, dom in ((1, "d"), (2, "e"), (3, None)) for t in lists[: 4 * k]], "domain string, cluster_key long, tokens array<string>")
    costs = D.DomainCosts({"d": {"a": "READ", "b": "READ"}, "e": {"a": "WRITE"}})
    want = {(k, tuple(t)): sum(slow(t, o, costs.of(dom)) for o in lists[: 4 * k]) / 100 for k, dom in ((1, "d"), (2, "e"), (3, None)) for t in lists[: 4 * k]}
    for part, most, whole in ((2000, 16, 8000), (1, 2, 3), (2, 2, 100)):
        for name, value in (("PART", part), ("MOST_PARTS", most), ("WHOLE", whole)):
            monkeypatch.setattr(D, name, value)
        got = {(r.cluster_key, tuple(r.tokens)): r.cost for r in D.medoid_costs(df, costs).collect()}
        assert got == want


def test_pool_keeps_first_of_equal_ones(spark, rows):
    df = spark.createDataFrame([("d", 3, ["a"]), ("d", 1, ["a"]), ("d", 2, ["b"]), ("d", 4, []), ("d", 5, ["c"])], "domain string, attempt long, tokens array<string>")
    assert rows(C.unique_pool(df, 2, F.size("tokens") > 0)) == [("d", 0, ["a"]), ("d", 1, ["b"])]


def test_lengths(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 2, 2, 3, 20, None)] + [("b", 4)], "domain string, length int")
    r = {x.domain: x for x in L.fit(df, "domain").collect()}
    xs = [0, 2, 2, 3, 20]
    assert (r["a"].n, r["a"].median, r["a"].low, r["a"].high) == (5, 2.0, 1, 20)
    assert r["a"].std == pytest.approx(np.std(xs)) and r["a"].p10 == pytest.approx(max(1, np.percentile(xs, 10))) and r["a"].p90 == pytest.approx(np.percentile(xs, 90))
    assert {x.domain for x in L.fit_or(df.where("domain = 'b'"), df, "domain").collect()} == {"a", "b"}
    assert L.fit_or(df.where("false"), df).count() == 1 and L.fit(df.where("false")).count() == 0


def test_drawn_lengths(spark):
    base = spark.range(4000).select(F.lit("d").alias("domain"), F.col("id").alias("attempt"))
    x = [r.x for r in base.select(L.skew_normal(7.0, 5.0, 2.0, 1, 15, "attempt").alias("x")).collect()]
    assert min(x) >= 1 and max(x) <= 15 and 9.0 < np.mean(x) < 11.0
    given = spark.createDataFrame([("d", k) for k in (2, 2, 2, 8)], "domain string, length int")
    y = [r.length for r in L.kernel(base, given, "domain", "attempt").collect()]
    assert min(y) == 2 and max(y) == 8 and len(y) == 4000 and np.mean(np.array(y) > 5) == pytest.approx(0.25, abs=0.08)
    for bad in ({"mode": "x"}, {"mode": "skew_normal"}, {"mode": "skew_normal", "mean": 1.0}):
        with pytest.raises(ValueError):
            L.drawing(bad, given, "domain", "attempt")
    with pytest.raises(ValueError):
        L.skew_normal(1.0, 0.0, 0.0, 1, 5, "attempt")
    drawn = lambda s: [r.length for r in L.drawing(s, given, "domain", "attempt")(base).orderBy("attempt").collect()]
    whole = {"mode": "skew_normal", "mean": 7.0, "std": 5.0, "skew": 2.0, "min": 1, "max": 15, "other": 1}
    assert drawn(whole) == x and drawn({"mode": "from_seed"}) == drawn({}) == y
    free = drawn({"mode": "skew_normal", "mean": 7.0, "std": 5.0})
    assert min(free) == 2 and max(free) == 8


def test_statistics_keep_up_with_what_is_added(spark):
    df = lambda *x: spark.createDataFrame([("a", k) for k in x], "domain string, length int")
    fitted = L.Fitted(df(2, 4), "domain")
    one = fitted.get()
    assert fitted.get() is one and one.first().median == 3.0
    fitted.add(df(9, None))
    assert fitted.stats is None and [tuple(r) for r in fitted.get().collect()] == [tuple(r) for r in L.fit(df(2, 4, 9), "domain").collect()]


M = "cluster_key long, seq_id long, is_medoid boolean, distance double, tokens array<string>, valid boolean, reason string, bad_idx array<int>"


def validated(spark, rows, budget=99):
    return {r.cluster_key: (r.status, r.final_sequence, r.attempts) for r in V.validate_clusters(spark.createDataFrame(rows, M), budget).collect()}


def test_replacement_order_and_attempts(spark):
    m0 = (1, 0, True, 0.0, ["a", "b"], False, "bad", [1])
    m1 = lambda ok: (1, 1, False, 0.1, ["c", "b"], ok, None, [])
    m2 = lambda ok: (1, 2, False, 0.2, ["a", "x"], ok, None, [])
    assert validated(spark, [m0, m1(True), m2(True)]) == {1: ("replaced", ["a", "x"], 2)}
    assert validated(spark, [m0, m1(True), m2(False)]) == {1: ("replaced", ["c", "b"], 3)}
    assert validated(spark, [m0, m1(True), m2(False)], 1) == {1: ("unusable", None, 2)}
    none = (2, 5, True, None, ["a"], False, "bad", [])
    assert validated(spark, [none, (2, 6, False, None, ["b"], False, "", []), (2, 7, False, 0.3, ["c"], False, "", [])]) == {2: ("unusable", None, 5)}
    assert validated(spark, [(3, 1, True, None, ["a"], True, None, [])]) == {3: ("valid_medoid", ["a"], 1)}


def test_first_valid_and_pending(spark, rows):
    data = [(1, 0, True, 0.0, ["a"], False, "", []), (1, 1, False, None, ["b"], True, "", []), (1, 2, False, 0.5, ["c"], True, "", []), (2, 9, True, 0.0, ["z"], False, "", [])]
    assert rows(V.first_valid(spark.createDataFrame(data, M))) == [(1, 2, ["c"]), (2, 9, ["z"])]
    entries = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    progress = spark.createDataFrame([(1, True), (1, False), (2, False)], "k int, success boolean")
    assert rows(V.pending(entries, progress, "k")) == [(2,), (3,)]


@pytest.mark.parametrize("rows,places", [(4000, 1000), (2, 3)])
def test_distances_to_sets_in_blocks(spark, rows, places, monkeypatch):
    monkeypatch.setattr(D, "ROWS", rows)
    monkeypatch.setattr(D, "PLACES", places)
    lists = [list(w) for w in ("abc", "abd", "", "xyz", "ab", "ba", "c", "dd", "abc")]
    sets = [list(w) for w in ("xy", "", "abc", "ab", "pqr", "abc", "dd", "c")]
    df = spark.createDataFrame([("d", t) for t in lists] + [("e", ["a"]), (None, ["a"]), ("d", None)], "domain string, tokens array<string>")
    given = spark.createDataFrame([("d", i, t) for i, t in enumerate(sets)] + [("f", 0, ["a"])], "domain string, place int, tokens array<string>")
    got = {tuple(r.tokens): tuple(r)[2:] for r in D.to_sets(df, given).collect()}
    want = {tuple(r.tokens): tuple(r)[2:] for r in D.to_set(df.where("domain = 'd' and tokens is not null"), "tokens", "domain", {"d": sets}).collect()}
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)


def test_pairs_of_a_pool_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    df = spark.createDataFrame([("p", i, ["a"] * i) for i in range(12)], "domain string, idx int, tokens array<string>")
    got = D.all_pairs(df, D.Costs(None)).collect()
    assert len(got) == 66 and all(r.distance == r.j - r.i for r in got)


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_equal_members_of_a_set_and_ties_in_any_block(spark, size, monkeypatch):
    for name in ("ROWS", "PLACES", "SIDE", "TEXTS"):
        monkeypatch.setattr(D, name, size)
    sets = [list(w) for w in ("abcd", "", "ab", "ab", "xy", "abcd", "yx", "ab", "q", "")] + [None]
    lists = [list(w) for w in ("ab", "", "y", "abxy", "dcba", "q", "zzzzzz")]
    df = spark.createDataFrame([("d", t) for t in lists], "domain string, tokens array<string>")
    given = spark.createDataFrame([("d", i, t) for i, t in enumerate(sets)], "domain string, place int, tokens array<string>")
    for costs in (None, D.Costs({"a": "READ", "b": "READ", "x": "WRITE", "y": "WRITE"})):
        got = {tuple(r.tokens): tuple(r)[2:] for r in D.to_sets(df, given, costs).collect()}
        want = {tuple(r.tokens): tuple(r)[2:] for r in D.to_set(df, "tokens", "domain", {"d": [s or [] for s in sets]}, costs).collect()}
        assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)


def test_sets_take_a_small_part_of_the_time_of_pairs(spark):
    draw = np.random.default_rng(2)
    lists = [["t" + "abcdefgh"[x] for x in draw.integers(0, 8, n)] for n in draw.integers(5, 16, 4000)]
    df, sets = (spark.createDataFrame([("d", i, t) for i, t in enumerate(lists)], "domain string, place int, tokens array<string>") for _ in range(2))
    pairs, some = D.Encoded(lists, D.Costs(None)), np.arange(0, 4000, 80)
    began = time.perf_counter()
    pairs.distances(np.repeat(some, 4000), np.tile(np.arange(4000), 50))
    every = (time.perf_counter() - began) * 80
    D.to_sets(df.limit(20), sets.limit(20)).count()  # the first isn't counted
    began = time.perf_counter()
    assert D.to_sets(df, sets).where("min_distance = 0").count() == len({*map(tuple, lists)})
    assert (time.perf_counter() - began) * 3 < every
