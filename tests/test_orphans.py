from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from stepweave.operators import orphans as O

T0 = datetime(2025, 1, 1)
REFS = "src_table string, src_row_id long, ref_field string, target string, ref_key string, at timestamp_ntz"
VERSIONS = "target string, ref_key string, at timestamp_ntz, seq long, deleted_at timestamp_ntz, n int, delta string"


def day(n):
    return None if n is None else T0 + timedelta(hours=8 * n)


def brute(refs, versions):
    out = set()
    for r in refs:
        *_, target, key, at = r
        if key is None or at is None:
            continue
        seen = [(v[2], v[3], v[4]) for v in versions if v[0] == target and v[1] == key and v[2] is not None and v[2] <= at]
        last = max(seen, key=lambda v: (v[0], v[1])) if seen else None
        if last is None or (last[2] is not None and last[2] <= at):
            out.add(r)
    return out


def test_against_brute_force_with_ties_repeats_and_hot_keys(spark):
    rnd = random.Random(5)
    pick = lambda: rnd.choice(["A1", "B2", "C3", None])
    versions = [("t", pick(), day(rnd.choice([None, *range(14)])), i, day(rnd.choice([None, None, *range(16)])), 1, "x") for i in range(40)]
    versions += versions[:5]
    refs = [("s", i, "f", "t", rnd.choice(["A1"] * 5 + ["B2", "C3", "Z9", None]), day(rnd.choice([None, *range(18)]))) for i in range(120)]
    refs += refs[:7]
    want = brute(refs, versions)
    for hot in (1_000, 5):
        got = O.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(versions, VERSIONS), hot_rows=hot)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_empty_tables(spark):
    refs, versions = spark.createDataFrame([], REFS), spark.createDataFrame([], VERSIONS)
    assert O.orphans(refs, versions).count() == 0
    one = spark.createDataFrame([("s", 1, "f", "t", "K1", day(1))], REFS)
    assert O.orphans(one, versions).count() == 1
    assert O.orphans(refs, spark.createDataFrame([("t", "K1", day(1), 1, None, 0, "")], VERSIONS)).count() == 0


def test_existence_deltas(spark, rows):
    v = spark.createDataFrame([("t", "K1", day(1), 1, None, 0, ""), ("t", "K1", day(3), 2, day(5), 0, ""), ("t", "K2", day(2), 3, day(1), 0, "")], VERSIONS)
    assert rows(O.existence_deltas(v)) == sorted([("t", "K1", day(1), 1), ("t", "K1", day(3), -1), ("t", "K1", day(3), 1), ("t", "K1", day(5), -1)], key=repr)


def test_hot_days_are_split_by_time(spark):
    rnd = random.Random(3)
    at = lambda: T0 + timedelta(microseconds=rnd.randrange(3_000_000))
    versions = [("t", "A1", at(), i, rnd.choice([None, at()]), 1, "x") for i in range(300)] + [("t", "B2", T0, 900, None, 1, "")]
    refs = [("s", i, "f", "t", rnd.choice(["A1", "A1", "B2", "C3"]), at()) for i in range(300)]
    r, v = spark.createDataFrame(refs, REFS), spark.createDataFrame(versions, VERSIONS)
    hot, limit = O._hot_days(r, O._collapsed(v), 20, 1000)
    assert limit == 20 and {x.ref_key: len(x.bounds) for x in hot.collect()}["A1"] > 30
    assert {tuple(x) for x in O.orphans(r, v, hot_rows=20).collect()} == brute(refs, versions) != set()


LOG = "src_table string, src_key string, at timestamp_ntz, seq long, live boolean, keys array<struct<target:string,ref_key:string>>"


def report_of(log):
    """The orphans of a whole log, in Python."""
    last = {}
    for src, key, at, seq, live, keys in log:
        if key is not None and at is not None and ((src, key) not in last or (at, seq) > last[src, key][:2]):
            last[src, key] = (at, seq, live, keys)
    asked = {}
    for _, _, live, keys in last.values():
        for k in keys if live else ():
            asked[k] = asked.get(k, 0) + 1
    return sorted((*k, n) for k, n in asked.items() if not (k in last and last[k][2]))


@pytest.mark.parametrize("seed", [1, 4])
def test_any_split_into_batches_gives_the_report_of_one(spark, seed):
    rnd = random.Random(seed)
    names = [("t", f"K{i}") for i in range(5)] + [("s", f"R{i}") for i in range(5)]
    log = []
    for i in range(60):
        src, key = rnd.choice(names)
        keys = rnd.sample([("t", f"K{j}") for j in range(12)], rnd.choice([0, 1, 1, 2, 3])) if src == "s" else []
        log.append((src, rnd.choice([key] * 20 + [None]), rnd.choice([day(rnd.randrange(9))] * 20 + [None]), i, rnd.random() < 0.5, keys))
    log += rnd.sample(log, 6)
    for n in (2, 6):
        batches = [[] for _ in range(n)]
        for r in log:
            batches[rnd.randrange(n)].append(r)
        state = None
        for k, b in enumerate(batches):
            state = O.fold(state, spark.createDataFrame(b, LOG))
            if k == 3:
                state = O.compact(state)
        assert sorted(map(tuple, O.current_orphans(state).collect())) == report_of(log)
    assert report_of(log)


def test_moved_and_deleted_records_take_back_what_they_gave(spark, rows):
    batch = lambda *r: spark.createDataFrame(list(r), LOG)
    ok, gone = [("t", "OK")], [("t", "GONE")]
    state = O.fold(None, batch(("t", "OK", day(1), 1, True, []), ("s", "A", day(1), 2, True, gone), ("s", "B", day(1), 3, True, ok)))
    assert rows(O.current_orphans(state)) == [("t", "GONE", 1)]
    moved = O.fold(state, batch(("s", "A", day(2), 4, True, ok)))
    assert rows(O.current_orphans(moved)) == []
    deleted = O.fold(moved, batch(("t", "OK", day(3), 5, False, [])))
    assert rows(O.current_orphans(deleted)) == [("t", "OK", 2)]
    late = O.fold(deleted, batch(("t", "OK", day(2), 6, True, []), ("s", "A", day(1), 9, True, gone)))
    assert rows(O.current_orphans(late)) == [("t", "OK", 2)]
    assert rows(O.current_orphans(O.fold(late, batch(("s", "A", day(5), 7, False, ok), ("s", "B", day(5), 8, True, []))))) == []


def test_values_by_name_at_any_depth(spark, rows):
    deep = "".join('{"a":' for _ in range(200)) + '{"USER-ID": "u9"}' + "}" * 200
    data = [(1, '{"user_id": "u1", "x": [{"userId": 7}, {"User Id": ["u2", {"k": 1}, null, true]}]}', "c"), (2, '{"user_id": "cut', "c"), (3, None, None), (4, '{"user_id": null, "user_id": "u3"}', ""), (5, '{"user_id": NaN}', ""), (6, deep, ""), (7, '["user_id", "u5"]', ""), (8, "", "")]
    df = spark.createDataFrame(data, "row_id long, arguments string, value string")
    assert rows(O.named_values(df, "arguments", ["user_id"], ["row_id"])) == sorted([(1, "user_id", "u1"), (1, "user_id", "7"), (1, "user_id", "u2"), (4, "user_id", "u3"), (6, "user_id", "u9")], key=repr)
