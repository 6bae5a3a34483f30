from __future__ import annotations

import json
from datetime import datetime

from stepweave.operators import drift as D

SCHEMA = "row_id long, feed_id long, file_no long, file_name string, entity string, exported_at timestamp_ntz, body string, field int, n int"


def table(spark, files):
    """files: list of (file_no, day, [body or text])."""
    rows, i = [], 0
    for no, day, bodies in files:
        for b in bodies:
            i += 1
            rows.append((i, 1, no, "f", "lines", datetime(2025, 1, day), b if b is None or isinstance(b, str) else json.dumps(b), 0, 0))
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


def changes(spark, files):
    return sorted(tuple(r)[1:] for r in D.changes(D.tagged(table(spark, files), D.TELECOM_IDS)).collect())


def recs(n, f):
    return [{"line_id": f"L{i}"} | f(i) for i in range(n)]


def test_all_kinds_of_change_in_order_of_export(spark):
    a = recs(20, lambda i: {"old": f"v{i}", "gone": 1, "t": i, "s": "x"})
    b = recs(20, lambda i: {"new": f"v{i}" if i > 3 else "other", "come": True, "t": str(i), "s": "x"})
    assert changes(spark, [(9, 1, a), (3, 2, b)]) == [(3, "added", "", "come"), (3, "removed", "gone", ""), (3, "renamed", "old", "new"), (3, "retyped", "t", "t")]
    assert changes(spark, [(9, 1, a), (3, 2, recs(20, lambda i: {"new": f"v{i}" if i > 4 else "other", "t": i, "s": "x"}))]) == [(3, "added", "", "new"), (3, "removed", "gone", ""), (3, "removed", "old", "")]


def test_stray_fields_nulls_and_bad_bodies(spark):
    a = recs(40, lambda i: {"x": 1} | ({"stray": 1} if i < 2 else {}))
    b = recs(40, lambda i: {"x": None if i else 2.5} | ({"y": None} if i < 3 else {}))
    assert changes(spark, [(1, 1, [*a, None, "", '{"x": ', "[1]", "7"]), (2, 2, b)]) == [(2, "added", "", "y"), (2, "retyped", "x", "x")]
    assert changes(spark, []) == [] and changes(spark, [(1, 1, a)]) == []


def test_names_keep_their_case_and_ties_of_kinds(spark):
    a = recs(10, lambda i: {"plan": f"p{i}", "k": 1 if i % 2 else "1"})
    b = recs(10, lambda i: {"PLAN": f"p{i}", "k": "1"})
    assert changes(spark, [(1, 1, a), (2, 2, b)]) == [(2, "renamed", "plan", "PLAN")]


def test_consistent_table_keeps_every_value(spark):
    fields = D.tagged(table(spark, [(1, 1, recs(10, lambda i: {"a": f"v{i}", "z": [i]})), (2, 2, recs(10, lambda i: {"b": f"v{i}", "z": 1.5})), (3, 3, recs(10, lambda i: {"c": f"v{i}", "z": i > 3}))]), D.TELECOM_IDS)
    t = D.consistent(fields, D.changes(fields)).collect()
    assert len(t) == 90 and {r.field for r in t} == {"line_id", "a", "z"}
    assert {(r.kind, r.as_json is not None, r.as_decimal is not None, r.as_boolean is not None) for r in t if r.field == "z"} == {("array", True, False, False), ("decimal", False, True, False), ("boolean", False, False, True)}


def test_null_columns(spark):
    body = '{"line_id": null, "a": 1}'
    df = spark.createDataFrame([(None, None, None, None, None, None, body, None, None), (1, 1, 1, "", "lines", None, body, 0, 0), (2, 1, 2, "", "other", None, '{"b": 1}', 0, 0)], SCHEMA)
    assert D.changes(D.tagged(df, D.TELECOM_IDS)).count() == 3


def test_entity_table_has_branches_and_keeps_strays(spark):
    files = [(1, 1, recs(10, lambda i: {"a": i, "Feed_Id": "x"} | ({"stray": [i]} if i == 0 else {}))), (2, 2, recs(30, lambda i: {"b": str(i) if i else "no", "feed_id": "y"} | ({"odd": 1} if i == 1 else {})))]
    fields = D.tagged(table(spark, files), D.TELECOM_IDS)
    _, present = D.file_fields(fields)
    t = D.entity_table(D.consistent(fields, D.changes(fields)), present, "lines")
    rows = t.orderBy("row_id").collect()
    assert len(rows) == 40 and {"a", "a__integer"} <= set(t.columns) and len({c.lower() for c in t.columns}) == len(t.columns)
    assert [(r.a, r.a__integer) for r in rows[:2]] == [("0", 0), ("1", 1)] and (rows[10].a, rows[10].a__integer) == ("no", None)
    assert rows[11].other == {"odd": "1"} and rows[0].other == {} and rows[0].stray == "[0]"
    assert D.entity_table(D.consistent(fields, D.changes(fields)), present, "device").count() == 0


def test_lineages_of_chains_merges_and_circles(spark, rows):
    renames = [(f"f{i:03}", f"f{i + 1:03}") for i in range(40)] + [("b", "c"), ("c", "d"), ("d", "b"), ("d", "tail"), ("y", "z"), ("x", "z"), ("q", "q")]
    df = spark.createDataFrame([(1, 2, "renamed", a, b) for a, b in renames] + [(2, 2, "renamed", "p", "b"), (1, 2, "added", "", "n")], "feed_id long, file_no long, change string, old_field string, new_field string")
    want = [(1, f"f{i:03}", "f000") for i in range(1, 41)] + [(1, x, "b") for x in ("b", "c", "d", "tail")] + [(1, "z", "x"), (2, "b", "p")]
    assert rows(D.lineages(df)) == sorted(want, key=repr)


def test_kinds_of_paths_below_the_top_level(spark, rows):
    a = recs(2, lambda i: {"p": {"q": [1, 2.5, {"r": None}] if i else []}, "s": "{}"})
    b = recs(1, lambda i: {"p": {"q": "gone"}, "s": {}})
    fields = D.tagged(table(spark, [(1, 1, a), (2, 2, b)]), D.TELECOM_IDS)
    got = rows(D.paths(fields).where("path not in ('line_id')").select("file_no", "path", "kind", "n"))
    first = [("p", "object", 2), ("p.q", "array", 2), ("p.q[]", "integer", 1), ("p.q[]", "decimal", 1), ("p.q[]", "object", 1), ("p.q[].r", "null", 1), ("s", "string", 2)]
    assert got == sorted([(1, *x) for x in first] + [(2, "p", "object", 1), (2, "p.q", "string", 1), (2, "s", "object", 1)], key=repr)
    assert rows(D.path_alternatives(fields).select("file_no", "path", "kind", "n")) == [(2, "p.q", "string", 1), (2, "s", "object", 1)]
