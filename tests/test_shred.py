from __future__ import annotations

import json

from stepweave.operators import shred as S


def found(spark, docs):
    df = spark.createDataFrame([(i, a, b, "x", 3) for i, (a, b) in enumerate(docs)], "row_id long, initial_state string, evaluation_criteria string, path string, label int")
    return sorted((tuple(r) for r in S.task_tables(df).select("row_id", "child_table", "parent_key", "child_key").distinct().collect()), key=repr)


def state(agent=None, user=None):
    return json.dumps({"initialization_data": {"agent_data": agent, "user_data": user}})


def test_shapes_of_one_collection(spark):
    by_name = state({"users": {"a": {"payment_methods": {"p": {"x": 1}, "q": None}}, "b": None}})
    as_list = state({"users": [None, {"user_id": "a"}, {"name": "no id"}, {"user_id": ""}, 5, [1]]})
    single = state({"orders": {"O1": {"items": {"product_id": "p", "price": 1}}}})
    assert found(spark, [(by_name, None)]) == [(0, "payment_method", "a", "p"), (0, "user", "", "a")]
    assert found(spark, [(as_list, None)]) == [(0, "user", "", "2"), (0, "user", "", "3"), (0, "user", "", "a")]
    assert found(spark, [(single, None)]) == [(0, "order", "", "O1"), (0, "order_item", "O1", "0")]


def test_json_in_strings_and_cut_off(spark):
    agent = json.dumps({"lines": [json.dumps({"line_id": 7})], "bills": '[{"bill_id": "b"'})
    doc = json.dumps(json.dumps({"initialization_data": {"agent_data": agent}}))
    assert found(spark, [(doc, None), (doc[:-9], "{"), (None, None), ("", ""), ("[]", "7")]) == [(0, "line", "", "7")]


def test_actions_legs_and_apps(spark):
    criteria = json.dumps({"actions": [None, {"arguments": {"flights": [{"f": 1}, None, {"f": 2}], "payment_methods": {"payment_id": "x"}}}, {"arguments": None}]})
    got = found(spark, [(state(None, {"device": {"app_statuses": [{"app_name": "maps"}, {}]}}), criteria)])
    assert got == sorted([(0, "app_status", "device", "maps"), (0, "app_status", "device", "1"), (0, "action", "", "1"), (0, "action", "", "2"), (0, "action_leg", "1", "0"), (0, "action_leg", "1", "2"), (0, "action_payment", "1", "0")], key=repr)


def test_parent_labels_are_prefixes_and_repeats_collapse(spark):
    doc = state({"flights": {"F1": {"dates": {"d1": {}, "d2": {}}}}})
    df = spark.createDataFrame([(1, doc, None), (1, doc, None)], "row_id long, initial_state string, evaluation_criteria string")
    rows = {tuple(map(str, r)) for r in S.task_tables(df).collect()}
    table = S.task_tables(df).collect()
    labels = {tuple(r.label) for r in table if r.child_table == "flight"}
    assert all(tuple(r.parent_label) in labels for r in table if r.child_table == "flight_date") and len(rows) == 3


def test_deep_long_and_empty(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    long = state({"users": {f"u{i}": {} for i in range(30_000)}})
    assert len(found(spark, [(deep, None), (long, None)])) == 30_000
    assert found(spark, []) == []


def test_strings_wrapped_many_times(spark):
    doc = state({"users": {"a": {}}})
    for _ in range(11):
        doc = json.dumps(doc)
    assert found(spark, [(doc, None), (json.dumps('"'), None)]) == [(0, "user", "", "a")]


def test_names_with_separators_are_no_paths(spark):
    assert found(spark, [(json.dumps({"initialization_data/agent_data": {"users": {"a": {}}}}), None)]) == []


def test_null_row_id(spark):
    df = spark.createDataFrame([(None, state({"users": {"a": {}}}), None)], "row_id long, initial_state string, evaluation_criteria string")
    assert [r.row_id for r in S.task_tables(df).collect()] == [None]


def test_flat_table(spark):
    doc = state({"bills": [{"bill_id": "b", "line_items": [{"amount": 1, "Label": "x"}, {"note": None, "amount": "2"}]}]})
    df = spark.createDataFrame([(1, doc, None), (1, doc, None)], "row_id long, initial_state string, evaluation_criteria string")
    t = S.flat_table(S.task_tables(df), "row_id", "bill_item")
    rows = sorted(t.collect(), key=lambda r: r.child_key)
    assert t.columns[-2:] == ["Label__2", "amount"] and [(r.parent_key, r.child_key, r.amount, r.Label__2) for r in rows] == [("b", "0", "1", "x"), ("b", "1", "2", None)]
    assert all(r.label.startswith(r.parent_label + ".") for r in rows)
    assert S.flat_table(S.task_tables(df), "row_id", "plan").count() == 0
