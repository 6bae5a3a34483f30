from __future__ import annotations

import json

from pyspark.sql import functions as F

from stepweave.operators import entities as N
from stepweave.operators import json_ops as J
from stepweave.operators import rules as R


def test_json_in_responses(spark):
    cases = ['```json\n{"a": 1}\n```', '{"a": [1,2,],}', 'text {"a":1} text', "no json", None, "", "  [1, 2,]  "]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(J.extract_json(F.col("t"))).collect()]
    assert [None if g is None else json.loads(g) for g in got] == [{"a": 1}, {"a": [1, 2]}, {"a": 1}, None, None, None, [1, 2]]
    assert [r[0] for r in df.select(J.parse_stage(F.col("t"))).collect()] == [0, 2, 0, 0, None, 0, 2]


def test_marks_and_braces(spark):
    df = spark.createDataFrame([('x {user_id} {9} {a b} {_z}',), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(J.template_marks(F.col("t"))).collect()] == [["{user_id}", "{_z}"], [], None]
    assert df.select(J.escape_braces(F.col("t"))).first()[0] == "x {{user_id}} {{9}} {{a b}} {{_z}}"


def test_deep_diff(spark, rows):
    old = spark.createDataFrame([(1, '{"a": 1, "b": [1, {"c": null}], "e": {}}'), (2, "{"), (3, None)], "k int, doc string")
    new = spark.createDataFrame([(1, '{"a": 2, "b": [1], "e": {}, "f": "x"}'), (2, "{}"), (3, None)], "k int, doc string")
    assert rows(J.deep_diff(old, new, ["k"], "doc")) == sorted([(1, "$.a", "changed", "1", "2"), (1, "$.b[1].c", "removed", "null", None), (1, "$.f", "added", None, '"x"'), (2, "$", "added", None, "{}")], key=repr)


def test_merges(spark, rows):
    df = spark.createDataFrame([("u", 1, "x", ["b", "a"]), ("u", 2, None, ["c", "a", None]), ("v", 1, None, None)], "k string, at int, f string, l array<string>")
    assert rows(N.merge_scalars(df, ["k"], ["f"], ["at"])) == [("u", "x"), ("v", None)]
    assert rows(N.merge_lists(df, ["k"], "l", "at")) == [("u", ["b", "a", "c"])]
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(2, None, "n"), (3, "i", None)], "k int, x string, y string")
    assert rows(N.upsert(base, new, ["k"])) == [(1, "a", "b"), (2, "c", "n"), (3, "i", None)]


def test_back_links(spark, rows):
    owners = spark.createDataFrame([("u", ["b", None]), ("u", ["a"]), ("v", None)], "k string, l array<string>")
    owned = spark.createDataFrame([("u", "c"), ("u", "a"), ("w", "z"), (None, "q")], "k string, i string")
    assert rows(N.back_links(owners, owned, "k", "l", "i")) == [("u", ["a", "b", "c"]), ("v", [])]


def test_maps_and_lists(spark):
    df = spark.createDataFrame([({"b": ("x",), "a": ("y",)},), (None,)], "m map<string,struct<s:string>>")
    out = [r[0] for r in df.select(N.map_to_list(F.col("m"), "id")).collect()]
    assert [(e.id, e.record.s) for e in out[0]] == [("a", "y"), ("b", "x")] and out[1] is None
    lst = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3), (None, 4)],)], "l array<struct<id:string,n:int>>")
    m = lst.select(N.list_to_map(F.col("l"), "id")).first()[0]
    assert {k: json.loads(v)["n"] for k, v in m.items()} == {"a": 3, "b": 2}
    al = spark.createDataFrame([({"w": "1"},), ({"w": "1", "r": "2"},), ({"gone": "x", "k": "y"},)], "m map<string,string>")
    assert [r[0] for r in al.select(N.rename_fields(F.col("m"), {"w": "r", "gone": None})).collect()] == [{"r": "1"}, {"r": "2"}, {"k": "y"}]


def test_follow_up_steps(spark, rows):
    acts = lambda *names: [(1, i, n[0], n[2:]) for i, n in enumerate(names)]
    check = lambda *names: [r.pos for r in N.missing_follow_ups(spark.createDataFrame(acts(*names), "k int, pos int, who string, name string"), ["k"], "pos", (F.col("who") == "A") & (F.col("name") == "resume"), F.col("who") == "U", F.col("name") == "reboot").collect()]
    assert check("A resume", "U reboot") == [] and check("A resume", "A other", "U reboot") == []
    assert check("A resume", "U other", "U reboot") == [0] and check("A resume") == [0]


def test_follow_ups_of_one_large_key_are_linear(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "resume").otherwise("other").alias("name"))
    assert N.missing_follow_ups(df, ["k"], "pos", F.col("name") == "resume", F.lit(True), F.col("name") == "reboot").count() == -(-n // 3)


def test_redaction_of_one_large_group_by_brute_force(spark):
    df = spark.range(20_000).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("i"), F.lit("{}").alias("args"))
    out = N.redact(df, ["g"], ["i"], 0.3, "args", F.col("i") % 2 == 0, seed=4).withColumn("u", N.uniform("i", seed=4)).collect()
    u = sorted((r.u, r.i) for r in out if r.i % 2 == 0)
    assert {r.i for r in out if r.covered} == {i for _, i in u[:3000]}


def test_redaction(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i < 6 else "user", '{"b": 1, "a": 2}') for i in range(9)], "g int, i int, who string, args string")
    may = F.col("who") == "assistant"
    for share, n in ((0.0, 0), (0.1, 1), (0.5, 3), (1.0, 6)):
        out = N.redact(df, ["g"], ["i"], share, "args", may).collect()
        assert sum(r.covered for r in out) == n and all(r.who == "assistant" and r.shown == "a=???, b=???" for r in out if r.covered)


def test_task_rows_and_mismatches(spark, rows):
    doc = {"actions": [{"tool_name": "x", "args": {"k": 1}, "info": 5}, None, {"name": "y", "requestor": "user", "info": "i", "action_id": "z"}]}
    df = spark.createDataFrame([(1, "t", json.dumps(doc)), (2, "t", json.dumps(json.dumps(doc))), (3, "t", "{"), (4, "t", None)], "row_id int, task_id string, evaluation_criteria string")
    got = rows(N.task_rows(df))
    assert got == [(i, "t", *r) for i in (1, 2) for r in ((0, "0", "x", "assistant", '{"k":1}', None), (2, "z", "y", "user", "{}", "i"))]
    e = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, None)], "k int, p int, v string")
    a = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (1, 3, "d")], "k int, p int, v string")
    assert rows(N.mismatches(e, a, ["k"], "p", "v")) == [(1, 1, "b", "c"), (1, 3, None, "d")]


def test_references_and_limits(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, r string")
    t = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert rows(R.missing(df, t, {"r": "id"})) == [(2, "z")]
    assert rows(R.missing_in_any(df, "r", [(t, "id"), (spark.createDataFrame([("z",)], "q string"), "q")])) == []
    owners = spark.createDataFrame([("u", ["a"]), ("v", None)], "k string, links array<string>")
    owned = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c"), ("w", "d")], "k string, i string")
    assert rows(R.not_listed(owned, owners, "k", "i", "links")) == [("u", "b"), ("v", "c")]
    assert rows(R.over_limit(owned, ["k"], F.lit(True), 1)) == [("u", 2)]
    assert rows(R.reused(owned.unionByName(owned.limit(1)), ["k"], "i")) == [("u", "a", 2)]
    c = spark.createDataFrame([(1, "y"), (1, "x"), (1, "y"), (2, "q")], "k int, i string")
    assert rows(R.ambiguous(c, ["k"], "i")) == [(1, "x", ["y"])]


def test_arguments(spark):
    acts = spark.createDataFrame([("f", '{"a": 1, "x": 2}'), ("g", "{}"), ("f", "[1]"), ("f", None)], "name string, arguments string")
    specs = spark.createDataFrame([("f", ["a", "b"])], "name string, params array<string>")
    got = [(r.unknown_tool, r.unexpected, r.missing) for r in R.unexpected_arguments(acts, specs).orderBy("name", F.col("arguments").desc()).collect()]
    assert (False, ["x"], ["b"]) in got and (True, None, None) in got and len(got) == 4


def test_chain_routing_and_priority(spark, rows):
    v = spark.createDataFrame([(1, "schema", "s"), (1, "shape", "z"), (1, "shape", "m"), (2, "solver", "x is not a valid airport"), (3, "solver", None), (4, "odd", "o")], "k int, rule string, message string")
    first = R.first_failure(v, ["k"], ["shape", "schema", "solver"])
    assert rows(first) == [(1, "shape", "m"), (2, "solver", "x is not a valid airport"), (3, "solver", None), (4, "odd", "o")]
    assert {r.k: r.patch for r in R.route(first, ["solver"], ["not a valid airport"]).collect()} == {1: "task_and_db", 2: "task_and_db", 3: "db_only", 4: "task_and_db"}
    done = R.verdicts(spark.createDataFrame([(1,), (9,)], "k int"), first, ["k"])
    assert {r.k: r.success for r in done.collect()} == {1: False, 9: True}
    assert rows(R.at_most(v.select("k", "rule"), ["k"], ["rule"], 1)) == [(1, "schema"), (2, "solver"), (3, "solver"), (4, "odd")]


def test_costs(spark):
    u = spark.createDataFrame([("vertex/m1", 1_000_000, 500_000), ("other", 1_000_000, 0)], "model string, prompt_tokens long, completion_tokens long")
    assert [float(r.cost_usd) for r in R.usage_costs(u, {"m1": (2.0, 10.0)}, (0.3, 2.5)).collect()] == [7.0, 0.3]


def test_small_helpers(spark, rows):
    from stepweave.functions.text import has_digit, key_form, name_form, numbered

    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "i int, k string, b string")
    other, named = N.split_by(df, "k", ["a"])
    assert rows(other.select("i")) == [(2,)] and rows(named.select("i")) == [(1,)]
    assert rows(R.collisions(df, df.limit(1), ["k"]).select("i")) == [(1,)]
    both = spark.createDataFrame([(1, "b", "z", "2"), (1, "a", "y", "1")], "g int, k string, e string, b string")
    assert rows(N.described(both, ["g"], "k", "e", "b")) == [(1, "a y: 1\nb z: 2")]
    t = spark.createDataFrame([(["p", "q"], " #ab-1_c ", " Get.User--Details9 "), (None, None, "--"), ([], "", None)], "l array<string>, k string, n string")
    got = [tuple(r) for r in t.select(numbered(F.col("l")), key_form("k"), has_digit(F.col("k")), name_form("n")).collect()]
    assert got == [("1. p\n2. q", "AB1C", True, "get_user_details"), (None, None, None, None), ("", "", False, None)]


def test_called_actions(spark, rows):
    call = {"function": {"name": "f", "arguments": '{"a": 1}'}}
    docs = [{"tool_calls": [call, {"tool_name": "g", "args": {"b": [1]}}], "function_call": {"name": "no"}}, {"tool_calls": [], "function_call": {"action_name": "h", "parameters": "not {json"}}, {"tool_calls": None, "function_call": None}, {"content": "x"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] + [(9, None), (10, "{")], "i int, m string")
    got = rows(N.called(df, "m").select("i", "pos", "name", "arguments"))
    assert got == [(0, 0, "f", '{"a":1}'), (0, 1, "g", '{"b":[1]}'), (1, 0, "h", "not {json")]


def test_links_within_a_document(spark, rows):
    t = spark.createDataFrame([(1, "line", "L1", {"plan_id": "p-1", "x": "y"}), (1, "line", "L2", {"plan_id": "P9"}), (1, "plan", "P1", {}), (2, "line", "L3", {"plan_id": "P1"}), (2, "line", "L4", None), (2, "plan", "Q", None)], "row_id int, child_table string, child_key string, attrs map<string,string>")
    from stepweave.functions.text import key_form

    assert rows(R.missing_links(t, "row_id", [("line", "plan_id", "plan")], key_form)) == [(1, "line", "L2", "plan_id", "P9"), (2, "line", "L3", "plan_id", "P1")]


def test_ladder_and_progress(spark, rows):
    from stepweave.operators import providers as P
    from stepweave.operators import select as V

    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "n int")
    rung = lambda top: lambda d: d.withColumn("success", F.coalesce(F.col("n") <= top, F.lit(False)))
    assert rows(P.ladder([("a", rung(1)), ("b", rung(5))], df)) == sorted([(1, "a", True), (5, "b", True), (9, "original", False), (None, "original", False)], key=repr)
    assert rows(P.ladder([], df.limit(1))) == [(1, "original", False)]
    progress = spark.createDataFrame([(1, False), (1, True), (2, False), (3, None), (None, False)], "k int, success boolean")
    assert rows(V.failed(progress, "k")) == [(2,), (3,)] and rows(V.frozen(spark.createDataFrame([(1,), (2,)], "k int"), progress, "k")) == [(1,)]


def test_inserted_and_patched(spark, rows):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "id string, pos int, name string")
    assert rows(N.with_follow_ups(df, df.limit(1), "pos", "id", {"name": F.lit("z")}, "after_")) == sorted([("a", 0.0, "x"), ("b", 1.0, "y"), ("after_a", 0.5, "z")], key=repr)
    s = spark.createDataFrame([((("o", "k"), ("n", None))), ((("o", "k"), None))], "old struct<a:string,b:string>, new struct<a:string,b:string>")
    assert rows(s.select(N.patched(F.col("old"), F.col("new"), ["a", "b"]).alias("x")).select("x.*")) == [("n", "k"), ("o", "k")]
