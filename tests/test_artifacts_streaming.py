from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stepweave.operators import ngram as N
from stepweave.sources import artifacts as A
from stepweave.streaming import online as O

SEQ = "domain string, tokens array<string>, sign string, weight double, bad_idx array<int>"


def test_checkpoints_come_back_the_same(spark, tmp_path, rows):
    df = spark.createDataFrame([("d", ["x", 'q"y', "x"], "pos", 1.0, None), ("d", ["x", "x"], "neg", 1.0, [1])], SEQ)
    counts = N.count(df, spark.createDataFrame([("d", "x"), ("d", 'q"y')], "domain string, token string"))
    A.write_checkpoint_json(counts, str(tmp_path / "c" / A.checkpoint_name("d", 3, 400)), {"n": 3})
    back = A.checkpoint_json(spark, str(tmp_path / "c" / "ngram_d_n3_t400.json"), "d")
    assert rows(back.select(*counts.columns)) == rows(counts) and counts.count() > 3
    A.write_counts(counts, df, str(tmp_path / "t"), 7)
    assert rows(A.read_counts(spark, str(tmp_path / "t"), 7)[0]) == rows(counts)


def test_nested_keys_of_a_checkpoint(spark, tmp_path, rows):
    doc = {"model": {"counts": {"pos_ngram": {json.dumps([["a", "b"], "c"]): 2.0}, "neg_ngram": {}}}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    assert rows(A.checkpoint_json(spark, str(tmp_path / "x.json"), "d")) == [("d", "pos", ["a", "b"], "c", 2.0)]


def test_files_of_a_run(spark, tmp_path):
    (tmp_path / "air").mkdir()
    (tmp_path / "air" / "domain.json").write_text('{"k": 1}')
    (tmp_path / "bare").mkdir()
    assert A.domains(str(tmp_path)) == ["air"] and A.domain_config(str(tmp_path / "air")) == {"k": 1} and A.domain_config(str(tmp_path / "bare")) == {}
    with pytest.raises(FileNotFoundError):
        A.domain_config(str(tmp_path / "none"))
    (tmp_path / "p.txt").write_text("===A===\none\n===B===\ntwo\n")
    assert A.sections(str(tmp_path / "p.txt"), ["A"]) == {"A": "one", "B": "two"}
    with pytest.raises(ValueError):
        A.sections(str(tmp_path / "p.txt"), ["C"])
    for folder, text in (("base", "b"), ("over", "o")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(text)
    (tmp_path / "base" / "y.txt").write_text("y")
    prompts = A.Prompts(str(tmp_path / "base"), str(tmp_path / "over"))
    assert (prompts.get("x"), prompts.get("y")) == ("o", "y")
    with pytest.raises(KeyError):
        prompts.get("z")
    with pytest.raises(FileNotFoundError):
        A.find_tasks("nowhere", str(tmp_path))


def test_tool_specs(spark, tmp_path):
    (tmp_path / "specs.json").write_text(json.dumps({"b": {"type": "WRITE", "parameters": {"p": {"type": "string"}}}, "a": {"description": "x"}}))
    got = A.tool_specs(spark, str(tmp_path / "specs.json")).orderBy("pos").collect()
    assert [(r.name, r.type, list(r.params)) for r in got] == [("b", "WRITE", ["p"]), ("a", "GENERIC", [])]


def test_tasks_progress_and_sets(spark, tmp_path, rows):
    (tmp_path / "tasks.json").write_text(json.dumps([{"task_id": "t1", "ticket": "x"}, {"task_id": "t2"}]))
    tasks = A.tasks_json(spark, str(tmp_path / "tasks.json"), "task_id string, ticket string")
    assert tasks.count() == 2 and A.find_tasks(str(tmp_path)).name == "tasks.json"
    A.write_task_set(tasks, str(tmp_path / "set"), spark.createDataFrame([(2,)], "n int"))
    assert spark.read.json(str(tmp_path / "set" / "tasks")).columns == ["task_id"]
    schema = "cluster_idx int, success boolean"
    assert A.read_progress(spark, str(tmp_path / "progress"), schema).count() == 0
    for _ in range(2):
        A.append_progress(spark.createDataFrame([(1, True), (2, False), (None, True)], schema), str(tmp_path / "progress"))
    (tmp_path / "progress" / "bad.json").write_text("\n{cut\n")
    assert rows(A.completed(A.read_progress(spark, str(tmp_path / "progress"), schema))) == [(1,)]
    results = spark.createDataFrame([("t2", True)], "task_id string, evolved boolean")
    assert A.evolved_output(tasks.withColumn("pos", F.lit(1)), results).count() == 1
    A.append_errors(spark.createDataFrame([("solver", "m")], "step string, message string"), str(tmp_path / "errors"))
    assert (tmp_path / "errors" / "step=solver").is_dir()


def test_online_counts_equal_batch_counts(spark, tmp_path, rows):
    v = spark.createDataFrame([("d", "x"), ("d", "y")], "domain string, token string")
    for k in range(3):
        spark.createDataFrame([("d", ["x", "y"][: k % 2 + 1], "pos", 1.0, None)] * (k + 1), SEQ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = O.online_counts(O.stream(spark, str(tmp_path / "in"), SEQ), v, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert rows(O.read_online(spark, str(tmp_path / "out"))) == rows(N.count(spark.read.parquet(str(tmp_path / "in")), v))


def test_windows_sessions_and_repeats(spark, tmp_path, rows):
    at = lambda h, m=0: datetime(2025, 1, 1, h, m)
    data = [(1, at(1), "a"), (1, at(1), "a"), (2, at(1, 20), "a"), (3, at(3), "b"), (4, at(9), "a")]
    schema = "id int, ts timestamp_ntz, kind string"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: O.stream(spark, str(tmp_path / "in"), schema)
    w = O.run_to_table(O.tumbling(source(), "ts", "10 minutes", "1 hour", "kind"), str(tmp_path / "w"))
    assert rows(w.select(F.hour("start"), "kind", "n")) == [(1, "a", 3), (3, "b", 1)]
    s = O.run_to_table(O.sessions(source(), "ts", "10 minutes", "30 minutes", "kind"), str(tmp_path / "s"))
    assert rows(s.select(F.hour("start"), F.minute("end"), "kind", "n")) == [(1, 50, "a", 3), (3, 30, "b", 1)]
    o = O.run_to_table(O.once(source(), ["id"], "ts", "10 minutes"), str(tmp_path / "o"))
    assert o.count() == 4


def test_json_arrays_of_tasks(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, f'a "{i}"' if i % 2 else None) for i in range(25)], "i int, t string").repartition(4)
    A.write_tasks_json(df, str(tmp_path / "a"))
    A.write_tasks_json(df.limit(0), str(tmp_path / "b"))
    assert rows(A.tasks_json(spark, str(tmp_path / "a"), "i int, t string")) == rows(df) and A.tasks_json(spark, str(tmp_path / "b"), "i int").count() == 0
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "a").glob("part-*"))


def test_configs_and_sections_on_any_file_system(spark, tmp_path, rows):
    for name, text in (("air", '{"k": 1}'), ("rail", "{}")):
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "domain.json").write_text(text)
    assert rows(A.domain_configs(spark, str(tmp_path / "d"))) == [("air", '{"k": 1}'), ("rail", "{}")]
    (tmp_path / "p.txt").write_text("before\n===A===\none\ntwo\n===B===\n\nx ===C=== y\n\n")
    assert rows(A.prompt_sections(spark, str(tmp_path / "p.txt")).select("section", "body")) == [("A", "one\ntwo"), ("B", "x ===C=== y")]
    assert A.sections(str(tmp_path / "p.txt")) == {"A": "one\ntwo", "B": "x ===C=== y"}


def test_metadata_and_logs(spark, rows):
    seqs = spark.createDataFrame([("d", ["a", "b"]), ("d", []), ("d", None)], "domain string, tokens array<string>")
    m = A.generation_metadata(seqs, "domain").first()
    assert (m.n_tasks, m.n_empty, m.low, m.high, m.histogram) == (2, 1, 1, 2, {"0": 1, "2": 1})
    df = spark.createDataFrame([("x/y z", "m", 1), ("q", None, 2)], "k string, m string, n int")
    assert rows(A.failures(df, "s", "k", F.col("m"), n=F.col("n"))) == sorted([("s", "x_y_z", "m", '{"n":1}'), ("s", "q", None, '{"n":2}')], key=repr)
    assert rows(A.prompt_log(df.withColumn("run", F.lit("r")), "run", "n", "k")) == sorted([("prompt", "r", 1, "x/y z"), ("prompt", "r", 2, "q")], key=repr)


def test_one_shot_builder_and_batches_of_training(spark, rows):
    """The counts of training are those of its ledger, whatever the size of a batch is; the builder stops once it has enough."""
    vocab = spark.createDataFrame([("d", x) for x in "abc"], "domain string, token string")
    seeds = spark.createDataFrame([("d", ["a", "b"]), ("d", [])], "domain string, tokens array<string>")
    bad = F.transform(F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == "c"), lambda i: i)

    def verdict(df):
        return df.withColumns({"bad_idx": F.when(F.size("tokens") > 0, bad).otherwise(F.array().cast("array<int>")), "reason": F.lit("r")}).withColumn("valid", F.size("bad_idx") == 0)

    for batch in (1, 4):
        counts, ledger = N.train(spark, seeds, vocab, verdict, 6 if batch == 1 else 12, batch, F.lit(3), seed=2)
        again = N.count(N.feedback(ledger.select("domain", "tokens", "valid", "bad_idx").unionByName(verdict(seeds.where(F.size("tokens") > 0)).select("domain", "tokens", "valid", "bad_idx"))), vocab)
        assert rows(counts.select("domain", "sign", "ctx", "token", "w")) == rows(again.select("domain", "sign", "ctx", "token", "w")) and ledger.count() == (6 if batch == 1 else 12)
    _, known = N.until_valid(spark, counts, vocab, verdict, 3, 5, 10, 2, seed=1)
    valid = [tuple(r.tokens) for r in known.collect()]
    assert len(valid) == len(set(valid)) >= 3 and all("c" not in t for t in valid)
