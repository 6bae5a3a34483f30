from __future__ import annotations

import os

import pytest

from stepweave import queries as Q

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    oracle.compare(spark, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {Q._flat(t).__name__ for t in Q.FLAT}))
def test_query_runs(spark, name):
    df = Q.queries()[name](spark, oracle.DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as E

    assert set(Q.queries()) <= set(E.queries()) and E.entry(spark).count() > 0


def test_mismatches_of_all_trials(spark, rows, tmp_path):
    acts = [("t", 0, 0, "a"), ("t", 0, 1, "b"), ("t", 1, 0, "a"), ("t", 1, 1, "b"), ("t", 2, 0, "a"), ("t", 2, 1, "c"), ("t", 7, 0, "a"), ("u", 0, 0, "a"), ("v", 3, 0, "d")]
    table = [(i, "airline", task, trial, position, name, "{}", "assistant") for i, (task, trial, position, name) in enumerate(acts)]
    spark.createDataFrame(table, "row_id long, domain string, task_id string, trial int, position int, name string, arguments string, requestor string").write.parquet(f"{tmp_path}/eval_actions.parquet")
    want = [("t", 2, 1, "b", "c"), ("t", 7, 1, "b", None), ("u", 1, 0, "a", None), ("v", 3, 0, None, "d")]
    assert rows(Q.trial_mismatches(spark, str(tmp_path))) == want


def test_all_medoids_are_candidates(spark, rows, tmp_path):
    members = [("d", i, k, i < 10, 0.0, ["t" + "abcdefghij"[k]] * 2) for i, k in enumerate([*range(10), *range(9)])]
    spark.createDataFrame(members, "domain string, seq_id long, cluster_key long, is_medoid boolean, distance_to_medoid double, tokens array<string>").write.parquet(f"{tmp_path}/cluster_members.parquet")
    got = Q.nearest_medoid(spark, str(tmp_path))
    assert rows(got.select("seq_id", "min_distance", "nearest_cluster")) == sorted(((i, 0.0, k) for _, i, k, *_ in members), key=repr)
    assert Q.medoid_pairs(spark, str(tmp_path)).count() == 45


def test_pools_have_the_size_and_rounds_of_the_reference(spark, monkeypatch):
    sizes, rounds = [], []
    sample, whole = Q.pipeline.sample_pool, Q.pipeline.cluster_and_validate
    monkeypatch.setattr(Q.pipeline, "sample_pool", lambda c, v, size, *a, **k: (sizes.append(size), sample(c, v, 20, *a, **k))[1])
    monkeypatch.setattr(Q.pipeline, "cluster_and_validate", lambda *a, **k: (rounds.append((a[5], k["rounds"])), whole(*a[:5], 20, *a[6:], **k))[1])
    Q.pool_distances(spark, oracle.DATA)
    Q.clustered_pool(spark, oracle.DATA)
    assert sizes[0] == 2000 and rounds == [(2000, 3)]


def test_a_fourth_member_replaces_a_medoid(spark, rows, tmp_path, monkeypatch):
    judged = [("d", 1, i, i == 0, float(i), [f"t{i}"], i in (4, 8), "r", []) for i in range(9)]
    df = spark.createDataFrame(judged, "domain string, cluster_key long, seq_id long, is_medoid boolean, distance double, tokens array<string>, valid boolean, reason string, bad_idx array<int>")
    monkeypatch.setattr(Q, "_judged", lambda *_: df)
    assert rows(Q.medoid_replacement(spark, "")) == [(1, "replaced", "t4", 5, False, "r")]
    assert rows(Q.validation_status(spark, "")) == [("replaced", 1, 5)]


def test_changes_of_versions_between(spark, rows, tmp_path):
    table = [(i, "t", f"2024-01-0{i}", '{"a": %d}' % a) for i, a in ((1, 1), (2, 5), (3, 1))] * 2
    spark.createDataFrame(table, "row_id long, task_id string, created_at string, evaluation_criteria string").selectExpr("row_id", "task_id", "timestamp(created_at) AS created_at", "evaluation_criteria").write.parquet(f"{tmp_path}/tasks.parquet")
    got = Q.task_changes(spark, str(tmp_path)).select("row_id", "change", "old_value", "new_value")
    assert [r[:2] for r in rows(got)] == [(2, "changed"), (3, "changed")]


def test_every_child_table_is_a_flat_table(spark):
    """All flat tables together hold the scalars of p3_attributes, and their parents are records of the parents' tables."""
    from pyspark.sql import functions as F

    from stepweave.operators import shred
    from stepweave.session import cut

    assert len(Q.FLAT) == 21 and {"p3_users", "p3_legs", "p3_app_statuses"} <= set(Q.queries())
    tables = cut(shred.task_tables(spark.read.parquet(f"{oracle.DATA}/tasks.parquet")))
    want = {(r.child_table, r.row_id, ".".join(map(str, r.label)), n, v) for r in tables.collect() for n, v in r.attrs.items()}
    got = set()
    for t in Q.FLAT:
        flat = shred.flat_table(tables, "row_id", t)
        keys = ["row_id", "parent_label", "label", "parent_key", "child_key"]
        for r in flat.collect():
            got |= {(t, r.row_id, r.label, c.split("__")[0], r[c]) for c in flat.columns if c not in keys and r[c] is not None}
            assert r.parent_label is None or r.label.startswith(r.parent_label)
    own = {"row_id", "parent_label", "label", "parent_key", "child_key"}
    assert {x for x in want if x[3] not in own} == {x for x in got if x[3] not in own} and want


def test_every_entity_has_a_wide_table(spark):
    for name, entity in (("p6_device", "device"), ("p6_customers", "customers")):
        assert Q.queries()[name](spark, oracle.DATA).count() > 0, entity
