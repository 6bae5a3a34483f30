from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stepweave.operators import ngram as N
from stepweave.operators import providers as P
from stepweave.operators import sequences as S

SEQ = "domain string, tokens array<string>, sign string, weight double, bad_idx array<int>"


def seqs(spark, *rows):
    return spark.createDataFrame([("d", t, s, w, i) for t, s, w, i in rows], SEQ)


def vocab(spark, *tokens):
    return spark.createDataFrame([("d", t, None) for t in tokens], "domain string, token string, action_type string")


def got(counts):
    return {(r.sign, tuple(r.ctx), r.token): r.w for r in counts.collect()}


B, E = S.BOS, S.EOS


def test_windows_of_full_and_empty_sequences(spark):
    v = vocab(spark, "x", "y")
    assert got(N.count(seqs(spark, (["x", "y"], "pos", 1.0, None)), v)) == {("pos", (B, B), "x"): 1, ("pos", (B, "x"), "y"): 1, ("pos", ("x", "y"), E): 1}
    assert got(N.count(seqs(spark, ([], "pos", 2.0, None), (None, "pos", 1.0, None), (["x"], "pos", 0.0, None)), v)) == {("pos", (B, B), E): 2}
    assert got(N.count(seqs(spark, (["x", "q", "y"], "pos", 1.0, None)), v)) == {("pos", (B, B), "x"): 1, ("pos", ("x", "q"), "y"): 1, ("pos", ("q", "y"), E): 1}


def test_negatives_count_only_at_their_places(spark):
    v = vocab(spark, "x", "y")
    assert got(N.count(seqs(spark, (["x", "y"], "neg", 1.0, [1, 1, 5])), v)) == {("neg", (B, "x"), "y"): 1}
    assert got(N.count(seqs(spark, (["x", "y"], "neg", 1.0, [])), v)) == {}
    verdicts = spark.createDataFrame([("d", ["x"], True, []), ("d", ["y"], False, []), ("d", ["y", "y"], False, [1])], "domain string, tokens array<string>, valid boolean, bad_idx array<int>")
    assert {(r.sign, tuple(r.tokens)) for r in N.feedback(verdicts).collect()} == {("pos", ("x",)), ("neg", ("y", "y"))}
    assert N.feedback(verdicts, ingest_negatives=False).count() == 1


@pytest.mark.parametrize("cp, tp, cn, tn, p, q, s", [(14, 32, 0, 12, 0.4221556886, 0.0074626866, 56.56886227), (0, 32, 5, 12, 0.0029940120, 0.3805970149, 0.00786662), (0, 32, 0, 12, 0.0029940120, 0.0074626866, 0.40119760), (0, 0, 0, 0, 1 / 14, 1 / 14, 1.0), (1, 3, 3, 3, 0.25, 0.7045454545, 0.35483871)])
def test_posterior_and_score(spark, cp, tp, cn, tn, p, q, s):
    x = [N.posterior(F.lit(float(c)), F.lit(float(t)), F.lit(14), 0.1) for c, t in ((cp, tp), (cn, tn))]
    r = spark.range(1).select(x[0].alias("p"), x[1].alias("q"), N.score(*x, 1.0, 1e-12).alias("s"), N.score(*x, 0.0, 1e-12).alias("plain")).first()
    assert r.p == pytest.approx(p, abs=1e-9) and r.q == pytest.approx(q, abs=1e-9) and r.s == pytest.approx(s, rel=1e-6) and r.plain == r.p


def test_temperature(spark):
    r = spark.range(1).select(*(N.temperature(F.lit(float(t)), 3.0, 1500.0).alias(str(t)) for t in (0, 1500, 10**7))).first()
    assert tuple(r) == pytest.approx((3.0, 1 + 2 / math.e, 1.0))


def test_sampling_follows_the_scores_and_is_repeatable(spark):
    counts = N.count(seqs(spark, *[(["x"], "pos", 1.0, None)] * 90, *[(["y"], "pos", 1.0, None)] * 10), vocab(spark, "x", "y"))
    attempts = spark.range(3000).select(F.lit("d").alias("domain"), F.col("id").alias("attempt"), F.lit(1).alias("length"), F.lit(1.0).alias("tau"))
    config = N.Config(lam=0.0)
    one = {r.attempt: r.tokens for r in N.generate(attempts, counts, vocab(spark, "x", "y"), 3, config).collect()}
    two = {r.attempt: r.tokens for r in N.generate(attempts.repartition(7), counts, vocab(spark, "x", "y"), 3, config).collect()}
    share = sum(t == ["x"] for t in one.values()) / 3000
    assert one == two and len(one) == 3000 and abs(share - 0.9) < 0.03
    hot = N.generate(attempts.withColumn("tau", F.lit(50.0)), counts, vocab(spark, "x", "y"), 3, config)
    assert abs(hot.where(F.col("tokens")[0] == "x").count() / 3000 - 0.51) < 0.04
    with pytest.raises(ValueError):
        N.Scores([], ["x"], config).generate(1, 1, -1, 1.0)


def test_training_adds_what_was_judged(spark):
    v = vocab(spark, "x", "y")
    seeds = spark.createDataFrame([("d", ["x", "y"]), ("d", [])], "domain string, tokens array<string>")
    counts, ledger = N.train(spark, seeds, v, P.by_rules(v), samples=6, batch=3, lengths=F.lit(2))
    judged = ledger.collect()
    valid = sum(r.valid for r in judged)
    assert len(judged) == 6 and {r.t for r in judged} == {1, 2, 3, 4, 5, 6}
    assert sum(w for (s, _, _), w in got(counts).items() if s == "pos") == 3 * (valid + 1)
    counts, known = N.until_valid(spark, N.count(seqs(spark), v), v, P.by_rules(v), wanted=3, rounds=4, batch=20, length=2)
    assert 3 <= known.count() <= 4 and known.distinct().count() == known.count()


def test_bad_configs():
    for bad in ({"n": 1}, {"alpha0": 0}, {"lam": -1}, {"eps": 0}):
        with pytest.raises(ValueError):
            N.Config(**bad)


def test_sequence_columns(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b", "t", "b"],), ([],), (["q", "t"],), (["a", "b"],)], "tokens array<string>")
    known = F.array(*map(F.lit, "abt"))
    r = [tuple(x[0]) for x in df.select(S.rubric(F.col("tokens"), known, only_last=["t"])).collect()]
    assert r == [(False, "repeated", [2]), (False, "empty", []), (False, "unknown action", [0]), (True, None, [])]
    types = F.create_map(*map(F.lit, ("a", "WRITE", "b", "GENERIC")))
    w = [tuple(x) for x in df.select(S.write_fraction(F.col("tokens"), types), S.only_writes(F.col("tokens"), types)).collect()]
    assert w == [(0.5, False), (0.0, True), (0.0, False), (0.5, True)]
    d = spark.createDataFrame([(["a", "b"], ["a", "c"], [1.9, -0.5, 7.0, -3.0])], "x array<string>, y array<string>, i array<double>")
    c = d.select(S.clean_indices(F.col("i"), F.col("x")).alias("i"), S.differs_at(F.col("x"), F.col("y"), F.array(F.lit(0))).alias("same"), S.differs_at(F.col("x"), F.col("y"), F.array(F.lit(1))).alias("other"), S.differs_at(F.col("x"), F.col("y"), F.array(F.lit(2))).alias("short")).first()
    assert tuple(c) == ([1, 0], False, True, True)
    m = spark.createDataFrame([("vertex/gem-2-preview",), ("a/b/c-latest",), ("x-y",)], "m string")
    assert [x[0] for x in m.select(S.short_model_name(F.col("m"))).collect()] == ["gem_2", "c", "x_y"]


def test_duplicate_status_prefers_accepted(spark):
    t = lambda *rows: spark.createDataFrame([(r,) for r in rows], "tokens array<string>")
    out = S.status_of(t(["a"], ["b"], ["c"]), t(["a"], ["a"]), t(["a"], ["b"]))
    assert {r.tokens[0]: r.status for r in out.collect()} == {"a": "accepted_dup", "b": "rejected_dup", "c": "new"} and out.count() == 3


def test_providers(spark):
    df = spark.createDataFrame([("d", ["a"]), ("d", []), ("d", ["z"]), (None, ["a"])], "domain string, tokens array<string>")
    rec = spark.createDataFrame([(["a"], False, "no", [0.0, 4.0]), (["a"], False, "no", [0.0])], "tokens array<string>, valid boolean, reason string, bad_idx array<double>")
    rows = {(r.domain, tuple(r.tokens)): (r.valid, r.reason, r.bad_idx) for r in P.by_table(rec)(df).collect()}
    assert rows == {("d", ("a",)): (False, "no", [0]), ("d", ()): (True, None, []), ("d", ("z",)): (False, "no verdict", []), (None, ("a",)): (False, "no", [0])}
    out = P.by_function(lambda batch: [(len(s) > 0, None, []) for s in batch])(df)
    assert sorted(r.valid for r in out.collect()) == [False, True, True, True]
    assert P.by_rules(vocab(spark, "a"))(df).where("valid").count() == 1


def test_retries(spark):
    entries = spark.createDataFrame([(1, 0), (2, 2), (3, 9)], "id int, need int")
    out = P.with_retries(lambda e, k: e.withColumn("success", F.col("need") <= k), lambda e, k: e, entries, patches=3)
    assert {r.id: (r.success, r.retries_used) for r in out.collect()} == {1: (True, 0), 2: (True, 2), 3: (False, 3)}
