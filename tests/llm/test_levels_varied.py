from __future__ import annotations

import itertools
import random

from stepweave.llm import levels as L
from stepweave.llm import varied as V

DOCS = "doc_id long, text string, level int, prior int"
LABELS = "doc_id long, annotator string, level int, text string"


def corpus(n=200):
    rnd = random.Random(6)
    words = {k: [f"{c}{x}" for x in ("alpha", "beta", "gamma", "delta", "omega")] for k, c in zip(range(1, 6), "abcde")}
    truth = [rnd.randint(1, 5) for _ in range(n)]
    return truth, [" ".join(rnd.choice(words[k]) for _ in range(30)) + "." for k in truth]


def test_held_out_accuracy_with_noisy_labels(spark):
    truth, texts = corpus()
    rnd = random.Random(7)
    labels = [(i, a, min(5, max(1, k + rnd.choice([0, 0, 0, 1, -1]))), "x") for i, k in enumerate(truth) if i % 2 for a in "pq"]
    labels += labels[:9] + [(1, "z", None, ""), (None, "z", 3, ""), (3, "z", 9, ""), (10_000, "z", 3, "")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], DOCS)
    scored = L.score(docs, L.train(docs, spark.createDataFrame(labels, LABELS))).collect()
    right = [r.level == truth[r.doc_id] for r in scored if r.doc_id % 2 == 0]
    assert sum(right) >= 0.95 * len(right)
    hard = {r.doc_id for r in scored if r.hard_share > 0.5}
    assert sum((k >= 4) == (i in hard) for i, k in enumerate(truth)) >= 0.97 * len(truth)


def test_mixed_and_no_running_text(spark):
    truth, texts = corpus()
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], DOCS)
    model = L.train(docs, spark.createDataFrame([(i, "p", k, "") for i, k in enumerate(truth)], LABELS))
    easy, hard = "aalpha abeta agamma " * 8, "ealpha ebeta egamma " * 8
    dump = "\n".join(["0|1|2|3", '{"a_b": 1, "ok": true, "n": [1, 2, 3]}', "  ealpha_ebeta(x) -> ealpha: ebeta", "2025-01-01T00:00:00 id=X1"])
    odd = [(1, f"{easy}\n{easy}\n{hard}", 0, 0), (2, f"{easy}\n{hard}\n{hard}", 0, 0), (3, hard.upper(), 0, 0), (4, dump, 0, 0), (5, "", 0, 0), (6, None, 0, 0), (7, " \n\t", 0, 0), (None, hard, 0, 0), (8, "unheard words only here", 0, 0), (9, hard * 3000, 0, 0), (9, hard * 3000, 0, 0)]
    scored = L.score(spark.createDataFrame(odd, DOCS), model)
    assert sorted((r.doc_id or 0) for r in L.mostly_hard(scored).collect()) == [0, 2, 3, 9, 9]
    assert {r.doc_id: r.n_words for r in scored.collect()}[4] == 0
    assert {r.doc_id: r.level for r in scored.collect()}[5] is None


def test_levels_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert L.score(docs, L.train(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "some words", 0, 0)], DOCS)
    assert L.mostly_hard(L.score(one, L.train(one, labels))).count() == 0


def total(lists, places):
    d = V.Distances(lists)
    return sum(d.row(i)[j] for i, j in itertools.combinations(places, 2))


def test_local_search_is_near_the_optimum():
    rnd = random.Random(8)
    for _ in range(20):
        lists = [[rnd.choice("abcdef") for _ in range(rnd.randint(0, 6))] for _ in range(11)]
        best = max(total(lists, c) for c in itertools.combinations(range(11), 4))
        got = V.dispersed(lists, 4)
        assert len({*got}) == 4 and total(lists, got) >= 0.9 * best


def test_core_sets_reach_the_total_of_one_block(spark):
    rnd = random.Random(10)
    lists = [[rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9))] for _ in range(3_000)]
    df = spark.createDataFrame([("d", "m", i, s) for i, s in enumerate(lists)], "domain string, src string, id long, items array<string>")
    one, many = (sum(r.spread for r in V.varied_subset(df, 20, block=b).collect()) for b in (4_000, 300))
    assert many >= 0.995 * one > 0


def test_memory_of_many_features():
    import tracemalloc

    lists = [[f"s{(i * 7 + k * k) % 5000}" for k in range(40)] for i in range(3_000)]
    tracemalloc.start()
    assert len({*V.dispersed(lists, 10)}) == 10
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 120


def test_small_groups_come_out_beside_large_ones(spark):
    rnd = random.Random(9)
    schema = "domain string, src string, id long, items array<string>, copies int, bucket int"
    big = [("d", "m", i, ["a", "b", "c", "d", rnd.choice("abcd")], 0, 0) for i in range(2000)]
    small = [("d", "m", 5000 + i, [f"s{i}", f"t{i}"], 0, 0) for i in range(7)]
    odd = [(None, None, None, None, 0, 0), (None, "m", 1, [], 0, 0), ("e", "m", 1, ["x", None], 0, 0)]
    df = spark.createDataFrame(big + small + odd, schema)
    for block in (4000, 4):
        got = V.varied_subset(df, 8, block=block).collect()
        d = [r for r in got if r.domain == "d"]
        assert len(d) == 8 and sum(r.id >= 5000 for r in d) == 7
        assert [(r.copies, r.id) for r in got if r.domain is None] == [(2, None)]
        assert [(r["items"], r.spread) for r in got if r.domain == "e"] == [(["x"], 0.0)]
    assert V.varied_subset(spark.createDataFrame([], schema), 5).count() == 0
