from __future__ import annotations

import itertools
import os
import re
from collections import Counter

import pytest

from stepweave.llm import queries as Q

from .. import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    oracle.compare(spark, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, name):
    df = Q.queries()[name](spark, oracle.DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_patterns_of_whole_tables_by_brute_force(spark):
    form = lambda x: re.sub("[^a-z]+", "_", (x or "").lower()).strip("_")
    want = set()
    for src, table in (("members", "cluster_members"), ("accepted", "sampler_accepted")):
        seqs = dict(oracle.connect().sql(f"SELECT seq_id, (domain, tokens) FROM {table}").fetchall())
        for domain in {d for d, _ in seqs.values()}:
            lists = [[f for f in map(form, t or []) if f] for d, t in seqs.values() if d == domain]
            held = Counter()
            for s in lists:
                held.update({p for k in (3, 4, 5) for p in itertools.combinations(s, k)} if len(s) < 26 else ())
            want |= {(src, domain, ">".join(p)) for p, n in held.items() if n >= 10 and 8 * n >= len(lists)}
    got = [tuple(r) for r in Q.p2_found(spark, oracle.DATA).select("src", "domain", "pattern").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_patterns_of_medoids(spark, rows, tmp_path):
    none = "domain string, seq_id long, tokens array<string>"
    for name in ("cluster_members", "sampler_accepted"):
        spark.createDataFrame([("d", 1, ["x", "y", "z"])], none).write.parquet(f"{tmp_path}/{name}.parquet")
    info = [("d", i, ["a", "Q" + "q" * i, "b", "C"]) for i in range(10)] * 2 + [("d", 10, None), ("e", 11, ["a", "b", "c"])]
    spark.createDataFrame(info, "domain string, cluster_key long, medoid_sequence array<string>").write.parquet(f"{tmp_path}/cluster_info.parquet")
    assert rows(Q.p2_patterns(spark, str(tmp_path))) == [("medoids", "d", "a>b>c", 10, 11)]


def test_patterns_of_medoids_stand_beside_those_found(spark, rows):
    every = Q.p2_patterns(spark, oracle.DATA)
    assert rows(every.where("src <> 'medoids'").select("src", "domain", "pattern")) == rows(Q.p2_found(spark, oracle.DATA))


def test_ids_of_whole_tables_by_two_public_libraries(spark):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    from stepweave.llm import bpe

    folder = os.path.dirname(bpe.VOCABULARY)
    one = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    two = tiktoken.Encoding("own", pat_str=bpe.WORD.replace(r"\P{White_Space}", r"\S").replace(r"\p{White_Space}", r"\s"), mergeable_ranks=ranks, special_tokens={})
    texts = dict(oracle.connect().sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: list(r.ids) for r in Q.p8_ids(spark, oracle.DATA).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i] == one.encode(text or "", add_special_tokens=False).ids == two.encode_ordinary(text or "")
