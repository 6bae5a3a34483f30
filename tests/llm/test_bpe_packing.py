from __future__ import annotations

import base64
import random
from collections import Counter, defaultdict

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stepweave.llm import bpe as B
from stepweave.llm import packing as K

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.VOCABULARY, "rb"))}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(open(B.VOCABULARY, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r  \x1c\x85'sabé1漢<|>.", max_size=60)), max_size=5))
def test_same_ids_as_the_public_library(texts):
    assert list(ENCODER.encode(texts)) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_long_words_blanks_and_special_strings():
    texts = ["a" * 20_000, " " * 20_000 + "x", "ab" * 9_000, "<|endoftext|>", "漢" * 5_000, "x\n" * 5_000]
    assert list(ENCODER.encode(texts)) == [REFERENCE.encode_ordinary(t) for t in texts]
    assert all(len(w) <= B.LONG for w in ENCODER.words)


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "Hello wörld", 0), (2, "", 0), (3, None, 0), (None, "a b", 0), (1, "Hello wörld", 0)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in B.encode(df).collect()), key=repr)
    assert got == sorted([(1, REFERENCE.encode_ordinary("Hello wörld"))] * 2 + [(2, []), (3, []), (None, REFERENCE.encode_ordinary("a b"))], key=repr)
    assert all(REFERENCE.decode(ids) == {1: "Hello wörld", None: "a b"}.get(i, "") for i, ids in got)
    assert sorted(r.n_tokens for r in B.encode(df, counts_only=True).collect()) == sorted(len(i) for _, i in got)
    assert B.encode(df.where("false")).count() == 0


@pytest.mark.parametrize("group", [20_000, 50])
def test_containers_hold_everything_once(spark, group):
    rnd = random.Random(3)
    data = [(i, rnd.choice([0, 5, 37, 90, 100, 101, 250, 1000, None, -3, rnd.randint(1, 99)]), 1) for i in range(600)] + [(7, 50, 1), (7, 50, 1), (None, 60, 1)]
    got = K.fill_containers(spark.createDataFrame(data, "doc_id long, size long, part int"), 100, group=group).collect()
    fill, per_doc = Counter(), defaultdict(list)
    for r in got:
        fill[r.container] += r.size
        per_doc[r.doc_id].append((r.part, r.start, r.size))
    assert max(fill.values()) <= 100 and all(fill[r.container] == r.fill for r in got)
    for i, size, _ in data[:600]:
        if i == 7:
            continue
        parts, size = sorted(per_doc[i]), max(size or 0, 0)
        assert sum(s for *_, s in parts) == size and len(parts) == max(1, -(-size // 100))
        assert [a for _, a, _ in parts] == [100 * k for k in range(len(parts))]
    assert sum(s for *_, s in per_doc[7]) == max(data[7][1] or 0, 0) + 100
    bound = -(-sum(fill.values()) // 100)
    assert len(fill) <= bound * 1.05 + 2


def test_packing_of_nothing_and_of_nothing_but_zeros(spark):
    empty = spark.createDataFrame([], "doc_id long, size long")
    assert K.fill_containers(empty, 10).count() == 0
    zeros = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, size long")
    assert len({r.container for r in K.fill_containers(zeros, 10).collect()}) == 1


def test_sum_of_squares_prefers_the_smallest_sum():
    p = K.SumOfSquares(10)
    a, b, c = p.place(6), p.place(6), p.place(4)
    assert a != b and c in (a, b) and p.place(4) in (a, b) and p.place(10) == 2
