from __future__ import annotations

import os

import pytest

from stepweave.llm import queries as Q

from .. import odd, oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
NAMES = sorted(Q.queries())


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    return request.param, odd.write(spark, tmp_path_factory.mktemp(request.param), request.param == "empty")


@pytest.mark.parametrize("name", NAMES)
def test_query_on_odd_tables(spark, folder, name):
    kind, at = folder
    rows = Q.queries()[name](spark, at).collect()
    assert kind == "odd" or rows == []
