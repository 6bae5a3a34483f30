from __future__ import annotations

import pytest

from stepweave.session import build, ship


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture
def rows():
    def of(df) -> list[tuple]:
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return of
