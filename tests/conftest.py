from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wayfare.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=2)
    # Tables are tiny: interpreting the plans is quicker than compiling them.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    """Rows as a sorted list of tuples, doubles rounded."""
    names = list(columns) or sorted(df.columns)

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        return tuple(v) if isinstance(v, list) else v

    return sorted([tuple(plain(r[c]) for c in names) for r in df.collect()], key=repr)
