from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


def local_session():
    from keelstone.session import build_session

    spark = build_session(
        "keelstone-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="keelstone-test-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    from keelstone.session import clear_scratch

    session = local_session()
    yield session
    clear_scratch(session)
    session.stop()
