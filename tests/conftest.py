from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("SIEVEWORK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from sievework.session import local_session, ship_package

    s = local_session("tests", 8, 8)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con
