import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnspark.session import build_session
    s = build_session("local[8]", 8, app_name="churnspark-tests")
    yield s


def _duck(sf_dir):
    import duckdb
    from churnspark.sources.tables import TABLES, table_path
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


@pytest.fixture(scope="session")
def duck():
    return _duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    return _duck(SF_MID)
