import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from waveloom.session import session

    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(a, b):
    import pandas as pd

    def norm(d):
        d = d[sorted(d.columns)].copy()
        for c in d.columns:
            d[c] = d[c].astype("float64") if pd.api.types.is_numeric_dtype(d[c]) or pd.api.types.is_bool_dtype(d[c]) else d[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
        return d.sort_values(sorted(d.columns)).reset_index(drop=True)

    pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False, rtol=1e-9, atol=1e-9)
