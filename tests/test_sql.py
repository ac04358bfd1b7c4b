"""Core queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from mediasift import queries as Q

FOLDER = os.environ.get("MEDIASIFT_TEST_DATA", "/root/testdata/sf0.001")
NAMES = ["src_02", "prj_04", "prj_06", "prj_08", "flt_04", "joi_02", "agg_01", "agg_04", "agg_05", "win_01", "win_03", "srt_01", "prf_01", "set_01", "set_04", "str_01", "str_02", "str_04", "hsh_02", "grf_01", "grf_02", "joi_07", "flt_12", "mth_02", "agg_15", "joi_04", "stm_03"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = Q.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({Q.oracle_sql()[name]})")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(v) for v in r]) for r in cur.fetchall())
