import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftline.runtime import session  # noqa: E402

DATA = os.environ.get("SIFTLINE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return session("4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    import numpy as np

    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, con, sql):
    """Rows of a DataFrame and of SQL with the same columns, as sorted lists of texts."""
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    return ours, theirs
