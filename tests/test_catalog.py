"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from meshweave.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """Values that compare alike whichever engine they come from."""
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    return round(float(x), 9) if isinstance(x, (float, np.floating)) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(plain(list(r))) for r in df.select(*columns).collect())
    relation = db.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(plain([r[i] for i in order])) for r in relation.fetchall())
