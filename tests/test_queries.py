"""Every registered query of the image library against its SQL, at the smallest size."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pytest

from lamina.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = ("embeddings", "events", "lineitem", "documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def sent_explosions(df):
    """Generators below a broadcast, but for what is a sum over everything by then (one row)."""
    found, sent = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(re.match(r"[\s:+|\-]*", line).group(0))
        while sent and sent[-1][0] >= depth:
            sent.pop()
        if "BroadcastExchange" in line:
            sent.append((depth, True))
        elif re.search(r"Aggregate\(keys=\[\]", line) and sent:
            sent.append((depth, False))
        elif re.search(r"\bGenerate\b", line) and sent and sent[-1][1]:
            found.append(line.strip())
    return found


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: repr(float(v) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted("|".join(plain(r[k]) for k in order) for r in data)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, str(DATA))
    assert not sent_explosions(found)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert got
    if name in ORACLE_SQL:
        want = sql.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
