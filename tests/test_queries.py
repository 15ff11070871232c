"""Every graph query against its SQL on the smallest tables."""

import heapq
import math
from pathlib import Path

import duckdb
import pytest
from gridgraph.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    if name in ORACLE_SQL:
        found = con.execute(ORACLE_SQL[name])
        told = [c[0] for c in found.description]
        assert sorted(told) == names
        at = [told.index(n) for n in names]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_whole_graphs(spark, con):
    """Paths and components of the whole flow, whose vertices have several edges out."""
    edges = con.execute("SELECT src, dst, count(*) FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL").fetchall()
    parts = [r[0] for r in con.execute("SELECT p_partkey FROM part").fetchall()]
    after = {p: {} for p in parts}
    for s, t, n in edges:
        after[s][t] = n
    assert max(map(len, after.values())) > 1
    far = dict.fromkeys(parts, math.inf) | {0: 0.0}
    due = [(0.0, 0)]
    while due:
        d, at = heapq.heappop(due)
        if d == far[at]:
            for t, n in after[at].items():
                if d + n < far[t]:
                    far[t] = d + n
                    heapq.heappush(due, (d + n, t))
    assert {r.id: r.attr for r in QUERIES["sssp"](spark, DATA).collect()} == far
    both = {p: set(after[p]) | {s for s in parts if p in after[s]} for p in parts}

    def reach(start, ways):
        seen, due = {start}, [start]
        while due:
            for t in ways[due.pop()]:
                if t not in seen:
                    seen.add(t)
                    due.append(t)
        return seen

    assert {r.id: r.attr for r in QUERIES["connected_components_whole"](spark, DATA).collect()} == {p: min(reach(p, both)) for p in parts}
    reached = {p: reach(p, after) for p in parts}
    assert {r.id: r.attr for r in QUERIES["scc"](spark, DATA).collect()} == {p: min(q for q in reached[p] if p in reached[q]) for p in parts}
    assert len(QUERIES["personalized_tol"](spark, DATA).collect()) == len(parts)
