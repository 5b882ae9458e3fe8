"""Registered traversals without a cap, against plain Python over the smallest tables and against their SQL."""

import duckdb
import pytest

from tracewarden.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chains():
    """The event ids and types of each user in order; the edges of the events graph link neighbours."""
    rows = duckdb.sql(f"SELECT user_id, event_id, event_type FROM '{SF}/events.parquet' ORDER BY user_id, ts, event_id").fetchall()
    found = {}
    for user, event, kind in rows:
        found.setdefault(user, []).append((f"e{event}", kind))
    return list(found.values())


def rows_of(spark, name):
    df = catalog.queries()[name](spark, SF)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    found = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    got = df.collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted((tuple(r) for r in found.fetchall()), key=str)
    return got


def test_reach_to_the_end(spark, chains):
    want = {c[0][0]: (len(c) - 1, sum(kind == "purchase" for _, kind in c[1:])) for c in chains}
    assert max(n for n, _ in want.values()) > 64
    assert {r["source_id"]: (r["reaches"], r["sinks"]) for r in rows_of(spark, "reach_counts_whole")} == want


def test_flow_to_the_end(spark, chains):
    first = f"e{duckdb.sql(f"SELECT arg_min(event_id, (ts, event_id)) FROM '{SF}/events.parquet' WHERE event_type = 'signup'").fetchall()[0][0]}"
    chain = next([i for i, _ in c] for c in chains if first in [i for i, _ in c])
    after = chain[chain.index(first) + 1 :]
    assert len(after) > 12
    assert {r["id"]: r["depth"] for r in rows_of(spark, "trace_flow_whole")} == {i: d for d, i in enumerate(after, 1)}


def test_flow_of_all_signups(spark, chains):
    want = {(i, j): d for c in chains for k, (i, kind) in enumerate(c) if kind == "signup" for d, (j, _) in enumerate(c[k + 1 :], 1)}
    assert len({i for i, _ in want}) > 100
    assert {(r["source_id"], r["id"]): r["depth"] for r in rows_of(spark, "trace_flow_all")} == want


def test_blast_of_all_purchases(spark, chains):
    want = {(i, j) for c in chains for k, (i, kind) in enumerate(c) if kind == "purchase" for j, _ in c[: k + 1]}
    assert len(want) > 20 * len({i for i, _ in want})
    assert {(r["node_id"], r["id"]) for r in rows_of(spark, "blast_nodes_all")} == want
    kinds = dict(x for c in chains for x in c)
    through = rows_of(spark, "blast_paths_all")
    assert len({r["node_id"] for r in through}) > 10
    assert all(kinds[r["node_id"]] == "purchase" and r["node_id"] in r["path"].split(">") for r in through)
