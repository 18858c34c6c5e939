"""Every query with an oracle against DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import pytest

from lexigrove.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


#: The tables' invented words name nobody that a pronoun could stand for.
EMPTY = {"coref_chains"}


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_oracle(spark, db, name):
    made = catalogue.QUERIES[name](spark, SF)
    wanted = db.execute(catalogue.ORACLE[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(made.columns)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs_without_oracle(spark, name):
    made = catalogue.QUERIES[name](spark, SF)
    found = made.collect()
    assert made.columns and (found or name in EMPTY)
    if name == "parse_tree_nodes":
        known = {(r["conv_id"], r["turn"], r["sent_index"], r["node_id"]): r for r in found}
        for r in found:
            above = known.get((r["conv_id"], r["turn"], r["sent_index"], r["parent_id"]))
            assert (r["label"] == "ROOT") == (above is None) and r["b"] < r["e"]
            assert above is None or (above["node_id"] < r["node_id"] and above["b"] <= r["b"] and r["e"] <= above["e"])
            assert r["token_index"] is None or (r["b"], r["e"]) == (r["token_index"] - 1, r["token_index"])
