"""Every query with a SQL counterpart against DuckDB, on the smallest tables; the others must give rows."""

import duckdb
import pytest

from quillgraph.plans import graph_queries, registry, source_queries, synth_queries, vector_queries  # noqa: F401  (they register)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["wl_colours", "sample_kmeans", "modularity_clusters", "random_walks", "synthetic_graph", "betweenness"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    columns = sorted(df.columns)
    rows = [tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df[columns].astype(object).values.tolist()]
    return columns, sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, duck, name):
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(duck.sql(registry.oracles()[name]).df())


@pytest.mark.parametrize("name", QUICK)
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "of"), [("wl_colours", "ego"), ("random_walks", "start")])
def test_every_node(spark, name, of):
    nodes = {r[0] for r in graph_queries.co_order(spark, SF).nodes.select("node_id").collect()}
    assert {r[0] for r in registry.queries()[name](spark, SF).select(of).collect()} == nodes


def test_flagship(spark):
    rows = {r["budget"]: r["f1"] for r in graph_queries.flagship(spark, SF).collect()}
    assert sorted(rows) == [32, 64, 96, 128] and all(0 <= v <= 1 for v in rows.values())
