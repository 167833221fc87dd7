import duckdb
import pytest

import __spark_entry__ as entry_points
from sylva.operators.validate import violations
from sylva.plans import api_queries, queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES, ORACLES = queries.QUERIES | api_queries.QUERIES, queries.ORACLES | api_queries.ORACLES


def as_rows(frame):
    import pandas as pd

    def text(x):
        if isinstance(x, pd.Timestamp):
            return x.date().isoformat()
        if isinstance(x, float) and x.is_integer():
            x = int(x)
        return str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).map(text).values.tolist()))


def test_names():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(queries.ORACLES) == set(queries.QUERIES)
    assert set(api_queries.ORACLES) == set(api_queries.QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["orders_items_long", "nodes_customer", "analyst_orders", "analyst_misc", "wide_missing", "text_nodes", "stream_callbacks", "default_names", "xsd_declarations", "node_violations"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, expected = QUERIES[name](spark, SMALL).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert as_rows(found) == as_rows(expected)
    spark.catalog.clearCache()


def whole(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, expected = QUERIES[name](spark, SMALL).toPandas(), db.execute(ORACLES[name]).df()
    assert as_rows(found) == as_rows(expected)
    spark.catalog.clearCache()
    return found, db


def test_row_candidates_cover_every_order(spark):
    found, db = whole(spark, "row_candidates")
    counts = dict(zip(found.path, found.occurrences, strict=True))
    assert counts["orders/order"] == db.execute("SELECT count(*) FROM orders").fetchone()[0]


def test_row_candidates_keep_no_nodes(spark):
    """The candidates come of one aggregation: neither the nodes nor the values of all documents are kept."""
    spark.catalog.clearCache()
    queries.row_candidates(spark, SMALL).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


@pytest.mark.parametrize("name", ["sink_parquet", "sink_csv"])
def test_sinks_take_every_customer(spark, name):
    found, db = whole(spark, name)
    assert len(found) == db.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_what_grows_with_documents_is_not_broadcast(spark):
    """Spark can't know how many nodes a kernel makes of a document, nor how long a document is, so its own choice may be a broadcast."""
    nations = queries.nation_documents(spark, SMALL)
    for made in (nations, queries.order_documents(spark, SMALL), queries.order_region_documents(spark, SMALL), violations(queries.nodes_of(nations))):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
