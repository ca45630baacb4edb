import duckdb
import pytest

import __spark_entry__ as entry
from linkforge.plans import queries as linkage
from linkforge.scratch import Scratch, close_all, shared_dir

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "orders", "customer", "events", "labels", "nation")
#: Queries that link the feed anew are held against their SQL by one of each kind; the driver runs all of them.
SLOW = {"auto_link_clusters", "reviewed_registry", "review_pairs", "batch_counts", "registry_json", "singletons", "best_evidence", "queue_json", "comparison_view", "score_bands", "feature_bands"}


@pytest.mark.parametrize("name", [n for n in linkage.queries() if n not in SLOW])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(linkage.oracle_sql()[name]).df()
    got = linkage.queries()[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else None if v is None or v != v else v for v in r]) for r in df[cols].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_registry_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(linkage.oracle_sql()) == set(linkage.queries())


def test_scratch_goes(spark):
    import os

    scratch = Scratch(spark, "t")
    df = scratch.keep(spark.range(5), "a")
    other = scratch.keep(spark.range(6), "b")
    scratch.drop(df)
    assert other.count() == 6 and [x.split("-")[0] for x in os.listdir(scratch.root)] == ["b"]
    close_all(spark)
    assert not os.path.exists(scratch.root) and os.path.exists(shared_dir(spark))
