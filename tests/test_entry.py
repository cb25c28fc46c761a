import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "typing_zones", "review_sync", "hierarchy_closure", "semantic_diff", "minted_iris", "page_classes", "threshold_sweep", "user_sessions",
    "ontoclean_violations", "pitfalls", "class_targets", "version_history", "settled_branches", "conflict_findings", "reading_order", "definitional_passages",
    "reload_choice", "training_examples",
])
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    shown = [df[columns].astype(str).replace({"nan": "None", "<NA>": "None"}).sort_values(columns).reset_index(drop=True) for df in (ours, theirs)]
    assert shown[0].equals(shown[1])
