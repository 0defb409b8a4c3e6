import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a query and of its SQL over the smallest tables."""
    import duckdb

    def compare(spark, name, sf="sf0.001"):
        import __spark_entry__ as entry

        sf_dir = f"/root/testdata/{sf}"
        con = duckdb.connect()
        for t in sorted(os.listdir(sf_dir)):
            con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
        got = entry.queries()[name](spark, sf_dir)
        want = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        plain = lambda rows: sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
        assert plain(got.select(*columns).collect()) == plain(want.fetchall())

    return compare
