import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from marginalia.runtime import release

    release()
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def compare(spark):
    """Whether a query and its SQL give the same columns, types and rows on a folder of tables."""
    import duckdb

    def run(query, sql, folder, tmp):
        con = duckdb.connect()
        for path in Path(folder).iterdir():
            con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
        query(spark, folder).write.mode("overwrite").parquet(f"file://{tmp}")
        found = []
        for text in (f"SELECT * FROM read_parquet('{tmp}/*.parquet')", sql):
            cursor = con.execute(text)
            columns = [(c[0], str(c[1])) for c in cursor.description]
            order = sorted(range(len(columns)), key=lambda i: columns[i][0])
            found.append(([columns[i] for i in order], sorted(str([row[i] for i in order]) for row in cursor.fetchall())))
        return found[0], found[1]

    return run
