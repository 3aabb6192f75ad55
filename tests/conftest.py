import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))



@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    if isinstance(v, float):
        return format(v, ".9g")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql():
    """Compare a DataFrame with SQL over the tables of a folder, as sets of rows with columns by name."""
    import duckdb

    def check(df, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        want = con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        mine = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        at = [want.columns.index(c) for c in names]
        assert mine == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())

    return check
