import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from bomloom.runtime import release

    release()
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(spark):
    """Run a registered query and its SQL side by side."""
    import glob
    import os
    from collections import Counter

    import duckdb

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return [norm(x) for x in v] if isinstance(v, list) else v

    def run(query, sql, data=DATA):
        df = query(spark, data)
        columns = sorted(df.columns)
        ours = Counter(repr([norm(v) for v in r]) for r in df.select(*columns).collect())
        c = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        theirs = Counter(repr([norm(row[names.index(n)]) for n in columns]) for row in r.fetchall())
        assert ours == theirs
        return sum(ours.values())

    return run
