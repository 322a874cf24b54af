import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        """Two pandas frames with the same columns and rows, in any order."""
        columns = sorted(b.columns)
        assert sorted(a.columns) == columns
        x, y = (f[columns].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"}).sort_values(columns).reset_index(drop=True) for f in (a, b))
        assert len(x) == len(y)
        assert x.equals(y), (x[(x != y).any(axis=1)].head(3).to_dict("records"), y[(x != y).any(axis=1)].head(3).to_dict("records"))

    return check
