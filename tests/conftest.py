import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    """A value as text, numbers of any type alike."""
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return ""
    if hasattr(v, "tolist") and not hasattr(v, "strftime"):
        v = v.tolist()
    if isinstance(v, (bool, int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted("|".join(map(plain, r)) for r in df[cols].itertuples(index=False, name=None))
    a, b = rows(got), rows(want)
    assert a == b, (len(a), len(b), sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
