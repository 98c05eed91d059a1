import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from jobspark import session
    built = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    yield session.configure(built)
    built.stop()


def rows(df, *order):
    """Rows as tuples, in column order, sorted."""
    if order:
        df = df.orderBy(*order)
        return [tuple(r) for r in df.collect()]
    return sorted((tuple(r) for r in df.collect()), key=repr)
