import os
import re
import subprocess
import sys

import __spark_entry__ as contract
import check
import pytest
from conftest import SF

from jobspark.plans import queries

NO_SQL = set()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_query_has_sql():
    assert set(queries.QUERIES) - set(contract.oracle_sql()) == NO_SQL
    assert set(queries.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows_equal_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "similarity" in df.columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(
    set(queries.QUERIES) - {
        "refresh_stream", "refresh_run", "feedback_stream", "application_stream",
        "bookmark_stream", "user_stream"}))
def test_plans_have_no_cross_join(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search("BatchEvalPython|ArrowEvalPython", text)


@pytest.mark.parametrize("name", [
    "prepare_postings", "keyword_filter_capped", "semantic_search_topk", "default_profile",
    "relevant_postings_per_profile"])
def test_rows_are_cut_per_key_before_the_shuffle(spark, name):
    assert "Partial" in plan(contract.queries()[name](spark, SF)).split("WindowGroupLimit", 1)[1]


def test_scans_read_only_what_is_used(spark):
    text = plan(contract.queries()["stage_funnel"](spark, SF))
    assert "ReadSchema: struct<o_orderpriority:string>" in text
    slim = plan(contract.queries()["model_coverage"](spark, SF))
    assert "embedding" not in "".join(re.findall("ReadSchema: [^\n]*", slim))


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """A session started elsewhere, whose workers cannot import the package."""
    script = tmp_path / "other.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {check.ROOT!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
for name in ("semantic_search_topk", "relevant_postings_per_profile"):
    assert contract.queries()[name](spark, {SF!r}).count() > 0
print("fine")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "fine", done.stderr[-2000:]


def test_notes_are_counted_in_small_parts(spark):
    """Keys that hardly repeat are dealt out before they are grouped."""
    from jobspark.sources import tables

    df = spark.range(1000)
    assert tables.dealt(df, "id", rows=10).rdd.getNumPartitions() == 100
    plan = queries.note_ownership(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
