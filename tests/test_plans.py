"""Plan shape of the library's registered queries: no cross products or nested-loop joins, no
row-at-a-time Python UDFs, scans that read only the columns they need; and the records that
samples and partitions really shuffle, eager jobs included."""

import glob
import json
import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in entry.queries().items():
        if not re.match(r"op\d+_|pipeline$", name):  # the corpus operators have tests of their own
            out[name] = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cross_products_or_row_udfs(plans):
    bad = {n: sorted(set(FORBIDDEN.findall(p))) for n, p in plans.items() if FORBIDDEN.search(p)}
    assert not bad


@pytest.mark.parametrize("name,absent", [
    ("quality_id_overlap", "text:string"),          # the id check never reads document texts
    ("profile_label_distribution", "value:double"),  # label counts read the label source only
    ("features_label_map", "props:string"),
])
def test_scans_are_pruned(plans, name, absent):
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:,|\s|$)", plans[name])
    assert schemas and all(absent not in s for s in schemas)


SHUFFLES = """
import json, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", "file://" + sys.argv[1]).config("spark.eventLog.rolling.enabled", "false")
         .config("spark.eventLog.compress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as entry
for name in sys.argv[3:]:
    spark.sparkContext.setLocalProperty("query", name)
    entry.queries()[name](spark, sys.argv[2]).count()
spark.stop()
"""


def test_samples_and_partitions_shuffle_few_records(tmp_path):
    """All jobs of a query, those that run while it is built too, shuffle less than a tenth of
    the input's 100,000 rows: boundary searches move counts of key prefixes, never the rows."""
    names = ["sampling_uniform", "sampling_stratified_min", "sampling_undersample", "silo_iid_partition"]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SHUFFLES, str(tmp_path), "/root/testdata/sf0.1", *names], cwd=root, check=True, capture_output=True,
                   env=os.environ | {"PYTHONPATH": root}, timeout=600)
    stage_of, written = {}, dict.fromkeys(names, 0)
    for line in open(glob.glob(f"{tmp_path}/*")[0]):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart" and (q := e["Properties"].get("query")):
            stage_of.update(dict.fromkeys(e["Stage IDs"], q))
        elif e["Event"] == "SparkListenerTaskEnd" and (q := stage_of.get(e["Stage ID"])):
            written[q] += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Records Written"]
    assert all(0 < n < 10_000 for n in written.values()), written
