"""Readers and sinks."""

import os
import tempfile

from rampart.sources import io as IO


def test_flow_csvs_by_name_with_messy_headers(spark):
    d = tempfile.mkdtemp(prefix="rampart-csv-")
    with open(os.path.join(d, "b.csv"), "w", encoding="latin-1") as fh:
        fh.write(" Flow Duration, Label,Flow Duration,Flow Duration.1\n5,Web Attack \x96 Brute Force,9,9\n")
    with open(os.path.join(d, "a.csv"), "w", encoding="latin-1") as fh:
        fh.write(" Label, Flow Duration\nBENIGN,1\n")
    df = IO.read_flow_csvs(spark, d)
    assert [c for c in df.columns if c != "source_file"] == ["Label", "Flow Duration"]
    rows = {r["Label"]: r["Flow Duration"] for r in df.collect()}
    assert rows["BENIGN"] == "1" and rows["Web Attack \x96 Brute Force"] == "5"
    from rampart.operators.clean import clean_labels
    assert {r["Label"] for r in clean_labels(df, "Label").collect()} == {"BENIGN", "Web Attack - Brute Force"}


def test_missing_results_file_is_empty(spark):
    assert IO.read_results_csv(spark, "/tmp/does-not-exist-rampart.csv").count() == 0


def test_round_log_append_and_scan(spark):
    d = tempfile.mkdtemp(prefix="rampart-log-")
    a = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.3)], "run_name string, round int, f1 double")
    IO.append_round_log(a, d)
    IO.append_round_log(spark.createDataFrame([("c", 0, 0.1)], "run_name string, round int, f1 double"), d)
    got = IO.scan_round_logs(spark, d)
    assert {r["run_name"] for r in got.collect()} == {"a"}


def test_meta_round_trip(spark):
    d = tempfile.mkdtemp(prefix="rampart-meta-")
    IO.write_meta(spark, d + "/m", {"x": [1, 2], "y": "z"})
    assert IO.read_meta(spark, d + "/m") == {"x": [1, 2], "y": "z"}


def test_missing_paths_raise(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="rampart-miss-")
    with pytest.raises(FileNotFoundError):
        IO.read_split(spark, d, "train")
    with pytest.raises(FileNotFoundError):
        IO.read_meta(spark, d + "/absent")
    with pytest.raises(FileNotFoundError):
        IO.read_flow_csvs(spark, d)


def test_split_without_label_raises(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="rampart-split-")
    with open(os.path.join(d, "train_group_aware.csv"), "w") as fh:
        fh.write("Row_ID,a\n1,2.0\n")
    with pytest.raises(KeyError):
        IO.read_split(spark, d, "train")
