"""Round-log reporting: final / best-by-validation selection and summaries."""

import pytest

from rampart.operators import report as RP

SCHEMA = ("run_name string, attack string, round int, aggregation string, clients int, partition_alpha double, "
          "accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double, val_macro_f1 double, "
          "f1 double")


@pytest.fixture(scope="module")
def rounds(spark):
    rows = [
        ("r1", "none", 0, "fedavg", None, 0.0, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1),
        ("r1", "none", 1, "fedavg", 3, 0.0, 0.9, 0.5, 0.5, 0.8, 0.6, 0.5),
        ("r1", "none", 2, "fedavg", 3, 0.0, 0.9, 0.45, 0.45, 0.8, 0.55, 0.45),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_final_and_best_round(rounds):
    b = {r["Selection"]: r for r in RP.benchmark_rows(rounds).collect()}
    assert b["final"]["Round"] == 2 and b["final"]["Macro F1"] == pytest.approx(0.45)
    assert b["best_val_macro_f1"]["Round"] == 1 and b["best_val_macro_f1"]["Macro F1"] == pytest.approx(0.5)
    assert b["final"]["Model"] == "Federated logistic_sgd (fedavg, 3 clients, IID, 2 rounds)"


def test_best_round_tie_goes_to_earliest(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 1.0), ("a", 2, 0.5, 2.0)], "run_name string, round int, val_macro_f1 double, f1 double")
    assert RP.best_round(df, ["f1"]).head()["round"] == 1


def test_rounds_to_95(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.96), ("a", 2, 1.0), ("b", 0, 0.01), ("b", 1, 0.02)],
                               "run_name string, round int, f1 double")
    got = {r["run_name"]: r["rounds_to_95pct_final_f1"] for r in RP.rounds_to_fraction(df).collect()}
    assert got == {"a": 1, "b": None}


def test_unknown_clients_show_question_mark(spark):
    from pyspark.sql import functions as F
    v = spark.range(1).select(RP.model_name(F.lit("krum"), F.lit(None).cast("int"), F.lit(0.5), F.lit(3)).alias("m")).head()["m"]
    assert v == "Federated logistic_sgd (krum, ? clients, non-IID a=0.5, 3 rounds)"


def test_summary_of_a_training_run_log(spark):
    """A log written by the round loop: logged elapsed time and every key / final column carried."""
    from rampart.operators import report as RP

    rows = [("r", "krum", "none", 0.0, 0.0, 42, rnd, None if rnd == 0 else 5, 0.5 + rnd / 10, 0.6, 0.7, 0.4 + rnd / 10,
             0.1, 0.3, 1.5 * rnd, None if rnd == 0 else 0.01, None if rnd == 0 else 800, None if rnd == 0 else 0,
             None if rnd == 0 else 1) for rnd in range(3)]
    df = spark.createDataFrame(rows, "run_name string, aggregation string, attack string, malicious_fraction double, "
                               "partition_alpha double, seed int, round int, clients int, accuracy double, "
                               "precision double, recall double, f1 double, fpr double, loss double, elapsed_s double, "
                               "agg_time_s double, bytes_up bigint, malicious_in_round int, malicious_kept int")
    s = RP.run_summary(df).collect()[0].asDict()
    assert s["wall_time_s"] == 3.0 and s["clients"] == 5 and s["seed"] == 42 and s["partition_alpha"] == 0.0
    assert s["accuracy"] == 0.7 and s["loss"] == 0.3 and s["rounds"] == 2
    assert s["rounds_to_95pct_final_f1"] == 2 and abs(s["mean_agg_time_ms"] - 10.0) < 1e-9
    assert abs(s["total_comm_MB"] - 4 * 800 / 1e6) < 1e-12 and s["malicious_kept"] == 1.0


def test_benchmark_names_format_alpha_like_python(spark):
    """Clean runs with partition alpha 1.0 and 1e-05: names read 'a=1' and 'a=1e-05'."""
    from rampart.operators import report as RP

    rows = []
    for run, alpha in (("p", 1.0), ("q", 1e-05), ("r", 0.0)):
        for rnd in range(3):
            rows.append((run, "fedavg", "none", alpha, rnd, None if rnd == 0 else 5, 0.9, 0.8, 0.7, 0.6,
                         0.1 * rnd))
    df = spark.createDataFrame(rows, "run_name string, aggregation string, attack string, partition_alpha double, "
                               "round int, clients int, accuracy double, balanced_accuracy double, macro_f1 double, "
                               "weighted_f1 double, val_macro_f1 double")
    names = {r["Model"] for r in RP.benchmark_rows(df).collect()}
    assert names == {"Federated logistic_sgd (fedavg, 5 clients, non-IID a=1, 2 rounds)",
                     "Federated logistic_sgd (fedavg, 5 clients, non-IID a=1e-05, 2 rounds)",
                     "Federated logistic_sgd (fedavg, 5 clients, IID, 2 rounds)"}


def test_alpha_text_is_six_significant_digits(spark):
    values = [1.0, 0.5, 10.0, 100000.0, 1000000.0, 1e-05, 0.0001, 0.00012345, 123456.0, 1234567.0, 0.1, 2.50, 1e300, 3.14159265, 99.9999, 1e-10]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(RP.alpha_text(df.x)).collect()] == [f"{v:g}" for v in values]
