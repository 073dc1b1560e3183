"""Evaluation and statistics edge rules (FIXTURES §3: evaluation, statistics)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import evaluate as EV
from nearfield.operators import stats as ST

LAB = "item long, target string, y_true int"
HIT = "target string, item long"


def _eval(spark, labels, hits):
    l = spark.createDataFrame(labels, LAB)
    h = spark.createDataFrame(hits, HIT)
    return {r.target: r for r in EV.evaluate(l, h, "item").collect()}


def test_label_table_drives(spark):
    labels = [(1, "t", 1), (2, "t", 0), (3, "t", 1), (3, "t", 1)]  # duplicate label row
    hits = [("t", 1), ("t", 1), ("t", 2), ("t", 99)]  # duplicate hit, unlabelled hit
    r = _eval(spark, labels, hits)["t"]
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 2, 0)
    assert r.precision == 0.5 and r.recall == pytest.approx(1 / 3)
    assert r.specificity == 0.0 and r.far == 1.0


def test_zero_denominators(spark):
    r = _eval(spark, [(1, "t", 1), (2, "t", 0)], [("x", 1)])["t"]  # no hits
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1_score == 0.0
    r = _eval(spark, [(1, "t", 0), (2, "t", 0)], [("t", 1)])["t"]  # no positives
    assert r.recall == 0.0 and r.frr is None
    r = _eval(spark, [(1, "t", 1), (2, "t", 1)], [("t", 1)])["t"]  # no negatives
    assert r.specificity is None and r.far is None


def test_complements(spark):
    rng = np.random.default_rng(0)
    labels = [(i, "t", int(rng.integers(0, 2))) for i in range(200)]
    hits = [("t", int(i)) for i in rng.choice(200, 80, replace=False)]
    r = _eval(spark, labels, hits)["t"]
    assert r.specificity + r.far == pytest.approx(1.0)
    assert r.recall + r.frr == pytest.approx(1.0)


def test_degenerate_flag(spark):
    pred = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, 0)], "target string, y_true int, y_pred int")
    got = {r.target: r.is_degenerate for r in EV.degenerate_flags(pred, ["target"]).collect()}
    assert got == {"a": True, "b": False}


def test_published_statistics(spark):
    df = spark.createDataFrame([(1, 790.639067), (1, 795.220779), (1, 795.075685)], "g int, v double")
    r = ST.latency_summary(df, "v", ["g"]).first()
    assert r.mean == pytest.approx(793.645177, abs=1e-6)
    assert r.std == pytest.approx(2.126466, abs=1e-6)
    assert r.p90 == pytest.approx(795.191760, abs=1e-6)


def test_single_row_statistics(spark):
    r = ST.latency_summary(spark.createDataFrame([(1, 5.0)], "g int, v double"), "v", ["g"]).first()
    assert (r.n, r.mean, r.std, r.p90, r.p99) == (1, 5.0, 0.0, 5.0, 5.0)


@pytest.mark.parametrize("single_task_rows", [None, 0])  # window path / range-shuffle path
def test_percentiles_with_hot_group_match_numpy(spark, single_task_rows):
    rng = np.random.default_rng(1)
    rows = [(0, float(x)) for x in rng.exponential(3.0, 3000)]  # hot group
    rows += [(g, float(x)) for g in range(1, 6) for x in rng.normal(10, 2, 37)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {
        r.g: r
        for r in ST.exact_percentiles(
            df, "v", ["g"], (50, 90, 99), num_partitions=7, single_task_rows=single_task_rows
        ).collect()
    }
    for g in range(6):
        vals = np.array([v for k, v in rows if k == g])
        for p in (50, 90, 99):
            assert got[g][f"p{p}"] == pytest.approx(np.percentile(vals, p), rel=1e-12)


@pytest.mark.parametrize("single_task_rows", [None, 0])
def test_iteration_gaps_and_deltas(spark, single_task_rows):
    df = spark.createDataFrame(
        [("r", 1, 10.0, True), ("r", 2, 12.0, False), ("r", 3, 11.0, True), ("s", 1, 5.0, True)],
        "run string, t int, v double, ok boolean",
    )
    it = {
        (r.run, r.t): r.iteration
        for r in ST.iteration_numbers(df, ["run"], ["t"], "ok", single_task_rows).collect()
    }
    assert it == {("r", 1): 1, ("r", 3): 3, ("s", 1): 1}
    d = {
        (r.run, r.t): r.delta
        for r in ST.deltas(df, ["run"], ["t"], "v", single_task_rows=single_task_rows).collect()
    }
    assert d[("r", 1)] is None and d[("r", 2)] == 2.0 and d[("r", 3)] == -1.0


def test_throughput_zero_elapsed(spark):
    df = spark.createDataFrame([("a",)], "k string").select(
        "k", F.current_timestamp().alias("ts"), F.lit(True).alias("ok")
    )
    r = ST.throughput(df, ["k"], "ts", "ok").first()
    assert r.rps == 0.0 and r.successful_requests == 1


@pytest.mark.parametrize("single_task_rows", [None, 0])
def test_ordered_positions_both_paths(spark, single_task_rows):
    from nearfield.operators.ranking import ordered_positions

    df = spark.range(0, 500).selectExpr("id", "id % 3 AS g", "rand(7) AS r")
    out = ordered_positions(df, ["g"], ["r", "id"], "pos", single_task_rows=single_task_rows)
    rows = out.collect()
    for g in range(3):
        got = sorted((r.r, r.id, r.pos) for r in rows if r.g == g)
        assert [p for _, _, p in got] == list(range(len(got)))
    glob = ordered_positions(df, [], ["id"], "pos", single_task_rows=single_task_rows).collect()
    assert sorted((r.id, r.pos) for r in glob) == [(i, i) for i in range(500)]
