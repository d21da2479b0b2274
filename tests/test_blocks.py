"""Halo windows, block numbering, filling and quantile selection against plain windows and numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators.quantiles import quantiles
from strandline.operators.series import filled_forward, numbered, over_halo, rolling_median


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = random.Random(8), []
    for key, n in (("a", 300), ("b", 1), ("c", 7), (None, 40)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 1, 3, 90])
            rows.append((key, at - 50, rng.choice([None, None, rng.gauss(0, 1)])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, seq long, v double").cache()


def same(got, want):
    key = lambda r: (str(r[0]), r[1])
    a, b = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)
    assert a == b and a


@pytest.mark.parametrize("block", [1, 1 << 16])
def test_numbers_and_filling_over_blocks(series, block):
    w = Window.partitionBy("k").orderBy("seq")
    same(numbered(series, ["k"], ["seq"], "n", block).select("k", "seq", "n"), series.select("k", "seq", (F.row_number().over(w) - 1).cast("long")))
    filled = filled_forward(series, "v", "f", ["k"], "seq", block).select("k", "seq", "f")
    same(filled, series.select("k", "seq", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))))


@pytest.mark.parametrize(("before", "after", "size"), [(3, 0, 4), (4, 4, 9), (2, 1, 1000)])
def test_halo_windows_equal_plain_windows(series, before, after, size):
    frame = lambda w: {"xs": F.collect_list("seq").over(w.rowsBetween(-before, after)), "lo": F.lag("v", before or 1).over(w) if before else F.lit(None).cast("double")}
    got = over_halo(series, ["k"], ["seq"], frame, before, after, size, block=16).select("k", "seq", "v", "xs", "lo")
    same(got, series.withColumns(frame(Window.partitionBy("k").orderBy("seq"))).select("k", "seq", "v", "xs", "lo"))
    with pytest.raises(ValueError):
        over_halo(series, ["k"], ["seq"], frame, 5, 5, 10)


def test_halo_of_ties_and_empty_tables(spark, series):
    ties = spark.createDataFrame([("a", 1)] * 50 + [("a", 2)], "k string, seq long")
    n = numbered(ties, ["k"], ["seq"], "n", 4).orderBy("n").collect()
    assert [r["n"] for r in n] == list(range(51)) and n[-1]["seq"] == 2
    assert rolling_median(series.where("false"), "v", "m", ["k"], ["seq"]).collect() == []
    plan = rolling_median(series, "v", "m", ["k"], ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k#" in plan and "_seen#" in plan


@pytest.mark.parametrize(("bins", "few"), [(32, 4), (512, 1 << 16)])
def test_quantiles_by_selection(spark, bins, few):
    rng = np.random.default_rng(3)
    groups = {"even": rng.uniform(0, 1, 400), "powers": 2.0 ** np.arange(0, 24), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([5.0]), "same": np.full(40, -2.5), "wide": np.array([-1e308, 0.0, 1e308, 1.0]), None: rng.normal(0, 9, 77)}
    rows = [(k, float(x), float(-x) if i % 2 else None) for k, xs in groups.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame([*rows, ("none", None, None)], "k string, x double, y double")
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in quantiles(df, ["k"], {"x": shares, "y": {"y50": 0.5}}, bins, few).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for name, q in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, q), rel=1e-12, abs=1e-300), (k, name)
        ys = -xs[1::2]
        assert got[k]["y50"] == (pytest.approx(np.quantile(ys, 0.5)) if len(ys) else None)
    whole = quantiles(df.where("k = 'even'"), [], {"x": {"m": 0.5}}, bins, few).first()
    assert whole["m"] == pytest.approx(np.quantile(groups["even"], 0.5))
    assert quantiles(df.where("false"), ["k"], {"x": shares}).collect() == []
