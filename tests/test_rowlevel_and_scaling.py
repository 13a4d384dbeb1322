import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from fleetgauge.operators import rowlevel as rl
from fleetgauge.operators import scaling as sc
from fleetgauge.settings import WindowSpec


@pytest.fixture(scope="module")
def table():
    r = random.Random(3)
    rows = []
    for drive, n in ((1, 25), (2, 1), (3, 9), (4, 40)):
        day = dt.date(2024, 1, 1)
        for i in range(n):
            day += dt.timedelta(days=r.choice([1, 1, 1, 2, 3]))
            rows.append((drive, day, int(drive == 4 and i == n - 1), None if r.random() < 0.2 else 1e12 + r.random() * 50, float(i)))
    return pd.DataFrame(rows, columns=["drive", "day", "failure", "a", "b"])


@pytest.fixture(scope="module")
def readings(spark, table):
    rows = [tuple(None if x is not None and x != x else x for x in r) for r in table.itertuples(index=False)]
    return spark.createDataFrame(rows, "drive bigint, day date, failure int, a double, b double")


@pytest.mark.parametrize("width", [1, 3, 7, 30])
def test_rolling_stats_match_a_sliding_frame(readings, table, width):
    got = rl.with_rolling_stats(readings, ("a", "b"), width).toPandas().sort_values(["drive", "day"]).reset_index(drop=True)
    for c in ("a", "b"):
        for stat, fn in (("mean", np.mean), ("std", lambda v: np.std(v, ddof=1) if len(v) > 1 else np.nan), ("max", np.max)):
            want = []
            for _, g in table.groupby("drive"):
                v = g[c].to_numpy()
                for i in range(len(v)):
                    w = v[max(0, i - width + 1):i + 1]
                    w = w[~np.isnan(w)]
                    want.append(fn(w) if len(w) else np.nan)
            np.testing.assert_allclose(got[f"{c}_{stat}{width}"].to_numpy(dtype=float), want, rtol=1e-9, atol=1e-3)


def test_prior_reading_prefers_nearest_then_earlier(spark):
    base = dt.date(2024, 1, 20)
    rows = [(1, base - dt.timedelta(days=8), 1.0), (1, base - dt.timedelta(days=6), 2.0), (1, base, 10.0),
            (2, base - dt.timedelta(days=7), 3.0), (2, base - dt.timedelta(days=8), 4.0), (2, base, 10.0),
            (3, base - dt.timedelta(days=9), 3.0), (3, base, 10.0)]
    df = spark.createDataFrame(rows, "drive int, day date, a double")
    got = {r.drive: r.a_delta7 for r in rl.with_prior_reading(df, ["a"]).where(f"day = '{base}'").collect()}
    assert got == {1: 9.0, 2: 7.0, 3: None}


def test_target_uses_the_last_failure(readings):
    got = rl.with_target(readings, 5).where("drive = 4").orderBy("day").collect()
    assert got[-1].days_to_failure == 0 and got[-1].target == 1 and got[0].target == 0
    assert rl.with_target(readings, 5).where("drive = 1").selectExpr("sum(target)").first()[0] == 0


def test_scaling_fits_and_inverts(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 1), (3.0, None, 5.0, 1), (None, None, 5.0, 1)], "a double, e double, k double, observed int")
    s = sc.fit_scaling(df, ("a", "e", "k", "observed"))
    assert s.medians == (2.0, 0.0, 5.0, 0.0) and s.means == (2.0, 0.0, 5.0, 0.0)
    assert s.stds[0] == pytest.approx(np.std([1, 3, 2])) and s.stds[1:] == (1.0, 1.0, 1.0)
    scaled = s.apply(df)
    assert [r.observed for r in scaled.collect()] == [1.0] * 3
    back = s.invert(scaled).collect()
    assert [r.a for r in back] == pytest.approx([1.0, 3.0, 2.0])


def test_scaling_merges_missing_values_in_closed_form(spark):
    r = random.Random(3)
    values = [None if r.random() < 0.3 else round(r.uniform(-5, 900), 3) for _ in range(301)]
    df = spark.createDataFrame([(v, 1) for v in values], "a double, observed int")
    seen = [v for v in values if v is not None]
    for exact in (True, False):
        s = sc.fit_scaling(df, ("a", "observed"), exact)
        assert s.medians[0] == pytest.approx(np.median(seen), abs=0 if exact else 12)
        filled = [s.medians[0] if v is None else v for v in values]
        assert (s.means[0], s.stds[0]) == (pytest.approx(np.mean(filled)), pytest.approx(np.std(filled)))
    nothing = sc.fit_scaling(df.limit(0), ("a", "observed"), False)
    assert (nothing.medians, nothing.means, nothing.stds) == ((0.0, 0.0), (0.0, 0.0), (1.0, 1.0))


@pytest.mark.parametrize("dialect", ["archive", "cohort"])
def test_contract_round_trip(spark, tmp_path, dialect):
    spec = WindowSpec(attrs=("a", "b"), days=9, horizon=4, lags=(1,), log_attrs=("a",), min_days=9)
    n = len(spec.channels)
    made = sc.Contract(spec, sc.Scaling(spec.channels, (0.5,) * n, (1.0,) * n, (2.0,) * n), 0.25, {"arch": "trees"})
    sc.save_contract(spark, made, str(tmp_path / "c"), dialect)
    got = sc.load_contract(spark, str(tmp_path / "c"))
    assert got.spec == spec and got.scaling == made.scaling and got.threshold == 0.25 and got.extra == {"arch": "trees"}


def test_contract_refuses_other_channels():
    text = sc.Contract(WindowSpec(attrs=("a",), lags=(1,)), sc.Scaling(("a", "observed"), (0.0,) * 2, (0.0,) * 2, (1.0,) * 2), 0.5).to_json()
    with pytest.raises(ValueError):
        sc.Contract.from_json(text)


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.95,), (0.7,), (0.5,), (0.39,), (None,)], "p double")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(rl.risk_band(F.col("p"), 0.4)).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW"]
