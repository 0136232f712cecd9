"""Exact quantiles and sliding quantiles against numpy, whatever the size of groups."""

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators.selection import exact_quantiles
from tidewheel.operators.windows import Blocks

P = [0.0, 0.05, 0.25, 0.5, 0.95, 0.999, 1.0]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(0)
    return {
        "normal": rng.normal(size=3000),
        "tied": np.where(rng.random(2500) < 0.4, 0.0, rng.integers(-3, 4, 2500)).astype(float),
        "wide": rng.choice([-1.0, 1.0], 2000) * 10 ** rng.uniform(-300, 300, 2000),
        "equal": np.full(900, 7.5),
        "small": rng.normal(size=40),
        "one": np.array([3.0]),
    }


@pytest.mark.parametrize(("direct", "cuts"), [(1 << 18, 500), (100, 8), (3, 50)])
def test_quantiles_equal_numpy(spark, groups, direct, cuts):
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("small", None), ("small", float("nan")), ("none", None)]
    got = {r.g: r.quantiles for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", P, direct=direct, cuts=cuts).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, P).tolist(), rel=1e-9), g


def test_quantiles_without_groups(spark, groups):
    df = spark.createDataFrame(pd.DataFrame({"x": groups["normal"]}))
    for direct in (10, 10_000):
        (r,) = exact_quantiles(df, [], "x", [0.95], direct=direct).collect()
        assert list(r.asDict()) == ["quantiles"] and r.quantiles[0] == pytest.approx(np.quantile(groups["normal"], 0.95))
    assert exact_quantiles(df.where("false"), [], "x", [0.5]).count() == 0


@pytest.mark.parametrize("block_rows", [30, 1 << 14])
def test_sliding_quantiles_equal_numpy(spark, block_rows):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 300).astype(float)
    rows = [(i, None if i == 150 else float(v), None if i % 7 else i) for i, v in enumerate(x)]
    b = Blocks(spark.createDataFrame(rows, "k long, x double, other long"), "k", 30, block_rows=block_rows)
    b.quantiles("x", -25, -6, (0.25, 0.5), "q")
    got = b.result("k", "other", "q0", "q1").orderBy("k").collect()
    assert [r.other for r in got] == [r[2] for r in rows]
    for i, r in enumerate(got):
        whole = i >= 25 and not i - 25 <= 150 <= i - 6
        assert (r.q0, r.q1) == (tuple(np.quantile(x[i - 25 : i - 5], (0.25, 0.5))) if whole else (None, None))
