"""Exact signed-rank probabilities against all sign patterns."""

from itertools import product

import numpy as np
import pytest

from tidewheel.operators import inference


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12])
def test_exact_p_equals_enumeration(n):
    ranks = np.arange(1, n + 1)
    plus = np.array([ranks[np.array(s, bool)].sum() for s in product((0, 1), repeat=n)])
    for statistic in range(n * (n + 1) // 4 + 1):
        assert inference.exact_p(n, statistic) == pytest.approx(min(1.0, 2 * (plus <= statistic).mean()))


def test_small_samples_are_exact_and_ties_are_not(spark):
    d = [3, -1, 4, 5, -2, 7, 8, 0]
    got = inference.wilcoxon(spark.createDataFrame([(x,) for x in d], "d int"), "d").first()
    assert (got.n, got.statistic) == (7, 3.0) and got.p_value == pytest.approx(inference.exact_p(7, 3), abs=1e-6)
    tied = inference.wilcoxon(spark.createDataFrame([(x,) for x in [1, 1, -1, 2]], "d int"), "d").first()
    assert tied.p_value != pytest.approx(inference.exact_p(4, tied.statistic))
    none = inference.wilcoxon(spark.createDataFrame([(0,)], "d int"), "d").first()
    assert (none.statistic, none.p_value) == (0.0, 1.0)
