import numpy as np
import pandas as pd
import pytest

from grainmark.functions import values
from grainmark.operators import stats


@pytest.mark.parametrize("swap", [False, True])
def test_levels_follow_the_column_with_fewer_values(spark, monkeypatch, swap):
    """Three values are two bits, however many rows there are; the result is that of all pairs."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 1)
    y = np.clip(np.round(x + rng.normal(size=300)), -1, 1)
    a, b = (y, x) if swap else (x, y)
    seen = []
    real = values.with_position
    monkeypatch.setattr(values, "with_position", lambda d, o, n="position": seen.append((o, d.count())) or real(d, o, n))
    got = stats.kendall(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first()
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    s = (dx * dy).sum() / 2
    tau = s / np.sqrt(float((dx != 0).sum() / 2) * float((dy != 0).sum() / 2))
    assert got["tau"] == pytest.approx(tau, abs=1e-12) and got["n"] == 300
    assert seen[0][1] == 3
