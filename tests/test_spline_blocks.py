"""Splines of many short series are solved block by block, not series by series."""

import numpy as np
import pandas as pd

from grainmark.operators import impute


def test_one_call_per_block(spark, monkeypatch):
    blocks = []
    halo = impute.values.blocks_with_halo
    monkeypatch.setattr(impute.values, "blocks_with_halo", lambda *a, **k: blocks.append(halo(*a, **k)) or blocks[-1])
    rows = [(g, t, None if t == 4 else float((t - 2) ** 3 + g)) for g in range(40) for t in range(8)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    got = impute.impute_spline(df, ["t"], ["v"], ["g"]).toPandas()
    at = got[got["t"] == 4]
    assert np.allclose(at["v"], 8 + at["g"])  # a cubic is met exactly
    pdf = blocks[0].toPandas()
    solved = impute._curvature(pdf[pdf["block"] == pdf["block"].iloc[0]])
    assert solved["is_first"].sum() == solved["is_last"].sum() == 40


def test_series_of_all_lengths_side_by_side():
    """Series in one block equal those alone."""
    rng = np.random.default_rng(2)
    parts, p = [], 0
    for g in range(30):
        n = int(rng.integers(1, 9))
        at = p + np.cumsum(rng.integers(1, 4, n))
        p = int(at[-1])
        d = pd.DataFrame({"g": g, "p": at, "v": rng.normal(size=n), "own": True, "head": False, "tail": False})
        d.loc[0, "head"] = d.loc[n - 1, "tail"] = True
        parts.append(d)
    alone = pd.concat([impute._curvature(d) for d in parts], ignore_index=True)
    pd.testing.assert_frame_equal(impute._curvature(pd.concat(parts)).reset_index(drop=True), alone)
