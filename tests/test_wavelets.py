"""Haar coefficients against numpy and back, and the wavelet basis against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import wavelets


@pytest.mark.parametrize("levels", [1, 5])
def test_haar_and_back(spark, levels):
    rng = np.random.default_rng(2)
    series = {u: rng.normal(size=n) for u, n in ((1, 32), (2, 13), (3, 1), (4, 6))}
    df = spark.createDataFrame([(u, i, float(v)) for u, own in series.items() for i, v in enumerate(own)], "unit long, t long, v double").repartition(3)
    found = wavelets.haar(df, ["unit"], "t", "v", levels).cache()
    back = {(r.unit, r.k): r.value for r in wavelets.inverse_haar(found, ["unit"], levels).collect()}
    assert back == pytest.approx({(u, i): v for u, own in series.items() for i, v in enumerate(own)})
    rows = {(r.level, r.k): r for r in found.filter("unit = 1").collect()}
    smooth = series[1]
    for level in range(1, levels + 1):
        detail, smooth = (smooth[1::2] - smooth[::2]) / np.sqrt(2), (smooth[1::2] + smooth[::2]) / np.sqrt(2)
        assert [rows[level, k].d for k in range(len(detail))] == pytest.approx(detail.tolist())
    assert [rows[levels, k].s for k in range(len(smooth))] == pytest.approx(smooth.tolist())
    # whole pairs keep the energy
    assert sum((r.s or 0) ** 2 + r.d**2 for r in rows.values()) == pytest.approx((series[1] ** 2).sum())


def test_mother_wavelets():
    grid, psi = wavelets.mother_wavelet("db2")
    step = grid[1] - grid[0]
    assert abs(psi.sum() * step) < 1e-2 and (psi**2).sum() * step == pytest.approx(1, abs=0.05)
    grid, psi = wavelets.mother_wavelet("haar")
    assert psi[len(psi) // 4] == pytest.approx(1, abs=1e-6) and psi[3 * len(psi) // 4] == pytest.approx(-1, abs=1e-6)
    with pytest.raises(ValueError):
        wavelets.filters("none")


def test_wavelet_basis(spark):
    values = [float(v) for v in np.random.default_rng(5).gamma(2, 3, 101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    found = {r.id: r.basis for r in wavelets.wavelet_basis(df, "v", 16, "db2", 0.5).collect()}
    grid, psi = wavelets.mother_wavelet("db2", 6)
    ordered, span, at = sorted(values), max(values) - min(values), 0
    for j in range(2):
        for k in range(8):
            centre = ordered[max(int(np.ceil(k / 7 * 101)) - 1, 0)]
            want = np.interp((np.array(values) - centre) / (0.5 * 2**j * span), grid, psi)
            assert [found[i][at] for i in range(101)] == pytest.approx(want.tolist(), abs=1e-9)
            at += 1
    assert at == 16 and wavelets.wavelet_basis(df.limit(0), "v", 4).collect() == []
    assert found and F is not None
