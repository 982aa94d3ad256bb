from __future__ import annotations

import numpy as np
import pytest

from eventgrove.operators.projection import apply_projection, fit_projection


def test_axes_equal_those_of_the_covariance(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 12)) @ np.diag([9, 6, 4, 2.5, *[0.5] * 8]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 3
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(500, None)], "id int, features array<double>").repartition(7)
    fitted = fit_projection(rows, 4)
    values, vectors = np.linalg.eigh(np.cov(points.T, bias=True))
    assert np.allclose(fitted.variances, values[::-1][:4]) and np.allclose(fitted.mean, points.mean(axis=0)) and fitted.rows == 500
    assert np.allclose(np.abs(fitted.axes @ vectors[:, ::-1][:, :4]), np.eye(4), atol=1e-5)
    got = {r["id"]: r["features"] for r in apply_projection(rows, fitted).collect()}
    assert got.pop(500) is None
    assert np.allclose([got[i] for i in range(500)], (points - points.mean(axis=0)) @ fitted.axes.T)


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError, match="no vectors"):
        fit_projection(spark.createDataFrame([(None,)], "features array<double>"), 2)
