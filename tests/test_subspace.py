"""Principal axes against numpy's decomposition; mixtures and clusters against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.operators import evidence, mixture, subspace


def angle(a, b):
    """Largest principal angle between two column spaces."""
    a, _ = np.linalg.qr(a)
    b, _ = np.linalg.qr(b)
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def standardised(x):
    sd = x.std(axis=0, ddof=1)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1) * (sd > 0)


def matrix(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, d)) * 0.5 + rng.normal(size=(n, d))
    x[:, 3] = 4.0                                      # a constant feature
    return x


@pytest.mark.parametrize("d", [5, 40, 300])
def test_axes_equal_the_decomposition(spark, d):
    x = matrix(400, d)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, features array<double>")
    found = subspace.principal_axes(df.repartition(5), k=4)
    _, s, v = np.linalg.svd(standardised(x), full_matrices=False)
    assert angle(found.axes, v[:4].T) < 1e-6
    np.testing.assert_allclose(found.variance, s[:4] ** 2 / 399, rtol=1e-8)
    out = evidence.latent_representation(df, k=4, indices=df.where("cell_id < 30").select("cell_id"))
    got = {r["cell_id"]: r["latent"] for r in out.collect()}
    assert sorted(got) == list(range(30)) and out.columns == ["cell_id", "latent"]
    np.testing.assert_allclose(np.abs([got[i] for i in range(30)]), np.abs(standardised(x)[:30] @ v[:4].T), atol=1e-6)


def test_sparse_features_equal_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(subspace, "SLICE", 16)
    monkeypatch.setattr(subspace, "ENTRIES", 50)
    rng = np.random.default_rng(1)
    x = np.where(rng.random((200, 70)) < 0.1, rng.poisson(3, (200, 70)), 0).astype(float)
    x[5] = 0
    dense = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, features array<double>")
    rows = [(i, (np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    sparse = spark.createDataFrame([*rows, (999, None)], "cell_id long, features struct<indices: array<int>, values: array<double>>")
    a, b = subspace.principal_axes(dense, k=3), subspace.principal_axes(sparse, k=3, width=70)
    assert angle(a.axes, b.axes) < 1e-6
    left = {r[0]: r[1] for r in subspace.projected(dense, a).collect()}
    right = {r[0]: r[1] for r in subspace.projected(sparse, b).collect()}
    assert right.pop(999) is None
    np.testing.assert_allclose([left[i] for i in range(200)], [right[i] for i in range(200)], atol=1e-6)
    with pytest.raises(ValueError, match="width"):
        subspace.principal_axes(sparse, k=3)


def test_axes_of_equal_variances_end_and_report(spark):
    x = np.random.default_rng(2).normal(size=(300, 120))       # no gap after the wanted axes
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>")
    with pytest.warns(UserWarning, match="residual"):
        found = subspace.principal_axes(df, k=2, max_passes=2)
    assert found.passes == 2
    found = subspace.principal_axes(df, k=2)
    _, _, v = np.linalg.svd(standardised(x), full_matrices=False)
    assert angle(found.axes, v[:2].T) < 1e-5
    with pytest.raises(ValueError, match="no rows"):
        subspace.principal_axes(df.where("false"))


def plain_mixture(x, start, passes):
    """Expectation-maximisation row by row and component by component."""
    k, d = start.shape
    weights, means, variances = np.full(k, 1 / k), start.copy(), np.tile(x.var(axis=0) + mixture.FLOOR, (k, 1))
    for _ in range(passes):
        joint = np.log(weights) - 0.5 * np.stack([((x - means[c]) ** 2 / variances[c] + np.log(2 * np.pi * variances[c])).sum(axis=1)
                                                  for c in range(k)], axis=1)
        share = np.exp(joint - joint.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        weights = share.mean(axis=0)
        means = share.T @ x / share.sum(axis=0)[:, None]
        variances = np.stack([(share[:, c, None] * (x - means[c]) ** 2).sum(axis=0) / share[:, c].sum() for c in range(k)]) + mixture.FLOOR
    return weights, means, variances


@pytest.mark.parametrize("sparse", [False, True])
def test_mixture_equals_a_plain_fit_and_never_falls(spark, sparse):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, s, (150, 5)) for m, s in ((0, 1), (3, 0.5), (-2, 2))])
    if sparse:
        x = np.where(rng.random(x.shape) < 0.4, 0, x)
        rows = [(i, (np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
        df = spark.createDataFrame([*rows, (999, None)], "cell_id long, features struct<indices: array<int>, values: array<double>>")
    else:
        df = spark.createDataFrame([*[(i, [float(v) for v in r]) for i, r in enumerate(x)], (999, None)], "cell_id long, features array<double>")
    start = x[[0, 200, 400]]
    found = mixture.fit_mixture(df.repartition(4), start, gain=1e-9, max_iter=25)
    assert (np.diff(found.likelihood) > -1e-9).all() and len(found.likelihood) > 5
    weights, means, variances = plain_mixture(x, start, len(found.likelihood))
    for got, want in ((found.weights, weights), (found.means, means), (found.variances, variances)):
        np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-8)
    labels = {r["cell_id"]: r["cluster"] for r in mixture.assigned(df, found).collect()}
    assert labels.pop(999) is None
    joint = np.stack([np.log(weights[c]) - 0.5 * ((x - means[c]) ** 2 / variances[c] + np.log(variances[c])).sum(axis=1) for c in range(3)], axis=1)
    assert [labels[i] for i in range(len(x))] == joint.argmax(axis=1).tolist()
