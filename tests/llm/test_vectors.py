"""Embedding links against brute force: planted copies at the threshold, a large near group in several blocks, other dimensions."""

import numpy as np
import pytest

pytest.importorskip("siglake.llm.registry")
from pyspark.sql import types as T  # noqa: E402
from siglake.llm import vectors  # noqa: E402
from siglake.llm.vectors import bands, coded, near_vectors, turned  # noqa: E402

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def planted(rng, n, dim, group, spread):
    """n random vectors, the first group of them around one, at angles that straddle 0.98."""
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:group] = x[0] + spread * rng.uniform(0.2, 1, size=(group, 1)) * x[:group] * (np.arange(group) > 0)[:, None]
    return x.astype("float32")


def links(x, label):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(u), dtype=bool)


def by_brute_force(near):
    first = np.arange(len(near))
    while True:
        new = np.minimum(first, np.where(near, first[None], len(near)).min(axis=1))
        if (new == first).all():
            return first
        first = new


@pytest.mark.parametrize("dim", [2, 3, 64, 100])
def test_rotation_keeps_lengths_and_angles(dim):
    x = np.random.default_rng(1).normal(size=(20, dim))
    for r in range(3):
        y = turned(x, r)
        assert np.allclose(y @ y.T, x @ x.T)


def test_estimate_is_unbiased_and_its_bound_holds():
    rng = np.random.default_rng(2)
    a, b = (v / np.linalg.norm(v) for v in (rng.normal(size=64), rng.normal(size=64)))
    b = 0.9 * a + np.sqrt(1 - 0.81) * (b - (a @ b) * a) / np.linalg.norm(b - (a @ b) * a)
    signs, _, factor = coded(a[None], 400)
    _, whole, _ = coded(b[None], 400)
    each = np.einsum("rs,rs->r", signs[0], whole[0]) / 8 / factor[0]
    sd = np.sqrt((1 - factor[0] ** 2) / factor[0] ** 2 / 63)
    assert abs(each.mean() - 0.9) < 4 * each.std() / 20
    assert (np.abs(each - 0.9) < vectors.SURE * sd).all()


@pytest.mark.parametrize(("dim", "group"), [(64, 400), (64, 2600), (20, 300), (300, 300)])
def test_links(spark, dim, group):
    rng = np.random.default_rng(3)
    n = group + 500
    x, label = planted(rng, n, dim, group, 0.2), np.where(np.arange(n) % 9 == 0, 2, 1)
    near = links(x, label)
    out = near_vectors(spark.createDataFrame([(k, x[k].tolist(), int(label[k])) for k in range(n)], SCHEMA).repartition(4), least=0.98).collect()
    got = np.array([r.n_links for r in sorted(out, key=lambda r: r.vec_id)])
    assert near.sum() > 2000 and (got <= near.sum(axis=1)).all() and got.sum() >= 0.998 * near.sum()
    first = by_brute_force(near)
    assert sum(r.component_id == first[r.vec_id] for r in out) >= n - 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_more_bands_for_more_bits():
    for bits in (8, 13, 20, 40):
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** bands(0.98, bits, 1e-3) <= 1e-3
