import itertools

import numpy as np
import pytest

from patchloom.functions import kernels as K
from patchloom.operators.compaction import hilbert_codes

RNG = np.random.default_rng(0)


def naive_pool(x, grid, method):
    h, w, c = x.shape
    out = np.zeros((*grid, c))
    for a, b, ch in itertools.product(range(grid[0]), range(grid[1]), range(c)):
        v = [x[i, j, ch] for i in range(h) for j in range(w) if i * grid[0] // h == a and j * grid[1] // w == b]
        if method == "max":
            out[a, b, ch] = max([0, *v])
        else:
            out[a, b, ch] = np.nan if not v else np.mean(v) if method == "ave" else np.sqrt(np.mean(np.square(v)))
    return out


@pytest.mark.parametrize("method", ["max", "ave", "rms"])
@pytest.mark.parametrize("grid", [(1, 1), (2, 2), (3, 3), (2, 3), (4, 4), (5, 5)])
@pytest.mark.parametrize("side", [4, 7, 16])
def test_spatial_pooling(method, grid, side):
    x = RNG.normal(size=(2, side, side + 1, 3))
    got = K.spatial_pooled(x, grid, method)
    assert got.shape == (2, *grid, 3)
    for k in range(2):
        np.testing.assert_allclose(got[k], naive_pool(x[k], grid, method))


def test_max_pooling_starts_from_zero():
    assert (K.spatial_pooled(-np.ones((1, 4, 4, 1)), (2, 2), "max") == 0).all()


@pytest.mark.parametrize("method", ["max", "ave", "rms"])
def test_overcomplete_pooling(method):
    x = RNG.normal(size=(1, 9, 9, 2))
    cells = naive_pool(x[0], (3, 3), method)
    got = K.overcomplete_pooled(x, (3, 3), method)[0]
    assert len(got) == 3 * 4 * 3 * 4 // 4
    for row, (i, j, k, m) in zip(got, K.rectangles((3, 3)), strict=True):
        np.testing.assert_allclose(row, naive_pool(cells[i:j, k:m], (1, 1), method)[0, 0])


def test_pyramid_fixed_size_and_kernel_pooling():
    x = RNG.normal(size=(2, 11, 8, 2))
    assert K.pyramid_pooled(x, 3, "max").shape == (2, (1 + 4 + 16) * 2)
    assert K.pyramid_pooled(x, [1], "ave").shape == (2, 8)
    fixed = K.fixed_size_pooled(x, (3, 3), "ave")
    np.testing.assert_allclose(fixed[:, 0, 0], x[:, 1:4, 1:4].mean((1, 2)))
    assert fixed.shape == (2, 3, 2, 2)
    kernel = K.gaussian_kernel(4, 1.5)
    assert kernel.shape == (5, 5) and kernel[2, 2] == 1
    last_left_off, full = K.kernel_pooled(x, kernel, (2, 1), "ave"), K.kernel_pooled(x, kernel, (2, 1), "ave", True)
    assert last_left_off.shape == (2, 3, 3, 2) and full.shape == (2, 4, 4, 2)
    np.testing.assert_allclose(full[:, 0, 0], (x[:, 0:5, 0:5] * kernel[:, :, None]).mean((1, 2)))

    class Second:
        """A pooler of its own: all products of two channels."""

        def dim(self, width):
            return width * width

        def pool(self, z):
            return (z.T @ z).ravel()

    own = K.kernel_pooled(x, np.ones((3, 3)), (3, 3), Second())
    np.testing.assert_allclose(own[0, 0, 0], (lambda z: (z.T @ z).ravel())(x[0, 1:4, 1:4].reshape(9, 2)))


def test_patches():
    x = RNG.normal(size=(2, 7, 6, 3))
    got = K.patches(x, (3, 2), 2)
    assert got.shape == (2, 3, 3, 18)
    for i, j in itertools.product(range(3), range(3)):
        np.testing.assert_array_equal(got[:, i, j], x[:, 2 * i : 2 * i + 3, 2 * j : 2 * j + 2].reshape(2, -1))


def test_normalisers():
    x = RNG.random((4, 36)) + 0.1
    np.testing.assert_allclose(K.normalized(x, "meanvar", 0.0).std(1), 1)
    np.testing.assert_allclose(np.linalg.norm(K.normalized(x, "l2", 0.0), axis=1), 1)
    np.testing.assert_allclose(K.normalized(x, "l1", 0.0).sum(1), 1)
    np.testing.assert_allclose(K.normalized(x, "spatial", channels=3).reshape(4, 12, 3).mean(1), 0, atol=1e-12)
    with pytest.raises(ValueError):
        K.normalized(x, "none")


def test_encoders():
    x, atoms = RNG.random((50, 9)), RNG.random((7, 9))
    d = np.linalg.norm(x[:, None] - atoms, axis=2)
    np.testing.assert_array_equal(K.one_hot_nearest(x, atoms).argmax(1), d.argmin(1))
    np.testing.assert_allclose(K.triangled(x, atoms), np.maximum(d.mean(1, keepdims=True) - d, 0), atol=1e-9)
    p = x @ atoms.T
    np.testing.assert_allclose(K.thresholded(x, atoms, 0.3), np.maximum(np.hstack((p, -p)) - 0.3, 0))
    np.testing.assert_allclose(K.thresholded(x, -atoms, 0.3, "abs"), np.maximum(np.abs(p) - 0.3, 0))
    code = K.locality_coded(x, atoms, 3)
    np.testing.assert_allclose(code.sum(1), 1)
    assert ((code != 0).sum(1) <= 3).all()
    assert all(set(np.flatnonzero(c)) <= set(np.argsort(q)[:3]) for c, q in zip(code, d, strict=True))


def test_matching_pursuit():
    x, atoms = np.array([[0.4, 0.1], [0.4, 0.5], [1, 0]]), np.eye(2)
    index, value = K.matching_pursuit(x, atoms, 1)
    assert index[:, 0].tolist() == [0, 1, 0] and np.allclose(value[:, 0], [0.4, 0.5, 1])
    index, value = K.matching_pursuit(-x, atoms, 2)
    np.testing.assert_allclose(sum(value[:, s : s + 1] * atoms[index[:, s]] for s in range(2)), -x)


def test_gradient_filters_and_sift():
    for g in K.derivative_filters(1.0):
        assert g.shape == (5, 5) and abs(np.abs(g).sum() - 2) < 1e-12 and abs(g.sum()) < 1e-9
    x = RNG.random((2, 20, 18, 1))
    assert K.dense_sift(x, 16, 2).shape == (2, 3, 2, 128) and K.dense_sift(x, 32, 2).shape == (2, 0, 0, 128)
    s = K.dense_sift(x * 255, 16, 2)
    np.testing.assert_allclose(s, K.dense_sift(x, 16, 2), atol=1e-9)
    high = K.dense_sift(x, 16, 2, contrast=1e-6)
    np.testing.assert_allclose(np.linalg.norm(high, axis=-1), 1)
    ramp = np.tile(np.arange(24) / 24, (24, 1))[None, :, :, None]
    g = K.oriented_gradients(ramp)[0, 12, 12]
    assert g.argmax() in (0, 4) and g.max() > 0


def test_resampling():
    x = RNG.random((1, 8, 8, 2))
    np.testing.assert_allclose(K.resized(x, 8, 8), x)
    np.testing.assert_allclose(K.resized(x, 4, 4), x.reshape(1, 4, 2, 4, 2, 2).mean((2, 4)))
    np.testing.assert_allclose(K.jittered(x, (0, 0), 0, 0), x, atol=1e-12)
    np.testing.assert_allclose(K.jittered(x, (1, 0), 0, 0)[:, 1:], x[:, :-1], atol=1e-12)
    np.testing.assert_allclose(K.jittered(x, (0, 0), np.pi, 0), x[:, ::-1, ::-1], atol=1e-9)
    t = np.linspace(0, 7, 40)
    cubic = lambda v: v**3 - 2 * v**2 + 3
    np.testing.assert_allclose(K.spline_weights(8, t) @ cubic(np.arange(8.0)), cubic(t), atol=1e-9)


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_steps_to_neighbours(dims):
    side = np.array(list(itertools.product(range(8), repeat=dims)))
    code = hilbert_codes(side, 3)
    assert sorted(code) == list(range(8**dims))
    walk = side[np.argsort(code)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
