import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import arrays as A
from patchloom.functions import kernels as K
from patchloom.operators import dictionary as D
from patchloom.operators import encode, evaluate, extract, sampling, stats, tensors, views
from patchloom.operators import learn as L
from patchloom.plans.pipeline import Component, ConvLayer
from patchloom.queries.features import fused_layer
from patchloom.sources import folders as S

RNG = np.random.default_rng(1)


def rows_of(spark, x, parts, label=None):
    return S.from_array(spark, x, label).repartition(parts)


def collected(df, column="data"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


# --- statistics ---------------------------------------------------------------------------------------------------


def test_moments(spark, parts):
    x = RNG.random((100, 7)) + 1000
    df = rows_of(spark, x, parts)
    m, s = stats.meanstd(df, "data")
    np.testing.assert_allclose(m, x.mean(0))
    np.testing.assert_allclose(s, x.std(0), rtol=1e-9)
    np.testing.assert_allclose(stats.meancov(df, "data")[1], np.cov(x.T, bias=True), atol=1e-12)
    with pytest.raises(ValueError):
        stats.mean(df.where("id < 0"), "data")


def test_jvm_and_numpy_normalisers_agree(spark, parts):
    x = RNG.random((20, 12)) + 0.1
    df = rows_of(spark, x, parts)
    for column, kind in ((A.mean_normalized, "mean"), (A.meanvar_normalized, "meanvar"), (A.l2_normalized, "l2"), (A.l1_normalized, "l1")):
        np.testing.assert_allclose(collected(df.withColumn("data", column(F.col("data")))), K.normalized(x, kind), atol=1e-12)
    np.testing.assert_allclose(collected(df.withColumn("data", A.spatial_mean_normalized(F.col("data"), 3))), K.normalized(x, "spatial", channels=3), atol=1e-12)
    np.testing.assert_allclose(collected(df.withColumn("data", A.sift_normalized(F.col("data")))), K.sift_normalized(x), atol=1e-12)


# --- views and extraction -------------------------------------------------------------------------------------------


def test_views(spark, parts):
    x = RNG.random((5, 6, 5, 2))
    df = rows_of(spark, x, parts)
    both = views.mirror_set(df)
    assert both.count() == 10
    np.testing.assert_array_equal(collected(both.where("is_flipped")), x[:, :, ::-1].reshape(5, -1))
    np.testing.assert_array_equal(collected(views.center_region_set(df, (4, 3))), x[:, 1:5, 1:4].reshape(5, -1))
    assert views.center_region_set(df, (7, 3)).count() == 0
    sub = views.sub_image_set(df, (3, 3), 2)
    assert sub.count() == 5 * 2 * 2
    np.testing.assert_array_equal(collected(sub.where("top = 2 and left = 2")), x[:, 2:5, 2:5].reshape(5, -1))


def test_images_of_several_shapes(spark, parts):
    big, small = rows_of(spark, RNG.random((3, 6, 5, 1)), parts), rows_of(spark, RNG.random((3, 2, 2, 1)), parts).withColumn("id", F.col("id") + 10)
    out = encode.spatial_pool(big.union(small), (2, 2), "ave").collect()
    assert len(out) == 6 and {(r["h"], r["w"], r["c"]) for r in out} == {(2, 2, 1)}
    assert extract.patch_maps(big.union(small), 3).count() == 3
    assert encode.spatial_pool(big.where("id < 0"), (2, 2), "max").count() == 0
    assert encode.spatial_pool(big.withColumn("data", F.lit(None).cast("array<double>")), (2, 2), "max").count() == 0


def test_jitter_repeats(spark, parts):
    df = rows_of(spark, RNG.random((4, 8, 8, 1)), parts)
    a, b = (sorted((r["id"], r["copy"], tuple(r["data"])) for r in views.jitter_set(df.repartition(p), 2, (1, 1, 5, 0.1)).collect()) for p in (1, 3))
    assert a == b and len(a) == 12
    assert views.jitter_set(df, 0, (1, 1, 5, 0.1)).count() == 4
    with pytest.raises(ValueError):
        views.jitter_set(df, 1, (1, 1, 1, 1), "other")


def test_patch_rows_and_maps_agree(spark, parts):
    df = rows_of(spark, RNG.random((3, 7, 6, 2)), parts)
    maps = collected(extract.patch_maps(df, 3, 2)).reshape(3, -1, 18)
    rows = extract.patch_rows(df, 3, 2).orderBy("id", "part").collect()
    np.testing.assert_array_equal(np.array([r["data"] for r in rows]).reshape(maps.shape), maps)


def test_mosaic():
    x = RNG.random((10, 4, 4))
    assert extract.mosaic(x, gap=1).shape == (14, 19) and extract.mosaic(RNG.random((10, 4, 4, 3))).shape == (14, 19, 3)
    assert extract.channel_mosaic(RNG.random((4, 4, 10))).shape == (14, 19)
    assert extract.patch_shape(36) == (6, 6) and extract.patch_shape(108) == (6, 6, 3)
    with pytest.raises(ValueError):
        extract.patch_shape(37)


# --- sampling -----------------------------------------------------------------------------------------------------


def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(300).repartition(parts)
    assert {r["id"] for r in sampling.reservoir(df, 40, "id").collect()} == {r["id"] for r in sampling.reservoir(spark.range(300).coalesce(1), 40, "id").collect()}
    batches = sampling.minibatches(df, 70, 0, "id").groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in batches) == [(b, 70) for b in range(4)]
    other = {r["id"] for r in sampling.minibatches(df, 70, 1, "id").where("batch = 0").collect()}
    assert other != {r["id"] for r in sampling.minibatches(df, 70, 0, "id").where("batch = 0").collect()}


def test_patch_draws(spark, parts):
    x = RNG.random((6, 5, 5, 1))
    out = sampling.patch_draws(rows_of(spark, x, parts), 400, 5).collect()
    assert len(out) == 400 and {(r["top"], r["left"]) for r in out} == {(0, 0)} and len({r["id"] for r in out}) == 6
    out = sampling.patch_draws(rows_of(spark, x, parts), 300, 3, 1, "label").collect()
    assert {(r["top"], r["left"]) for r in out} == {(i, j) for i in range(3) for j in range(3)}  # the last row and column as well
    r = out[0]
    np.testing.assert_array_equal(r["feature"], x[r["id"], r["top"] : r["top"] + 3, r["left"] : r["left"] + 3].ravel())
    assert sampling.patch_draws(rows_of(spark, x, parts), 10, 9).count() == 0


def test_segments(spark):
    got = [r[0] for r in spark.range(100).orderBy("id").select(sampling.segment(F.col("id"), 100, 7)).collect()]
    assert got == [next(i for i in range(7) if 100 * i // 7 <= p < 100 * (i + 1) // 7) for p in range(100)]
    with pytest.raises(ValueError):
        sampling.segment(F.col("id"), 3, 4)


# --- dictionaries -------------------------------------------------------------------------------------------------


def test_kmeans_on_two_blobs(spark, parts):
    x = np.concatenate((RNG.random((10, 2)), -RNG.random((10, 2))))
    df = rows_of(spark, x, parts)
    labels = [r["cluster"] for r in D.nearest_atom(df, "data", np.array([[1.0, 1], [-1, -1]]), "id").orderBy("id").collect()]
    assert labels == [0] * 10 + [1] * 10
    got = D.kmeans(df, "data", 2, n_init=3)
    np.testing.assert_allclose(sorted(got.atoms.tolist()), sorted([x[:10].mean(0).tolist(), x[10:].mean(0).tolist()]))
    with pytest.raises(ValueError):
        D.kmeans(df, "data", 0)


def test_omp1(spark, parts):
    df = rows_of(spark, np.concatenate((np.tile([1.0, 1], (50, 1)), np.tile([-1.0, 1], (50, 1)))), parts)
    got = D.omp1(df, "data", 2, seed=3)
    np.testing.assert_allclose(np.abs(got.atoms), 0.5**0.5, atol=1e-6)
    x = np.array([[0.4, 0.1], [0.4, 0.5], [1, 0]])
    step = D.omp1_step(rows_of(spark, x, parts), "data", np.eye(2))
    want = np.array([0.4 * x[0] + x[2], 0.5 * x[1]])
    np.testing.assert_allclose(step, want / np.linalg.norm(want, axis=1, keepdims=True))


def test_whitening(spark, parts):
    x = RNG.random((400, 6)) @ RNG.random((6, 6))
    df = rows_of(spark, x, parts)
    for train in (D.pca, D.zca):
        w, b = train(df, "data")
        np.testing.assert_allclose(np.cov(((x + b) @ w).T, bias=True), np.eye(6), atol=1e-6)
    np.testing.assert_allclose(w, w.T, atol=1e-6)


def test_ompn(spark, parts):
    df = rows_of(spark, RNG.random((80, 9)), parts)
    got = D.ompn(df, "data", 5, 2, max_iter=4)
    np.testing.assert_allclose(np.linalg.norm(got.atoms, axis=1), 1)
    _, first = D.ompn_step(df, "data", D._unit_gauss(5, 9, 42), 2)
    assert got.inertia < first


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_fused_layer_is_its_steps(spark, parts):
    x = RNG.random((6, 8, 8, 1))
    df = rows_of(spark, x, parts)
    y = K.thresholded(K.normalized(K.patches(x, (3, 3), 1), "meanvar", 0.1), np.eye(4, 9), 0.25)
    want = K.spatial_pooled(y, (2, 2), "ave").reshape(6, -1)
    np.testing.assert_allclose(collected(fused_layer().process(df), "feature"), want)
    np.testing.assert_allclose(collected(ConvLayer.loaded(fused_layer().saved()).process(df), "feature"), want)
    assert fused_layer().process(df)._jdf.queryExecution().toString().count("MapInArrow") >= 1


def test_trained_layers_stack(spark):
    x = RNG.random((12, 10, 10, 3))
    df = rows_of(spark, x, 3)
    first = ConvLayer([
        Component("extract", {"kind": "patches", "size": [3, 3], "stride": 1}), Component("normalise", {"kind": "meanvar", "reg": 0.1}), Component("encode", {"kind": "linear_bw"}, "zca", {"reg": 0.1}),
        Component("encode", {"kind": "threshold"}, "omp1", {"k": 5, "max_iter": 2}), Component("pool", {"kind": "spatial", "method": "max", "grid": [4, 4]}),
    ])
    first.train(df, 300)
    assert first.process(df).select(F.size("feature")).first()[0] == 4 * 4 * 10
    second = ConvLayer([Component("extract", {"kind": "patches", "size": [2, 2], "stride": 1}), Component("encode", {"kind": "llc", "k": 3}, "kmeans", {"k": 6, "max_iter": 3}), Component("pool", {"kind": "pyramid", "method": "max", "levels": 2})], first)
    second.train(df, 60)
    out = second.process(df)
    assert out.count() == 12 and out.select(F.size("feature")).first()[0] == 5 * 6
    with pytest.raises(ValueError):
        ConvLayer([Component("encode", {"kind": "vq"})]).kernel()


# --- losses, solvers, measures ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("loss", list(L.LOSSES))
@pytest.mark.parametrize("weighted", [False, True])
def test_gradients(loss, weighted):
    function, fill = L.LOSSES[loss]
    y = np.where(np.eye(5)[RNG.integers(0, 5, 30)] == 1, 1.0, fill)
    p, w = RNG.normal(size=(30, 5)), RNG.random(30) if weighted else None
    more = {"weighted": True} if loss == "logistic" else {}
    f, g = function(y, p, w, **more)
    for i, j in [(0, 0), (7, 3), (29, 4)]:
        step = np.zeros_like(p)
        step[i, j] = 1e-6
        assert abs((function(y, p + step, w, **more)[0] - function(y, p - step, w, **more)[0]) / 2e-6 - g[i, j]) < 1e-4


def test_regularisers():
    w = np.array([[1.0, 0], [-2, 3]])
    assert L.reg_l1(w)[0] == 6 and L.reg_l1(w)[1].tolist() == [[1, 0.5], [-1, 1]]
    assert L.reg_l2(w)[0] == 14 and L.reg_elastic(w, 0.25)[0] == 0.25 * 6 + 0.75 * 14


def test_least_squares_has_its_closed_form(spark, parts):
    x, y = RNG.normal(size=(60, 4)), RNG.normal(size=(60, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(parts)
    model, _ = L.fit(df, "x", "y", "l2", "l2", 0.1)
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc / 60 + 0.1 * np.eye(4), xc.T @ yc / 60)
    np.testing.assert_allclose(model.w, want, atol=1e-5)
    np.testing.assert_allclose(model.b, y.mean(0) - x.mean(0) @ want, atol=1e-5)


def test_weights_count_as_repetitions(spark):
    x = [([1.0, 0.5], 0, 2.0), ([0.2, -1.0], 1, 1.0)]
    once = spark.createDataFrame(x, "x array<double>, y int, w double")
    twice = spark.createDataFrame([x[0], x[0], x[1]], "x array<double>, y int, w double")
    model = L.Linear(RNG.normal(size=(2, 2)), np.zeros(2))
    for loss in ("l2", "hinge", "squared_hinge", "bnll"):
        a, b = L.objective(once, "x", "y", model, loss, "l2", 0.1, "w"), L.objective(twice, "x", "y", model, loss, "l2", 0.1)
        assert abs(a[0] - b[0]) < 1e-12 and np.allclose(a[1], b[1])


def test_stochastic(spark):
    x = RNG.normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(x)], "id long, x array<double>, y int").repartition(3)
    for mode in ("lbfgs", "adagrad"):
        model = L.fit_stochastic(df, "x", "y", "id", "squared_hinge", mode=mode, minibatch=50, num_iter=5, gamma=0.001)
        assert evaluate.accuracy(L.scored(df, "x", model, "y"), "y", "predicted").first()[0] > 0.9
    with pytest.raises(ValueError):
        L.fit_stochastic(df, "x", "y", "id", "l2", mode="other", num_iter=1)


def naive_ap(y, s):
    order = np.argsort(-s, kind="stable")
    points, tp = [(0.0, 1.0)], 0
    for i, at in enumerate(order):
        tp += y[at]
        if i + 1 == len(s) or s[order[i + 1]] != s[at]:
            points.append((tp / y.sum(), tp / (i + 1)))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))


def test_average_precision(spark, parts):
    y, s = RNG.integers(0, 2, 300), np.round(RNG.random(300), 2)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s, strict=True)], "y boolean, s double").repartition(parts)
    assert abs(evaluate.average_precision(df, "y", "s").first()[0] - naive_ap(y, s)) < 1e-12
    assert evaluate.average_precision(df.withColumn("y", F.lit(False)), "y", "s").first()[0] is None


def test_measures(spark, parts):
    scores = [[0.1, 0.7, 0.2], [0.5, 0.4, 0.1], [0.3, 0.3, 0.4], [0.2, 0.2, 0.2]]
    df = spark.createDataFrame([(y, s) for y, s in zip([1, 1, 0, 0], scores, strict=True)], "y int, s array<double>").repartition(parts)
    assert evaluate.accuracy(df, "y", "s").first()[0] == 0.5
    assert evaluate.top_k_accuracy(df, "y", "s", 2).first()[0] == 1.0
    assert evaluate.accuracy_class_averaged(df, "y", "s").first()[0] == 0.5
    assert {tuple(r) for r in evaluate.confusion_table(df, "y", "s", 3).where("n > 0").collect()} == {(1, 1, 1), (1, 0, 1), (0, 2, 1), (0, 0, 1)}


@pytest.mark.parametrize("values", [None, 100_000])
def test_sums_come_in_slices_and_steps(spark, values):
    """A thousand tasks; no group of the first step holds more slices than fan_in."""
    df = spark.range(5000).repartition(1000)

    def partial(batches):
        rows = float(sum(b.num_rows for b in batches))
        return rows * np.arange(1.0, 8.0)

    got = tensors.sum_partials(df, partial, values, fan_in=32, slice_values=3)
    assert got.tolist() == (5000 * np.arange(1.0, 8.0)).tolist()
    assert tensors.sum_partials(df, lambda batches: np.array([float(sum(b.num_rows for b in batches))]), 1)[0] == 5000
    assert tensors.sum_partials(df.where("id < 0"), lambda batches: None) is None
    big = tensors.sum_partials(spark.range(40).repartition(4), lambda batches: np.full(3 * tensors.SLICE_VALUES + 5, float(sum(b.num_rows for b in batches))))
    assert len(big) == 3 * tensors.SLICE_VALUES + 5 and (big == 40).all()


def test_timer():
    from patchloom.shared import Timer

    t = Timer()
    assert 0 <= t.lap() <= t.total()
    t.reset()
    assert t.lap() < 60


def test_mosaic_of_rows_equals_mosaic(spark):
    x = RNG.random((7, 3, 4, 3))
    df = spark.createDataFrame([(i, 3, 4, 3, x[i].ravel().tolist()) for i in range(7)], "id long, h int, w int, c int, data array<double>").repartition(3)
    want = extract.mosaic(x)
    got = np.full(want.shape, np.nan)
    for r in extract.mosaic_cells(df, F.col("id"), 7).collect():
        got[r["i"], r["j"], r["ch"]] = r["v"]
    assert np.abs(got - want).max() < 1e-9
    assert extract.mosaic_cells(df.where("id < 0"), F.col("id"), 0).count() == 0
