import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.sources import binary as B
from patchloom.sources import folders as S


def test_cifar_files_split_and_keep_their_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (50, 3, 4, 4), dtype=np.uint8), rng.integers(0, 10, 50, dtype=np.uint8)
    for k in range(2):
        (tmp_path / f"b{k}").write_bytes(b"".join(bytes([y[i]]) + x[i].tobytes() for i in range(25 * k, 25 * k + 25)))
    paths = [str(tmp_path / f"b{k}") for k in range(2)]
    assert B.fixed_records(spark, paths, 49, range_bytes=200).rdd.getNumPartitions() > 4
    out = B.cifar(spark, paths, side=4).orderBy("id").collect()
    np.testing.assert_array_equal([r["data"] for r in out], x.transpose(0, 2, 3, 1).reshape(50, -1))
    assert [r["label"] for r in out] == y.tolist() and {r["coarse_label"] for r in out} == {None}
    gray = B.cifar(spark, paths, gray=True, side=4).orderBy("id").collect()
    np.testing.assert_allclose([r["data"] for r in gray], x.mean(1).reshape(50, -1))
    (tmp_path / "fine").write_bytes(bytes([7, 3]) + x[0].tobytes())
    r = B.cifar(spark, [str(tmp_path / "fine")], fine=True, side=4).first()
    assert (r["coarse_label"], r["label"]) == (7, 3)


def test_broken_files_are_refused(spark, tmp_path):
    (tmp_path / "short").write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="no file of records"):
        B.fixed_records(spark, [str(tmp_path / "short")], 49).count()
    (tmp_path / "empty").write_bytes(b"")
    assert B.fixed_records(spark, [str(tmp_path / "empty")], 49).count() == 0


def test_mnist_plain_and_compressed(spark, tmp_path):
    x, y = np.arange(5 * 6, dtype=np.uint8).reshape(5, 2, 3), np.arange(5, dtype=np.uint8)
    images, labels = struct.pack(">4i", 0x803, 5, 2, 3) + x.tobytes(), struct.pack(">2i", 0x801, 5) + y.tobytes()
    for name, pack in (("", bytes), (".gz", gzip.compress)):
        (tmp_path / f"i{name}").write_bytes(pack(images))
        (tmp_path / f"l{name}").write_bytes(pack(labels))
        out = B.mnist(spark, str(tmp_path / f"i{name}"), str(tmp_path / f"l{name}")).orderBy("id").collect()
        assert [(r["label"], r["h"], r["w"], r["c"]) for r in out] == [(i, 2, 3, 1) for i in range(5)]
        np.testing.assert_array_equal([r["data"] for r in out], x.reshape(5, -1))


def test_unlabelled_stl(spark, tmp_path):
    x = np.arange(2 * 27, dtype=np.uint8).reshape(2, 3, 3, 3)
    (tmp_path / "u").write_bytes(x.transpose(0, 1, 3, 2).tobytes())
    out = B.stl10(spark, str(tmp_path / "u"), side=3).orderBy("id").collect()
    np.testing.assert_array_equal([r["data"] for r in out], x.transpose(0, 2, 3, 1).reshape(2, -1))
    assert {r["label"] for r in out} == {None}


def test_image_folders(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {}
    for c, k in (("beta", 2), ("alpha", 3)):
        (tmp_path / c).mkdir()
        for i in range(k):
            pictures[f"{c}/{i}.PNG"] = rng.integers(0, 256, (3, 4, 3))
            (tmp_path / c / f"{i}.PNG").write_bytes(S.png_bytes(pictures[f"{c}/{i}.PNG"]))
        (tmp_path / c / "note.txt").write_text("no image")
    out = S.two_layer_images(spark, str(tmp_path), ("png",)).collect()
    assert len(out) == 5 and {(r["class_name"], r["label"]) for r in out} == {("alpha", 0), ("beta", 1)}
    for r in out:
        np.testing.assert_array_equal(np.array(r["data"]).reshape(3, 4, 3), pictures["/".join(r["path"].split("/")[-2:])])
    assert tuple(S.broken_images(spark, str(tmp_path / "*")).first()) == (7, 2)


def test_annotations(spark, tmp_path):
    (tmp_path / "n1").write_text("<annotation><object><name>a</name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>50</xmax><ymax>60</ymax></bndbox></object><object><name>b</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>2</xmax><ymax>2</ymax></bndbox></object></annotation>")
    assert [tuple(r) for r in S.dog_annotations(spark, str(tmp_path)).collect()] == [("n1", 4, 5, 50, 60)]


def test_crops_and_parts(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0)], "x double, y double, w double, h double")
    crop = S.crop_window(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 1.5, F.lit(62), F.lit(100))
    df = df.withColumn("crop", crop)
    assert tuple(df.first()["crop"]) == (3, 10, 48, 61)
    parts = F.array(F.struct(F.lit(3.0).alias("x"), F.lit(10.0).alias("y")), F.struct(F.lit(-1.0).alias("x"), F.lit(20.0).alias("y")), F.struct(F.lit(48.0).alias("x"), F.lit(20.0).alias("y")))
    assert [tuple(p) for p in df.select(S.shifted_parts(parts, F.col("crop"))).first()[0]] == [(0.0, 0.0), (-1.0, -1.0), (-1.0, -1.0)]


def test_matrices(spark, tmp_path):
    x = np.random.default_rng(2).random((20, 3, 2))
    df = S.from_array(spark, x)
    assert df.columns == ["id", "label", "h", "w", "c", "data"]
    with pytest.raises(ValueError):
        S.from_array(spark, x, np.zeros(3))
    S.dump_npy(df.repartition(3), "data", str(tmp_path / "m"))
    back = S.load_npy(spark, str(tmp_path / "m/*.npy"))
    assert sorted(map(tuple, (r["data"] for r in back.collect()))) == sorted(map(tuple, x.reshape(20, -1)))
    S.npy_to_parquet(spark, str(tmp_path / "m/*.npy"), str(tmp_path / "p"))
    assert S.load_matrix(spark, str(tmp_path / "p")).count() == 20
    S.dump_matrix(df, str(tmp_path / "one"), 1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def test_bird_list_names_make_the_round_trip(spark, tmp_path):
    names = ["plain/a.jpg", "with blank/a b.jpg", "back\\slash\\a.jpg", "both \\ of them\\", 'quo"ted "name".jpg', " outer "]
    images = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "image_id long, path string")
    of = lambda value: images.select("image_id", *[F.expr(v) for v in value])
    for name, rows in (("images", images), ("image_class_labels", of(["1"])), ("train_test_split", of(["1"])), ("bounding_boxes", of(["1.0", "2.0", "3.0", "4.0"])), ("classes", spark.createDataFrame([(1, "a \\ class")], "c int, n string"))):
        S.write_list(rows, f"{tmp_path}/{name}.txt")
    have = S.bird_list(spark, str(tmp_path)).collect()
    assert {r["image_id"]: r["path"] for r in have} == dict(enumerate(names))
    assert {r["class_name"] for r in have} == {"a \\ class"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_bird_parts_of_all_names(spark):
    from patchloom.queries import files

    rows = files._birds(spark, "/root/testdata/sf0.01").where("box_x > 0 and box_y > 0 and box_w > 2 and box_h > 2")
    odd = {r["image_id"] for r in rows.where("contains(images, ' ') or contains(images, '\\\\')").collect()}
    have = {r["image_id"] for r in files.QUERIES["A9_bird_parts"](spark, "/root/testdata/sf0.01").collect()}
    assert odd and odd & have


def test_other_files_are_never_opened(spark, tmp_path):
    """Extensions match in any case before anything is decoded; labels rank the folders that have such files."""
    for name, body in (("b/x.PNG", S.png_bytes(np.full((2, 2), 7.0))), ("a/y.Jpeg", b"broken"), ("c/z.txt", b"text"), ("a/w.gif", b"gif")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = S.two_layer_images(spark, f"file://{tmp_path}").orderBy("label").collect()
    assert [(r["class_name"], r["label"], r["h"]) for r in rows] == [("a", 0, -1), ("b", 1, 2)]


def test_rows_of_matrix_parts_have_their_places(spark, tmp_path):
    df = spark.range(90).repartitionByRange(4, "id").sortWithinPartitions("id")
    S.dump_matrix(df, f"file://{tmp_path}/m")
    rows = S.load_matrix(spark, f"file://{tmp_path}/m", True).orderBy("part", "row").collect()
    assert [r["id"] for r in rows] == list(range(90)) and len({r["part"] for r in rows}) == 4


def test_places_without_a_scheme_are_refused_on_a_cluster():
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="scheme"):
        B.checked_place(Cluster, "/data/images")
    B.checked_place(Cluster, "file:///data/images", "hdfs://host/images")


@pytest.fixture
def cluster(spark, tmp_path, monkeypatch):
    """The session as it looks on a cluster whose spark.checkpoint.dir has no scheme, and a blank in it."""
    get = type(spark.conf).get
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: f"{tmp_path}/a b" if key == "spark.checkpoint.dir" else get(self, key, *rest))
    return spark


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["A15_load_matrix_multi", "A3_two_layer", "A6_mnist", "B4_dump_images", "A16_verify_images", "A5_cifar", "A7_stl10", "B5_convert"])
def test_the_shared_folder_needs_no_scheme(cluster, monkeypatch, tmp_path, name):
    from patchloom import queries

    rows = lambda: sorted(map(tuple, queries.all_queries()[name](cluster, "/root/testdata/sf0.001").collect()))
    have = rows()
    assert any((tmp_path / "a b").rglob("*"))
    monkeypatch.undo()
    assert have and have == rows()
