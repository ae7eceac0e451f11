"""Hand fixtures and properties of the operators."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions.names import out_prefix
from rasterloom.operators import boxes, dataset, depth, geometry, mapping, masks, raster, schedule
from rasterloom.plans.pipeline import Pipeline
from rasterloom.sources import codecs, images


def grid(spark, rows, image=1):
    data = [(image, y, x, float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)]
    return spark.createDataFrame(data, "img int, y int, x int, v double")


def test_prefixes():
    assert out_prefix("warped_", "inpainted_+") == "inpainted_warped_"
    assert out_prefix("", "+point_") == "point_"
    assert out_prefix(["x_", "y_"], None) == "x_"


@pytest.mark.parametrize("rows,counts", [([[0, 1, 1], [1, 1, 0]], [1, 4, 1]), ([[1, 1], [1, 1]], [0, 4]), ([[0, 0], [0, 0]], [4])])
def test_run_lengths(spark, rows, counts):
    px = grid(spark, rows)
    rle = masks.rle_encode(px, "img", F.col("v") > 0, len(rows))
    assert rle.first()["counts"] == counts
    assert rle.select(masks.rle_area(F.col("counts"))).first()[0] == sum(map(sum, rows))
    back = {(r["y"], r["x"]) for r in masks.rle_decode(rle, "img", len(rows)).collect()}
    assert back == {(y, x) for y, r in enumerate(rows) for x, v in enumerate(r) if v}


def test_mask_box(spark):
    px = grid(spark, [[0, 1, 1], [1, 1, 0]]).union(grid(spark, [[0, 0], [0, 0]], 2))
    got = {r["img"]: tuple(r)[1:] for r in masks.mask_boxes(px, "img", F.col("v") > 0).collect()}
    assert got == {1: (0, 0, 2, 1, 4), 2: (0, 0, 0, 0, 0)}


def test_stability(spark):
    got = masks.stability(grid(spark, [[2, 0.5, -0.5, -2]]), "img", F.col("v")).first()["stability"]
    assert got == pytest.approx(1 / 3)
    assert masks.stability(grid(spark, [[-9.0]]), "img", F.col("v")).first()["stability"] is None


# the fourth overlaps the first by 0.4706 and the dropped second by more: only kept boxes suppress
@pytest.mark.parametrize("threshold,kept", [(0.5, {1, 3, 4}), (0.7, {1, 2, 3, 4})])
def test_box_nms(spark, threshold, kept):
    rows = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 1.0, 11.0, 11.0), (1, 3, 0.7, 20.0, 20.0, 30.0, 30.0), (1, 4, 0.6, 2.0, 2.0, 12.0, 12.0)]
    b = spark.createDataFrame(rows, "img int, mask_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert {r["mask_id"] for r in boxes.nms(b, "img", threshold).collect()} == kept


def test_contained_nms(spark):
    m = spark.createDataFrame([(1, 1, [1, 2, 3, 4]), (1, 2, [1, 2])], "img int, mask_id int, pixels array<int>")
    assert [r["mask_id"] for r in masks.contained_nms(m, "img").collect()] == [1]


def test_crops_and_points(spark):
    got = [tuple(r)[1:] for r in boxes.crop_boxes(spark, 200, 100, 1, 0.1).orderBy("layer", "x1", "y1").collect()]
    assert got == [(0, 0, 200, 100), (0, 0, 105, 55), (0, 45, 105, 100), (95, 0, 200, 55), (95, 45, 200, 100)]
    assert [(r["x"], r["y"]) for r in boxes.point_grid(spark, 2).orderBy("idx").collect()] == [(0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)]


def test_sizes(spark):
    v = spark.createDataFrame([(525.0,), (511.0,), (520.0,)], "v double").select(boxes.to_multiple(F.col("v"), 14, 518).alias("s"))
    assert [r["s"] for r in v.collect()] == [532, 518, 518]
    assert tuple(spark.range(1).select(*boxes.longest_side(F.lit(600.0), F.lit(800.0), 1024)).first()) == (768, 1024)


def test_depth(spark):
    px = spark.createDataFrame([(1, float(i), 2.0 * i) for i in (1, 2, 3)], "img int, d1 double, d2 double")
    assert sorted(r["d2"] for r in depth.align(px, ["img"], "d1", "d2", F.lit(True)).collect()) == [1.0, 2.0, 3.0]
    one = grid(spark, [[1, 2, 3, 4]])
    assert max(r["v"] for r in depth.normalise(one, ["img"], "v", "median").collect()) == 2.0
    z = spark.createDataFrame([(0.5,), (2.0,), (1e10,)], "d double").select(depth.z_buffer(F.col("d"), F.lit(0.5)).alias("z"))
    assert [round(r["z"], 4) for r in z.collect()] == [0.0, 0.8333, 1.0]
    m = depth.metrics(spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 4.0)], "k int, g double, p double"), ["k"], "g", "p").first()
    assert [round(v, 6) for v in tuple(m)[1:]] == [0.5, 0.5, 0.5, 0.5, 1.0, 1.414214, 0.490129, 34.657359, 0.150515]


def test_schedule(spark):
    rows = schedule.with_alphas(schedule.linear_betas(spark, 1000)).orderBy("t").collect()
    assert rows[0]["beta"] == pytest.approx(1e-4) and rows[-1]["beta"] == pytest.approx(0.02) and rows[0]["alpha_bar"] == pytest.approx(0.9999)
    pairs = [(r["t"], r["t_prev"]) for r in schedule.ddim_pairs(spark, 1000, 50).orderBy("i").collect()]
    assert pairs[0] == (1000, 980) and pairs[-1] == (20, 0) and len(pairs) == 50


def test_views(spark):
    assert [r["id"] for r in dataset.replicate(spark.range(2), 3).orderBy("id", "view_idx").collect()] == [0, 0, 0, 1, 1, 1]
    rows = dataset.dense_index(spark.range(7), "id")
    assert [r["id"] for r in dataset.part(rows, 3, 1).orderBy("id").collect()] == [1, 4]
    parts = [dataset.part(rows, 3, i).count() for i in range(3)]
    assert sum(parts) == 7


def test_pose_inverse(spark):
    rows = geometry.rotation(F.lit(20.0), F.lit(10.0), F.lit(5.0))
    p = spark.range(1).select(F.array(*[F.array(*r) for r in rows]).alias("r"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("t"))
    got = p.select("*", *geometry.invert_rigid("r", "t")).first()
    r, t, ri, ti = (np.array(got[c]) for c in ("r", "t", "r_inv", "t_inv"))
    assert np.allclose(r @ ri, np.eye(3)) and np.allclose(r @ ti + t, 0)


def test_config(spark):
    assert mapping.flatten_dict({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}
    t = spark.createDataFrame([("3",), ("3.5",), ("a",)], "t string").select(mapping.infer_type(F.col("t")).alias("q"))
    assert [tuple(r["q"]) for r in t.collect()] == [("int", "3"), ("float", "3.5"), ("str", "a")]
    with pytest.raises(Exception, match="duplicate key"):
        spark.range(1).select(mapping.strict_merge(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))).collect()


def test_regions():
    m = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 1]], bool)
    labels, n = raster.label_regions(m)
    assert n == 3 and labels[0, 0] == labels[1, 1] == labels[0, 2]
    kept, changed = raster.remove_small_regions(m, 2, "islands")
    assert changed and kept.sum() == 3
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    filled, changed = raster.remove_small_regions(ring, 2, "holes")
    assert changed and filled.all()


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=40))
def test_counts_text(counts):
    assert codecs.unpack_counts(codecs.pack_counts(counts)) == counts


@pytest.mark.parametrize("dtype,c", [(bool, 1), (np.uint8, 1), (np.uint8, 3), (np.uint16, 4), (np.float16, 1), (np.float32, 3)])
def test_image_codec(dtype, c):
    a = (np.random.default_rng(1).random((5, 7, c)) * (1 if dtype == bool else 200)).round().astype(dtype)
    assert np.array_equal(codecs.unpack_image(codecs.pack_image(a)), a[..., 0] if c == 1 else a)


def test_scan(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "annotations").mkdir()
    for n in ("b.x", "a"):
        (tmp_path / "images" / f"{n}.jpg").write_bytes(b"1")
    (tmp_path / "annotations" / "a.json").write_text('{"annotations": [{"bbox": [1.7, 2, 3, 4], "area": 5, "crop_box": [0, 0, 9, 9]}]}')
    rows = {r["filename"]: r["annotations"] for r in images.scan_annotated(spark, str(tmp_path)).collect()}
    assert rows["b.x"] is None and rows["a"][0]["bbox"] == [1, 2, 3, 4]


def test_pipeline_hoists():
    def double(df):
        return df + ["double"]

    def spread(df):
        return df + ["spread"]

    spread.replicates, double.per_image = True, True
    p = Pipeline([spread, double])
    assert len(p) == 2 and p([]) == ["double", "spread"]
