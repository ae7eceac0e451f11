"""Contours, object masks and configuration against plain versions; the crop queries against their SQL."""

import os
import statistics

import numpy as np
import pytest

from rasterloom import runtime
from rasterloom.operators import mapping, predict, raster
from rasterloom.plans import crop_queries, registry
from rasterloom.sources import codecs, images, sinks
from tests import test_queries


@pytest.mark.skipif(not os.path.isdir(test_queries.DATA), reason="no tables")
@pytest.mark.parametrize("name", ["centre_crop", "crop_points", "uncrop_raster", "select_mask", "resize_and_pad", "annotation_to_mask", "schedule_lookup", "warp_pose", "flow", "take_rows", "segment_masks", "multi_view_chain", "resize_lanczos", "resize_bicubic", "object_crop", "small_regions_holes"])
def test_crop_query(spark, name):
    assert hasattr(crop_queries, name) or hasattr(registry, name)
    test_queries.test_query(spark, name)


def plain_contour(mask, disparity, radius, edge):
    """Pixel by pixel, from the definition."""
    h, w = mask.shape

    def shape(size):
        r = size // 2
        return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if abs(x) <= round((r * r - y * y) ** 0.5)]

    def around(y, x, places):
        return [(y + a, x + b) for a, b in places if 0 <= y + a < h and 0 <= x + b < w]

    small, wide = shape(2 * radius + 1), shape(2 * radius + 5)
    grown = {(y, x) for y in range(h) for x in range(w) if any(mask[q] for q in around(y, x, small))}
    closed = {(y, x) for y in range(h) for x in range(w) if all(q in grown for q in around(y, x, wide))}
    front = behind = total = 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in closed:
                near = [q for q in around(y, x, [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]) if mask[q]]
                own = statistics.median_high([int(disparity[q] * 255) for q in near]) / 255
                other = max(0.0 if q in grown else disparity[q] for q in around(y, x, wide))
                total += 1
                front += other - own > edge
                behind += own - other > edge
    return (front / total, behind / total) if total else (float("nan"), float("nan"))


@pytest.mark.parametrize("seed", range(6))
def test_contour(seed):
    rng = np.random.default_rng(seed)
    mask = np.zeros((22, 26), bool)
    mask[6 : 15 + seed % 3, 7:18] = True
    mask &= rng.random(mask.shape) > 0.02 * seed
    disparity = np.where(mask, 0.8, 0.3) * rng.uniform(0.8, 1.2, mask.shape)
    disparity[:, 16 + seed :] = 0.99
    got, want = raster.contour_ratios(mask, disparity, 2), plain_contour(mask, disparity, 2, 0.05)
    assert got == pytest.approx(want, nan_ok=True)


def test_object_tests():
    def test(x, y, side, level=0.9, behind=0.1, **more):
        mask = np.zeros((128, 128), bool)
        mask[y : y + side, x : x + side] = True
        d = np.where(mask, level, behind)
        d[0, 0] = 1.0
        for (a, b), v in more.items():
            mask[a, b] = v
        return predict.failed_test(mask, d, 3, 20)

    assert test(40, 40, 10) == "size" and test(2, 40, 30) == "border" and test(100, 60, 28) == "border"
    assert test(40, 40, 30, level=0.4) == "distance" and test(40, 40, 30, behind=0.95) == "surroundings" and test(40, 40, 30) is None
    mask = np.zeros((128, 128), bool)
    mask[40:70, 40:70] = mask[74, 74] = True
    assert predict.failed_test(mask, np.where(mask, 0.9, 0.1), 3, 20) == "pieces"
    assert predict.failed_test(np.zeros((4, 4), bool), np.ones((4, 4)), 2, 1) == "size"


def test_settings():
    s = mapping.settle([{"a": "1", "deep": {"x": [{"y": 2}]}}, {"a": "2", "n": "3,4", "on": 0}], {"__p__q": "5;6.5", "on": 1}, flags=("on",), lists=("n",))
    assert (s.a, s.deep.x[0].y, s.n, s.on, s.p, s.q) == (2, 2, [3, 4], True, 5, 6.5)
    assert mapping.command_line(["--a=1", "--b", "x", "--c", "2.5"]) == {"a": 1, "b": "x", "c": 2.5}
    with pytest.raises(ValueError):
        mapping.one_of("mode", "z", ["x"])
    with pytest.raises(TypeError):
        mapping.listed([1, "a"])
    with pytest.raises(AttributeError):
        s.missing


def test_shared_conflict():
    predict.shared("one of a kind", predict._stub_depth)
    with pytest.raises(ValueError):
        predict.shared("one of a kind", predict._stub_saliency)


def test_soft_mask():
    mask = np.zeros((20, 20), bool)
    mask[5:15, 6:14] = True
    field = raster.signed_distance(mask, 3)
    for y in range(20):
        for x in range(20):
            other = [abs(y - a) + abs(x - b) for a in range(20) for b in range(20) if mask[a, b] != mask[y, x]]
            far = min(min(other) - 1, 3) + 0.5
            assert field[y, x] == (-far if mask[y, x] else far)
    soft = raster.soften(mask, 3)
    assert soft[10, 10] == 1 and soft[0, 0] == 0 and 0 < soft[5, 10] < 1 and np.allclose(soft, soft[:, ::-1])


def test_image_folder(spark, tmp_path):
    (tmp_path / "images").mkdir()
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 256, (12, 20, 3)).astype(np.uint8)
    for name, a in (("wide", wide), ("grey", np.full((6, 6), 51, np.uint8)), ("clear", np.full((5, 4, 4), 255, np.uint8))):
        (tmp_path / "images" / f"{name}.png").write_bytes(codecs.pack_image(a))
    got = {r["filename"]: np.array(r["image"]) for r in images.load_images(spark, str(tmp_path), 12).collect()}
    assert np.allclose(got["wide"], (wide[:, 4:16] / 255).ravel()) and np.allclose(got["grey"], 0.2) and np.allclose(got["clear"], 1)
    small = {r["filename"]: np.array(r["image"]) for r in images.load_images(spark, str(tmp_path), 4, normalize=True).collect()}
    assert all(len(v) == 48 and abs(v).max() <= 1 for v in small.values()) and np.allclose(small["grey"], -0.6)
    assert np.allclose(raster.resample_matrix(8, 5, "lanczos").sum(axis=1), 1) and np.allclose(raster.resample_matrix(7, 7, "bicubic"), np.eye(7))
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id int, kind string, v double")
    sinks.write_views(df, str(tmp_path / "out"), ["id", "kind"], ["kind"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("id", "kind").collect()) == [(1, "a"), (2, "b")] and (tmp_path / "out" / "kind=a").is_dir()


def test_files(spark, tmp_path):
    (tmp_path / "config_m_v1.json").write_text('{"model": {"a": 1, "b": 2}, "base": {"b": 3, "c": 4}, "train": {"inherit": "base", "c": 5}}')
    assert mapping.read_config(spark, str(tmp_path), "m", "v1") == {"a": 1, "b": 3, "c": 5, "inherit": "base"}
    shared = runtime.shared_file(spark, str(tmp_path / "config_m_v1.json"))
    assert shared.value.startswith(b'{"model"')
    with pytest.raises(ValueError):
        runtime.shared_file(spark, str(tmp_path / "config_m_v1.json"), most=3)
