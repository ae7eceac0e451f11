"""Registered queries on crops, points, warps and schedules, with their SQL."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators import boxes, crops, geometry, masks, predict, raster, schedule
from ..sources import codecs, images
from . import chains
from .registry import BX, LIN, PX, UNIFORM, _orders, _rasters, _regions, _rle, query, r6, signed6

AB = f"{LIN}, a AS (SELECT t, beta, product(1 - beta) OVER (ORDER BY t) AS ab FROM b), p AS (SELECT *, coalesce(lag(ab) OVER (ORDER BY t), 1.0) AS pr FROM a)"


def _part(s, d):
    return s.read.parquet(f"{d}/part.parquet")


@query("""WITH q AS (SELECT p_partkey, 100 + p_size AS w, 60 + p_partkey % 80 AS h FROM part)
SELECT p_partkey, w // 2 - least(w, h) // 2 AS x1, h // 2 - least(w, h) // 2 AS y1, w // 2 + least(w, h) // 2 AS x2, h // 2 + least(w, h) // 2 AS y2 FROM q""")
def centre_crop(s, d):
    return _part(s, d).select("p_partkey", *crops.centre_crop(100 + F.col("p_size"), 60 + F.col("p_partkey") % 80))


@query(f"WITH {BX} SELECT img, mask_id, greatest(0, x1 - 6) AS wx1, greatest(0, y1 - 6) AS wy1, least(48, x1 + w + 6) AS wx2, least(32, y1 + h + 6) AS wy2 FROM bb")
def window_round_box(s, d):
    b = images.boxes(s, d)
    return b.select("img", "mask_id", *crops.window_round(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), 48, 32, 6))


GRIDS = "g AS (SELECT l AS layer, i AS idx, n, (i % n + 0.5) / n AS gx, (i // n + 0.5) / n AS gy FROM (VALUES (0, 8), (1, 4), (2, 2)) t(l, n), range(64) r(i) WHERE i < n * n)"


@query(f"WITH {GRIDS} SELECT layer, idx, gx::DOUBLE AS x, gy::DOUBLE AS y FROM g")
def layer_grids(s, d):
    return crops.layer_grids(s, 8, 2, 2)


@query(f"""WITH {GRIDS}, c AS (SELECT o_orderkey, o_orderkey % 3 AS layer, (o_orderkey % 17)::INT AS x1, (o_orderkey % 13)::INT AS y1, 20 + (o_orderkey % 7)::INT AS cw FROM orders)
SELECT o_orderkey, idx, round(gx * cw, 6)::DOUBLE AS px, round(gy * 24, 6)::DOUBLE AS py, round(gx * cw + x1, 6)::DOUBLE AS ix, round(gy * 24 + y1, 6)::DOUBLE AS iy FROM c JOIN g USING (layer)""")
def crop_points(s, d):
    o = _orders(s, d).select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("layer"), (F.col("o_orderkey") % 17).cast("int").alias("x1"), (F.col("o_orderkey") % 13).cast("int").alias("y1"))
    c = o.withColumn("x2", F.col("x1") + 20 + (F.col("o_orderkey") % 7).cast("int")).withColumn("y2", F.col("y1") + 24)
    met = c.join(F.broadcast(crops.layer_grids(s, 8, 2, 2)), "layer")
    px, py = F.col("x") * (F.col("x2") - F.col("x1")), F.col("y") * (F.col("y2") - F.col("y1"))
    return met.select("o_orderkey", "idx", *[F.round(v, 6).alias(n) for n, v in (("px", px), ("py", py), ("ix", px + F.col("x1")), ("iy", py + F.col("y1")))])


@query(f"""WITH {PX}, c AS (SELECT DISTINCT img FROM px) SELECT c.img, i // 12 AS y, i % 12 AS x, coalesce(round(px.v, 6), 0) AS v
FROM c CROSS JOIN range(120) r(i) LEFT JOIN px ON px.img = c.img AND px.y = i // 12 - 1 AND px.x = i % 12 - 3""")
def uncrop_raster(s, d):
    return crops.uncrop_raster(images.pixels(s, d), "img", "v", 3, 1, 12, 10).select("img", "y", "x", r6("v"))


@query("""WITH q AS (SELECT p_partkey, [p_size / 50.0::DOUBLE, (p_partkey % 7) / 7.0::DOUBLE, (p_partkey % 11) / 11.0::DOUBLE] AS s, p_partkey % 5 AS n FROM part),
k AS (SELECT *, [s[1] + (n - 2.5) * 1000, s[2], s[3]] AS t FROM q)
SELECT p_partkey, (list_position(t, list_max(t)) - 1)::INT AS best, CASE WHEN n > 2 THEN 2 ELSE 1 END AS kept FROM k""")
def select_mask(s, d):
    n = F.col("p_partkey") % 5
    scores = F.array(F.col("p_size") / 50.0, (F.col("p_partkey") % 7) / 7.0, (F.col("p_partkey") % 11) / 11.0)
    return _part(s, d).select("p_partkey", crops.select_mask(scores, n).alias("best"), F.size(crops.multimask(scores, n > 2)).alias("kept"))


@query("""WITH q AS (SELECT p_partkey, 100 + p_size AS w, 60 + p_partkey % 80 AS h FROM part),
z AS (SELECT *, least(90.0::DOUBLE / h, 120.0::DOUBLE / w) AS f FROM q), n AS (SELECT *, trunc(w * f)::INT AS nw, trunc(h * f)::INT AS nh FROM z)
SELECT p_partkey, trunc(w * (64.0::DOUBLE / least(h, w)))::INT AS sw, trunc(h * (64.0::DOUBLE / greatest(h, w)))::INT AS lh, nw, nh, (120 - nw) // 2 AS l, (90 - nh) // 2 AS t,
 120 - nw - (120 - nw) // 2 AS r, 90 - nh - (90 - nh) // 2 AS b FROM n""")
def resize_and_pad(s, d):
    h, w = 60 + F.col("p_partkey") % 80, 100 + F.col("p_size")
    pad = crops.pad_offsets(h, w, 90, 120, "max_fit")
    out = [crops.resize_size(h, w, 64, "shorter")[0].alias("sw"), crops.resize_size(h, w, 64, "longer")[1].alias("lh")]
    return _part(s, d).select("p_partkey", *out, *[c.alias(n) for c, n in zip(pad, ("nw", "nh", "l", "t", "r", "b"), strict=True)])


@query(f"""WITH {PX} SELECT c.img, [coalesce(v, 0.0) FOR v IN list(round(px.v, 6) ORDER BY i)] AS v
FROM (SELECT DISTINCT img FROM px) c CROSS JOIN range(100) r(i) LEFT JOIN px ON px.img = c.img AND px.y = i // 10 AND px.x = i % 10 GROUP BY c.img""")
def pad_square(s, d):
    padded = crops.pad_square(F.col("values"), 8, 8, 10)
    return _rasters(s, d).select(F.col("id").alias("img"), F.transform(padded, signed6).alias("v"))


@query(f"WITH {PX} SELECT img, p, round(v, 6) AS value, (v > 0)::DOUBLE AS alpha, round(CASE WHEN v > 0 THEN 1 - v ELSE v END, 6) AS mixed FROM px")
def alpha_channel(s, d):
    r = _rasters(s, d).withColumn("value", F.col("values")).withColumn("alpha", F.transform("values", lambda v: (v > 0).cast("double")))
    z = r.select(F.col("id").alias("img"), F.posexplode(crops.with_alpha(F.col("value"), F.col("alpha"))).alias("p", "z")).select("img", "p", "z.*")
    mixed = crops.composite(F.col("value"), 1 - F.col("value"), F.col("alpha") > 0)
    return z.select("img", "p", r6("value"), "alpha", F.round(mixed, 6).alias("mixed"))


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) SELECT p AS pos, row_idx, o_orderkey FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 0)) t(p, i) JOIN o ON o.row_idx = i")
def take_rows(s, d):
    from ..operators import dataset

    return crops.take(dataset.dense_index(_orders(s, d).select("o_orderkey"), "o_orderkey"), "row_idx", [5, 2, 5, 0]).select("pos", "row_idx", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, 0 AS batch FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderkey % 2 = 0")
def concatenate(s, d):
    o = _orders(s, d)
    second = crops.accepted(o.where("o_orderkey % 2 = 0"), ["o_orderstatus", "o_orderkey", "not_there"])
    both = crops.concatenate([o.select("o_orderkey", "o_orderstatus"), second.select("o_orderstatus", "o_orderkey")])
    return both.select("o_orderkey", crops.checked(F.col("o_orderstatus"), ["F", "O", "P"]).alias("o_orderstatus"), "batch")


@query(f"WITH {PX} SELECT img, y, x FROM px WHERE v > 0")
def annotation_to_mask(s, d):
    """Masks out of annotation text: run lengths to text, into JSON, parsed, decoded."""
    coded = codecs.with_text_counts(_rle(s, d), "img")
    record = F.to_json(F.struct(F.struct(F.array(F.lit(8), F.lit(8)).alias("size"), F.col("text").alias("counts")).alias("segmentation")))
    return masks.from_annotations(coded.select("img", record.alias("json")), "img", "json", 8)


@query(f"""WITH {PX}, {AB}, q AS (SELECT img, label, p.t, ab, pr, beta, y, x, v FROM px JOIN p ON p.t = (img * 37) % 1000)
 SELECT img, y, x, t, round(sqrt(ab) * v, 6) AS signal, round(sqrt(1 - ab), 6) AS noise,
 round(beta * sqrt(pr) / (1 - ab) * greatest(least(sqrt(1 / ab) * v - sqrt(1 / ab - 1) * (v * v), 1), -1) + (1 - pr) * sqrt(1 - beta) / (1 - ab) * v
  + CASE WHEN t > 0 THEN sqrt(beta * (1 - pr) / (1 - ab)) * (v * v * v) ELSE 0 END, 6) AS prev FROM q""")
def schedule_lookup(s, d):
    px = images.pixels(s, d).withColumn("t", F.col("img") * 37 % 1000)
    q = schedule.lookup(px, schedule.posterior(schedule.with_alphas(schedule.linear_betas(s, 1000))), "t")
    v, ab = F.col("v"), F.col("alpha_bar")
    prev = schedule.ddpm_step(v, v * v, v * v * v, "t", clip=True)
    return q.select("img", "y", "x", "t", F.round(F.sqrt(ab) * v, 6).alias("signal"), F.round(F.sqrt(1 - ab), 6).alias("noise"), F.round(prev, 6).alias("prev"))


@query(f"WITH {PX}, q AS (SELECT img, floor(((img * 3) % 10) / 10.0::DOUBLE * 8)::INT AS x, floor(((img * 7) % 10) / 10.0::DOUBLE * 8)::INT AS y FROM (SELECT DISTINCT img FROM px)) SELECT img, round(v, 6) AS at FROM q JOIN px USING (img, y, x)")
def pixel_gather(s, d):
    at = geometry.pixel_at(F.col("values"), (F.col("id") * 3 % 10) / 10.0, (F.col("id") * 7 % 10) / 10.0, 8, 8)
    return _rasters(s, d).select(F.col("id").alias("img"), F.round(at, 6).alias("at"))


def _normal(seed: str) -> str:
    u, v = (UNIFORM.format(key="img", seed=seed + x) for x in "ab")
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


@query(f"""WITH {PX}, k AS (SELECT img, 2 + v AS depth FROM px WHERE y = floor(((img * 7) % 10) / 10.0::DOUBLE * 8)::INT AND x = floor(((img * 3) % 10) / 10.0::DOUBLE * 8)::INT),
 n AS (SELECT img, radians(30 * {_normal('poseyaw')}) AS a, radians(10 * {_normal('posepitch')}) AS b, radians(5 * {_normal('poseroll')}) AS c,
  0.5 + 0.1 * {_normal('poseu')} AS u, 0.5 + 0.1 * {_normal('posev')} AS w, depth * (1 + 0.1 * {_normal('posed')}) AS z, 1 + 0.1 * {_normal('poset')} AS f FROM k),
 m AS (SELECT *, (u - 0.5) * z * 2 * tan(radians(27.5)) AS cx, (w - 0.5) * z * 2 * tan(radians(27.5)) AS cy FROM n)
 SELECT img, round(cx - f * ((cos(c) * cos(a) - sin(c) * sin(b) * sin(a)) * cx - sin(c) * cos(b) * cy + (cos(c) * sin(a) + sin(c) * sin(b) * cos(a)) * z), 6) AS tx,
  round(cy - f * ((sin(c) * cos(a) + cos(c) * sin(b) * sin(a)) * cx + cos(c) * cos(b) * cy + (sin(c) * sin(a) - cos(c) * sin(b) * cos(a)) * z), 6) AS ty,
  round(z - f * (-cos(b) * sin(a) * cx + sin(b) * cy + cos(b) * cos(a) * z), 6) AS tz FROM m""")
def warp_pose(s, d):
    """Random poses that turn about the unprojected centre at the depth of a point."""
    r = _rasters(s, d).select("id", F.transform("values", lambda v: 2 + v).alias("depth"))
    p = geometry.pose(F.col("id"), "pose")
    z = geometry.pixel_at(F.col("depth"), (F.col("id") * 3 % 10) / 10.0, (F.col("id") * 7 % 10) / 10.0, 8, 8) * p["depth_factor"]
    move = geometry.turn_about(geometry.rotation(p["yaw"], p["pitch"], p["roll"]), geometry.unproject_uv(p["u"], p["v"], z, 8, 8), p["distance_factor"])
    return r.select(F.col("id").alias("img"), *[F.round(m, 6).alias(n) for m, n in zip(move, ("tx", "ty", "tz"), strict=True)])


@query(f"""WITH {PX}, m AS (SELECT img, y, x, (x + 0.5) / 8.0::DOUBLE AS u, v FROM px), t AS (SELECT img, y, x, least(greatest(x + 0.5 + v, 0.6), 7.4) - 0.5 AS g, u FROM m),
 w AS (SELECT img, y, x, u, floor(g)::INT + a AS sx, CASE WHEN a = 1 THEN g - floor(g) ELSE 1 - g + floor(g) END AS w FROM t, range(2) r(a))
 SELECT w.img, w.y, w.x, round(sum(w.w * m.u) - any_value(w.u), 6) + 0.0 AS du FROM w JOIN m ON m.img = w.img AND m.y = w.y AND m.x = w.sx GROUP BY w.img, w.y, w.x""")
def flow(s, d):
    """Sampled coordinates less the pixel's own."""
    px = images.pixels(s, d).withColumn("u", (F.col("x") + 0.5) / 8.0).withColumn("gu", F.least(F.greatest(F.col("x") + 0.5 + F.col("v"), F.lit(0.6)), F.lit(7.4)) / 8.0)
    return geometry.flow(px, "img", "u", F.col("gu"), (F.col("y") + 0.5) / 8.0, 8, 8).select("img", "y", "x", (F.round("flow", 6) + 0.0).alias("du"))


@query("""SELECT event_id, [round(least(greatest(v, 0.1), 0.9), 6) FOR v IN list_sort([(event_id % 100) / 90.0::DOUBLE, (event_id % 37) / 37.0::DOUBLE, 0.5])] AS c FROM events""")
def sorted_centres(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    c = schedule.sorted_centres(F.array((F.col("event_id") % 100) / 90.0, (F.col("event_id") % 37) / 37.0, F.lit(0.5)), 0.1, 0.9)
    return e.select("event_id", F.transform(c, lambda v: F.round(v, 6)).alias("c"))


@query(f"WITH {PX}, q AS (SELECT img, y, x, CASE WHEN (img + y) % 3 = 0 THEN v END AS given, 2 + v AS depth FROM px) SELECT img, y, x, round(coalesce(given, 1 / depth), 6) AS disparity FROM q")
def disparity_or_given(s, d):
    px = images.pixels(s, d).withColumn("given", F.when((F.col("img") + F.col("y")) % 3 == 0, F.col("v")))
    return px.select("img", "y", "x", F.round(F.coalesce("given", F.try_divide(F.lit(1.0), 2 + F.col("v"))), 6).alias("disparity"))


@query(f"""WITH {PX}, q AS (SELECT img, min(x) FILTER (v > 0.15) AS x, min(y) FILTER (v > 0.15) AS y, max(x) FILTER (v > 0.15) - min(x) FILTER (v > 0.15) + 1 AS w, max(y) FILTER (v > 0.15) - min(y) FILTER (v > 0.15) + 1 AS h,
 avg(2 + v) FILTER (v > 0.15) / max(2 + v) AS near FROM px GROUP BY img)
 SELECT img, round(near, 6) AS near FROM q WHERE NOT greatest(w, h) < 6 AND NOT (x < 8 // 32 OR y < 8 // 32 OR x + w > 8 * 31 // 32 + 1 OR y + h > 8 * 31 // 32 + 1) AND NOT near < 0.5""")
def object_mask_filters(s, d):
    """Size, border and distance tests of object masks; the border of the 8 x 8 proxies is moved out by one pixel."""
    px = images.pixels(s, d).withColumn("disp", 2 + F.col("v"))
    q = masks.object_measures(px, "img", F.col("v") > 0.15, "disp")
    return q.where(boxes.object_box_ok(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 8, 8, 6, slack=1) & ~(F.col("near") < 0.5)).select("img", r6("near"))


def _resampled(kernel: str, reach: int, new: int) -> str:
    wide = max(8 / new, 1.0)
    return f"""WITH {PX}, c AS (SELECT n, (n + 0.5) * 8.0::DOUBLE / {new} AS c FROM range({new}) r(n)),
 d AS (SELECT n, o, (o + 0.5 - c) / {wide}::DOUBLE AS d FROM c, range(8) r(o) WHERE o >= floor(c - {reach * wide} + 0.5) AND o < floor(c + {reach * wide} + 0.5)),
 k AS (SELECT n, o, {kernel} AS k FROM d), w AS (SELECT n, o, k / sum(k) OVER (PARTITION BY n) AS w FROM k),
 g AS (SELECT img, wy.n AS y, wx.n AS x, round(sum(v * wy.w * wx.w), 6) + 0.0 AS v FROM px JOIN w wy ON px.y = wy.o JOIN w wx ON px.x = wx.o GROUP BY img, wy.n, wx.n)
 SELECT img AS id, list(v ORDER BY y, x) AS values FROM g GROUP BY img"""


LANCZOS = "CASE WHEN abs(d) < 1e-12 THEN 1 WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0 END"
BICUBIC = "CASE WHEN abs(d) < 1 THEN 1.5 * abs(d) ** 3 - 2.5 * d ** 2 + 1 WHEN abs(d) < 2 THEN -0.5 * abs(d) ** 3 + 2.5 * d ** 2 - 4 * abs(d) + 2 ELSE 0 END"


def _rounded(rows):
    return rows.select("id", F.transform("values", lambda v: F.round(v, 6) + 0.0).alias("values"))


@query(_resampled(LANCZOS, 3, 5))
def resize_lanczos(s, d):
    return _rounded(predict.kernel_rows(_rasters(s, d), 8, 8, lambda a: raster.resample(a, 5, 5)))


@query(_resampled(BICUBIC, 2, 12))
def resize_bicubic(s, d):
    return _rounded(predict.kernel_rows(_rasters(s, d), 8, 8, lambda a: raster.resample(a, 12, 12, "bicubic")))


@query()
def soft_mask(s, d):
    """Soft masks of the rasters above 0; tested against a plain version."""
    return _rounded(predict.kernel_rows(_rasters(s, d), 8, 8, lambda a: raster.soften(a > 0, 3)))


def _u(name: str) -> str:
    return UNIFORM.format(key="k", seed="crop" + name)


@query(f"""WITH {BX}, q AS (SELECT img, mask_id, img || '-' || mask_id AS k, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM bb),
 z AS (SELECT *, least(greatest(greatest(y2 - y1, x2 - x1), 32), 90) AS lo, greatest(least(4 * greatest(y2 - y1, x2 - x1), 90), 32) AS hi FROM q),
 s AS (SELECT *, (lo + floor({_u('size')} * (hi - lo + 1)))::INT AS side FROM z),
 r AS (SELECT *, least(greatest(0, x2 - side), x1) AS l0, greatest(least(x1, 120 - side), x2 - side) AS l1, least(greatest(0, y2 - side), y1) AS t0, greatest(least(y1, 90 - side), y2 - side) AS t1 FROM s),
 o AS (SELECT *, (l0 + floor({_u('left')} * (l1 - l0 + 1)))::INT AS "left", (t0 + floor({_u('top')} * (t1 - t0 + 1)))::INT AS top FROM r)
 SELECT img, mask_id, side, "left", top, round(greatest(0, x1 - "left") / side::DOUBLE, 6) AS bx1, round(greatest(0, y1 - top) / side::DOUBLE, 6) AS by1,
  round(least(side, x2 - "left") / side::DOUBLE, 6) AS bx2, round(least(side, y2 - top) / side::DOUBLE, 6) AS by2 FROM o""")
def object_crop(s, d):
    b = images.boxes(s, d).select("img", "mask_id", F.concat_ws("-", "img", "mask_id").alias("k"), *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    cut = b.select("img", "mask_id", *box, *crops.object_crop(box, F.lit(120), F.lit(90), 32, F.col("k"), "crop"))
    inside = crops.in_crop(box, F.col("left"), F.col("top"), F.col("side"))
    return cut.select("img", "mask_id", "side", "left", "top", *[F.round(c, 6).alias(n) for c, n in zip(inside, ("bx1", "by1", "bx2", "by2"), strict=True)])


def _view_normal(seed: str) -> str:
    u, v = (UNIFORM.format(key="key", seed=seed + x) for x in "ab")
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


@query(f"""WITH {PX}, m AS (SELECT *, avg(v) OVER w AS a, median(v) OVER w AS h FROM px WINDOW w AS (PARTITION BY img)), s0 AS (SELECT img, p, y, x, v, 1 + abs(v - a) AS depth, abs(v - h) AS d FROM m),
 s AS (SELECT *, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS sal FROM s0 WINDOW w AS (PARTITION BY img)),
 k AS (SELECT s.*, i AS view_idx, img || '-' || i AS key FROM s, range(4) r(i)),
 f AS (SELECT img, view_idx, key, arg_min(p, -ln(1 - {UNIFORM.format(key="(key || '-' || p)", seed="point")}) / sal) AS p FROM k WHERE sal > 0 GROUP BY img, view_idx, key),
 r AS (SELECT img, (y // 2) * 4 + x // 2 AS q, v, depth, sal, avg(v) OVER (PARTITION BY img) AS a FROM s WHERE y % 2 = 1 AND x % 2 = 1),
 z AS (SELECT img, q, depth, 1 + abs(v - a) AS again, sal FROM r), g AS (SELECT img, coalesce(sum(depth) FILTER (sal > 0.3) / sum(again) FILTER (sal > 0.3), 1) AS ratio FROM z GROUP BY img),
 l AS (SELECT img, list(round(again * ratio, 6) ORDER BY q) AS aligned FROM z JOIN g USING (img) GROUP BY img),
 n AS (SELECT f.img, f.view_idx, f.key, (f.p % 8) / 8.0::DOUBLE AS u, (f.p // 8) / 8.0::DOUBLE AS v, z.depth FROM f JOIN z ON z.img = f.img AND z.q = (f.p // 8) // 2 * 4 + (f.p % 8) // 2),
 o AS (SELECT *, radians(30 * {_view_normal('poseyaw')}) AS a, radians(10 * {_view_normal('posepitch')}) AS b, depth * (1 + 0.1 * {_view_normal('posed')}) AS zc, 1 + 0.1 * {_view_normal('poset')} AS fc,
  0.1 * {_view_normal('poseu')} * 2 * tan(radians(27.5)) AS cu, 0.1 * {_view_normal('posev')} * 2 * tan(radians(27.5)) AS cv, 20 + 50 * {UNIFORM.format(key='key', seed='fov')} AS fov FROM n),
 t AS (SELECT *, zc - fc * zc * (-cos(b) * sin(a) * cu + sin(b) * cv + cos(b) * cos(a)) AS tz FROM o)
SELECT t.img AS id, any_value(aligned) AS aligned, list(u ORDER BY view_idx) AS u, list(v ORDER BY view_idx) AS v, list(round(fov, 6) ORDER BY view_idx) AS fov, list(round(tz, 6) ORDER BY view_idx) AS tz
FROM t JOIN l USING (img) GROUP BY t.img""")
def multi_view_chain(s, d):
    """Multi-view construction on the proxies with stub predictors: depth and saliency, views, points, resizing, fields of
    view, poses, inpainting (of the unwarped image, as meshes are not drawn), depth anew and aligned, one row per image."""
    from ..sources import sinks
    from . import nodes
    from .pipeline import Pipeline

    chain = Pipeline(
        [
            nodes.Predict("depth", "depth", 8), nodes.Predict("saliency", "saliency", 8), nodes.Replicate(4), nodes.ForegroundPoint(8), nodes.Resize(["image", "depth", "saliency"], 8, 4),
            nodes.FovRandom(), nodes.RandomPose(4), nodes.Predict("inpaint", "image", 4, out="inpainted_"), nodes.Predict("depth", "depth", 4, "inpainted_", "inpainted_"), nodes.AlignDepth("inpainted_", 0.3),
        ]
    )
    views = chain(_rasters(s, d).withColumnRenamed("values", "image"))
    views = views.select("id", "view_idx", F.transform("inpainted_depth", lambda v: F.round(v, 6)).alias("aligned"), F.col("point_u").alias("u"), F.col("point_v").alias("v"), r6("fov"), signed6(F.col("translation")[2]).alias("tz"))
    return sinks.multi_view(views, "id", ["aligned"], ["u", "v", "fov", "tz"])


def _nms_sql(source: str, by: str, order: str, name: str, threshold: float = 0.3) -> str:
    """CTEs that fold ``source`` by ``order`` into ``name``(by, mask_id)."""
    inter = "greatest(0, least(q.x2, a[i].x2) - greatest(q.x1, a[i].x1)) * greatest(0, least(q.y2, a[i].y2) - greatest(q.y1, a[i].y1))"
    both = "(q.x2 - q.x1) * (q.y2 - q.y1) + (a[i].x2 - a[i].x1) * (a[i].y2 - a[i].y1)"
    return f"""{name}_g AS (SELECT {by}, list({{'k': mask_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY {order}, mask_id) AS a FROM {source} GROUP BY {by}),
 {name}_f AS (SELECT {by}, a, 1 AS i, a[1:0] AS acc FROM {name}_g UNION ALL
   SELECT {by}, a, i + 1, CASE WHEN len(list_filter(acc, lambda q: coalesce(({inter}) / nullif({both} - {inter}, 0), 0) > {threshold})) > 0
     THEN acc ELSE list_append(acc, a[i]) END FROM {name}_f WHERE i <= len(a)),
 {name} AS (SELECT {by}, unnest(acc).k AS mask_id FROM {name}_f WHERE i = len(a) + 1)"""


CROPPED = "cr AS (SELECT *, mask_id % 3 AS crop, CASE WHEN mask_id % 3 = 0 THEN 4096 ELSE 900 * (mask_id % 3) END AS crop_area FROM bb)"


def _cropped(s, d):
    crop = F.col("mask_id") % 3
    return images.boxes(s, d).withColumn("crop", crop).withColumn("crop_area", F.when(crop == 0, 4096).otherwise(900 * crop))


@query(f"""WITH RECURSIVE {BX}, {CROPPED}, {_nms_sql("cr", "img, crop", "score DESC", "inner_kept")},
 left_over AS (SELECT cr.*, count(DISTINCT crop) OVER (PARTITION BY img) AS crops FROM cr JOIN inner_kept USING (img, crop, mask_id)),
 many AS (SELECT * FROM left_over WHERE crops > 1), {_nms_sql("many", "img", "1.0 / crop_area DESC", "kept")}
SELECT img, mask_id FROM kept UNION ALL SELECT img, mask_id FROM left_over WHERE crops = 1""")
def nms_across_crops(s, d):
    """Suppression within each crop by score, then across the crops of an image."""
    b = _cropped(s, d)
    within = b.join(boxes.nms(b, ["img", "crop"], 0.3), ["img", "crop", "mask_id"])
    return boxes.nms_across_crops(within, "img", "crop", "crop_area", 0.3)


@query(f"""WITH RECURSIVE {BX}, c AS (SELECT *, mask_id % 3 = 1 AS changed FROM bb), {_nms_sql("c", "img", "changed", "kept")} SELECT img, mask_id FROM kept""")
def nms_after_cleanup(s, d):
    return boxes.nms_after_cleanup(images.boxes(s, d).withColumn("changed", F.col("mask_id") % 3 == 1), "img", "changed", 0.3)


@query(f"""WITH RECURSIVE {AB}, st AS (SELECT 20 - i AS k, 50 * i + 49 AS t, p.ab, coalesce(q.ab, 1.0) AS pr FROM range(20) r(i) JOIN p ON p.t = 50 * i + 49 LEFT JOIN p q ON q.t = 50 * i - 1),
 l AS (SELECT vec_id AS img, 0 AS k, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings UNION ALL
  SELECT l.img, l.k + 1, list_transform(l.x, lambda v: sqrt(pr) * (sqrt(1 / ab) * v - sqrt(1 / ab - 1) * (v * st.t / 1000)) + sqrt(1 - pr) * (v * st.t / 1000)) FROM l JOIN st ON st.k = l.k + 1)
SELECT img, i // 8 AS y, i % 8 AS x, round(l.x[i + 1], 6) AS v FROM l, range(64) r(i) WHERE k = 20""")
def ddim_loop(s, d):
    """All steps of a deterministic sampler with a stub model that takes a share t / 1000 of x for noise."""
    steps = F.broadcast(schedule.ddim_steps(schedule.with_alphas(schedule.linear_betas(s, 1000)), 1000, 20))
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("img"), F.expr("cast(embedding as array<double>)").alias("x"))
    done = e.join(steps).select("img", F.transform("x", lambda v: schedule.ddim_sample(v, F.col("steps"), lambda x, t: x * t / 1000.0)).alias("x"))
    return done.select("img", F.posexplode("x").alias("p", "v")).select("img", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), F.round("v", 6).alias("v"))


SMALL = "b AS (SELECT i AS t, 0.01 + i * ((2.0 - 0.01) / 9) * 0.45 AS beta FROM range(10) r(i))"


@query(f"""WITH RECURSIVE {SMALL}, a AS (SELECT t, beta, product(1 - beta) OVER (ORDER BY t) AS ab FROM b), p AS (SELECT *, coalesce(lag(ab) OVER (ORDER BY t), 1.0) AS pr FROM a),
 l AS (SELECT vec_id AS img, 10 AS t, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings UNION ALL
  SELECT l.img, p.t, list_transform(l.x, lambda v: beta * sqrt(pr) / (1 - ab) * greatest(least(sqrt(1 / ab) * v - sqrt(1 / ab - 1) * (v * p.t / 10), 1), -1) + (1 - pr) * sqrt(1 - beta) / (1 - ab) * v
    + CASE WHEN p.t > 0 THEN sqrt(beta * (1 - pr) / (1 - ab)) * {UNIFORM.format(key="(l.img || '-' || p.t)", seed="ddpm")} ELSE 0 END) FROM l JOIN p ON p.t = l.t - 1)
SELECT img, i // 8 AS y, i % 8 AS x, round(l.x[i + 1], 6) AS v FROM l, range(64) r(i) WHERE t = 0""")
def ddpm_loop(s, d):
    """All steps of a clipped ancestral sampler over ten steps, with a stub model and a draw per image and step for noise."""
    betas = s.range(10).select(F.col("id").alias("t"), (0.01 + F.col("id") * ((2.0 - 0.01) / 9) * 0.45).alias("beta"))
    steps = F.broadcast(schedule.ddpm_steps(schedule.with_alphas(betas)))
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("img"), F.expr("cast(embedding as array<double>)").alias("x"))
    noise = lambda t: uniform(F.concat_ws("-", "img", t), "ddpm")
    done = e.join(steps).select("img", F.transform("x", lambda v: schedule.ddpm_sample(v, F.col("steps"), lambda x, t: x * t / 10.0, noise, clip=True)).alias("x"))
    return done.select("img", F.posexplode("x").alias("p", "v")).select("img", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), F.round("v", 6).alias("v"))


CUT = """cr(crop, cx1, cy1, cx2, cy2) AS (VALUES (0, 0, 0, 8, 8), (1, 0, 0, 6, 6), (2, 2, 0, 8, 6), (3, 0, 2, 6, 8), (4, 2, 2, 8, 8)),
px AS (SELECT vec_id * 5 + crop AS img, label, (i // 8 - cy1) * 8 + i % 8 - cx1 AS p, i // 8 - cy1 AS y, i % 8 - cx1 AS x, embedding[i + 1]::DOUBLE AS v
 FROM embeddings, cr, range(64) r(i) WHERE i % 8 >= cx1 AND i % 8 < cx2 AND i // 8 >= cy1 AND i // 8 < cy2)"""


@query(f"""WITH RECURSIVE {_regions(">").replace(PX, CUT, 1)},
 bs AS (SELECT img, k, count(*) AS area, min(p % 8) AS x, min(p // 8) AS y, max(p % 8) - min(p % 8) AS w, max(p // 8) - min(p // 8) AS h FROM l GROUP BY img, k),
 nb AS (SELECT img // 5 AS id, (img % 5)::INT AS crop, row_number() OVER (PARTITION BY img ORDER BY k) AS turn, * EXCLUDE (img, k) FROM bs),
 whole AS (SELECT id, crop, crop * 64 + turn AS mask_id, area, x + cx1 AS x1, y + cy1 AS y1, x + w + cx1 AS x2, y + h + cy1 AS y2, area / ((w + 1) * (h + 1))::DOUBLE AS score, (cx2 - cx1) * (cy2 - cy1) AS crop_area, cx1, cy1, cx2, cy2 FROM nb JOIN cr USING (crop)),
 fit AS (SELECT * FROM whole WHERE score >= 0.5 AND NOT ((abs(x1 - cx1) <= 1 AND abs(x1) > 1) OR (abs(y1 - cy1) <= 1 AND abs(y1) > 1) OR (abs(x2 - cx2) <= 1 AND abs(x2 - 8) > 1) OR (abs(y2 - cy2) <= 1 AND abs(y2 - 8) > 1))),
 {_nms_sql("fit", "id, crop", "score DESC", "inner_kept", 0.7)},
 left_over AS (SELECT fit.*, count(DISTINCT crop) OVER (PARTITION BY id) AS crops FROM fit JOIN inner_kept USING (id, crop, mask_id)),
 many AS (SELECT * FROM left_over WHERE crops > 1), {_nms_sql("many", "id", "1.0 / crop_area DESC", "kept", 0.7)},
 both_kept AS (SELECT id, mask_id FROM kept UNION ALL SELECT id, mask_id FROM left_over WHERE crops = 1)
SELECT id, crop, mask_id, area, x1, y1, x2, y2, round(score, 6) AS score FROM left_over JOIN both_kept USING (id, mask_id)""")
def mask_generation_chain(s, d):
    """Crops, segmentation, filters and both suppressions as one chain, with the stub segmenter."""
    out = chains.generate_masks(_rasters(s, d), 8, 8, 1, 0.5, threshold=0.0, least=0.5, edge=1.0)
    return out.withColumn("score", F.round("score", 6))


def _annotated(s, d):
    """(id, mask_id, json): the regions above 0 of each raster as annotation records."""
    from ..runtime import map_arrow

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                labels, n = raster.label_regions(np.array(v, float).reshape(8, 8) > 0)
                for k in range(1, n + 1):
                    flat = (labels == k).T.ravel()
                    at = np.flatnonzero(np.diff(flat, prepend=False, append=not flat[-1]))
                    text = codecs.pack_counts(np.diff(at, prepend=0).tolist())
                    out.append((i, k, json.dumps({"segmentation": {"size": [8, 8], "counts": text}})))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field(0).type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["id", "mask_id", "json"])

    rasters = _rasters(s, d)
    return map_arrow(rasters, run, f"id {rasters.schema['id'].dataType.simpleString()}, mask_id long, json string")


@query()
def object_extraction_chain(s, d):
    """Annotations decoded, tested, thinned out and cut out as one chain, on the regions of each raster."""
    return chains.extract_objects(_rasters(s, d), _annotated(s, d), 8, 8, side=12, margin=1, least=2, radius=2, near=0.2, occluder=1.0, background=0.0)
