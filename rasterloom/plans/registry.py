"""Registered queries over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..operators import boxes, dataset, depth, geometry, mapping, masks, predict, raster, schedule
from ..sources import images, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The proxies as DuckDB views: 8 x 8 rasters and boxes.
PX = "px AS (SELECT vec_id AS img, label, i AS p, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
BX = """bx AS (SELECT l_orderkey AS img, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS mask_id,
  (l_partkey % 20)::DOUBLE AS x1, (l_suppkey % 20)::DOUBLE AS y1, (1 + l_quantity)::DOUBLE AS w, (5.0 * l_linenumber)::DOUBLE AS h, l_extendedprice AS score FROM lineitem),
bb AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM bx)"""
UNIFORM = "(('0x' || substr(md5({key}::VARCHAR || '|{seed}'), 1, 8))::UBIGINT / 4294967296.0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet")


def _rasters(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def signed6(v: Column) -> Column:
    """Rounded as SQL does it: what becomes zero keeps its sign, which ``F.round`` drops and a list shows."""
    return F.round(F.abs(v), 6) * F.signum(v)


# ---- datasets ----


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) SELECT o_orderkey, row_idx FROM o WHERE row_idx % 8 = 3")
def part_shard(s, d):
    return dataset.part(dataset.dense_index(_orders(s, d).select("o_orderkey"), "o_orderkey"), 8, 3)


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)
SELECT pos, a.row_idx, a.o_orderkey FROM (SELECT row_idx * 2 + i AS pos, row_idx * 7 % (SELECT count(*) FROM orders) AS idx FROM o, range(2) r(i)) q JOIN o a ON a.row_idx = q.idx""")
def subset_gather(s, d):
    """Two places for every order, out of the whole table."""
    index = dataset.dense_index(_orders(s, d).select("o_orderkey"), "o_orderkey")
    total = F.broadcast(_orders(s, d).agg(F.count(F.lit(1)).alias("total")))
    twice = index.join(total).select("row_idx", "total", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    wanted = twice.select((F.col("row_idx") * 2 + F.col("i")).alias("pos"), (F.col("row_idx") * 7 % F.col("total")).alias("idx"))
    return dataset.subset(index, wanted)


@query("SELECT o_orderkey, i AS view_idx FROM orders, range(4) r(i)")
def replicate(s, d):
    return dataset.replicate(_orders(s, d).select("o_orderkey"), 4)


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR || '|7') AS shuffle_key FROM orders")
def random_order(s, d):
    return dataset.random_order(_orders(s, d).select("o_orderkey"), "o_orderkey", 7)


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) SELECT o_orderkey, row_idx, row_idx // 64 AS batch, row_idx % 64 AS in_batch FROM o")
def sub_batch(s, d):
    return dataset.sub_batch(dataset.dense_index(_orders(s, d).select("o_orderkey"), "o_orderkey"), 64)


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') AS stem FROM pages")
def stem(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", images.stem(F.col("url")).alias("stem"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def first_rows(s, d):
    return _orders(s, d).select("o_orderkey").orderBy("o_orderkey").limit(50)


@query("SELECT o.o_orderkey, count(l.l_orderkey) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
def annotation_join(s, d):
    line = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = _orders(s, d).select("o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


# ---- boxes ----


@query(f"WITH {BX} SELECT img, mask_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM bb")
def box_xywh(s, d):
    return images.boxes(s, d).select("img", "mask_id", *boxes.xyxy_to_xywh("x1", "y1", "x2", "y2"))


@query(f"WITH {BX} SELECT img, mask_id, x1 + 5 AS x1, y1 + 9 AS y1, x2 + 5 AS x2, y2 + 9 AS y2 FROM bb")
def uncrop_boxes(s, d):
    return images.boxes(s, d).select("img", "mask_id", *boxes.uncrop(["x1", "y1", "x2", "y2"], F.lit(5.0), F.lit(9.0)))


@query(f"""WITH {BX} SELECT img, mask_id FROM bb WHERE NOT (
 (abs(x1 - 0) <= 4 AND abs(x1 - 0) > 4) OR (abs(y1 - 0) <= 4 AND abs(y1 - 0) > 4) OR (abs(x2 - 40) <= 4 AND abs(x2 - 80) > 4) OR (abs(y2 - 30) <= 4 AND abs(y2 - 60) > 4))""")
def edge_filter(s, d):
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    crop, whole = ([F.lit(float(v)) for v in b] for b in ((0, 0, 40, 30), (0, 0, 80, 60)))
    return images.boxes(s, d).where(~boxes.near_crop_edge(box, crop, whole, 4.0)).select("img", "mask_id")


@query(f"WITH {BX} SELECT img, mask_id FROM bb WHERE NOT (h > 32 * 0.8 AND w > 48 * 0.8)")
def background_filter(s, d):
    return images.boxes(s, d).where(~boxes.is_background(F.col("w"), F.col("h"), F.lit(48.0), F.lit(32.0))).select("img", "mask_id")


@query(f"WITH {BX} SELECT img, mask_id, score FROM bb WHERE score > 50000")
def iou_filter(s, d):
    return images.boxes(s, d).where("score > 50000").select("img", "mask_id", "score")


@query(f"""WITH {BX}, k AS (SELECT *, w * h AS area, max(w * h) OVER (PARTITION BY img) AS m FROM bb),
 c AS (SELECT img, mask_id, area, row_number() OVER (PARTITION BY img ORDER BY md5(img::VARCHAR || '-' || mask_id::VARCHAR)) AS t FROM k WHERE area >= 0.5 * m)
 SELECT img, mask_id, area FROM c WHERE t = 1""")
def large_object_pick(s, d):
    b = images.boxes(s, d).withColumn("area", F.col("w") * F.col("h")).select("img", "mask_id", "area")
    return boxes.large_object(b, "img", "area", F.md5(F.concat_ws("-", "img", "mask_id"))).select("img", "mask_id", "area")


@query("""WITH l AS (SELECT i, (2 ** (i + 1))::INT AS n FROM range(2) r(i)),
 o AS (SELECT i, n, trunc(0.3 * 300 * (2.0 / n))::INT AS ov FROM l),
 c AS (SELECT *, ceil((ov * (n - 1) + 400) / n::DOUBLE)::INT AS cw, ceil((ov * (n - 1) + 300) / n::DOUBLE)::INT AS ch FROM o)
SELECT 0 AS layer, 0 AS x1, 0 AS y1, 400 AS x2, 300 AS y2 UNION ALL
SELECT i + 1, (cw - ov) * kx, (ch - ov) * ky, least((cw - ov) * kx + cw, 400), least((ch - ov) * ky + ch, 300) FROM c, range(n) a(kx), range(n) b(ky)""")
def crop_boxes(s, d):
    return boxes.crop_boxes(s, 400, 300, 2, 0.3)


@query("SELECT i AS idx, (i % 32 + 0.5) / 32 AS x, (i // 32 + 0.5) / 32 AS y FROM range(1024) r(i)")
def point_grid(s, d):
    return boxes.point_grid(s, 32)


@query("""SELECT p_partkey, trunc(h * (1024.0::DOUBLE / greatest(h, w)) + 0.5)::INT AS new_h, trunc(w * (1024.0::DOUBLE / greatest(h, w)) + 0.5)::INT AS new_w
FROM (SELECT p_partkey, (p_size * 13 + 100)::DOUBLE AS h, (p_partkey % 700 + 50)::DOUBLE AS w FROM part)""")
def longest_side(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", *boxes.longest_side((F.col("p_size") * 13 + 100).cast("double"), (F.col("p_partkey") % 700 + 50).cast("double"), 1024))


@query("""SELECT p_partkey, (CASE WHEN round_even(v / 14, 0) * 14 < 518 THEN ceil(v / 14) * 14 ELSE round_even(v / 14, 0) * 14 END)::INT AS size
FROM (SELECT p_partkey, (500 + p_partkey % 200)::DOUBLE AS v FROM part)""")
def resize_multiple(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", boxes.to_multiple((500 + F.col("p_partkey") % 200).cast("double"), 14, 518).alias("size"))


@query(f"""WITH RECURSIVE {BX}, g AS (SELECT img, list({{'k': mask_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, mask_id) AS a FROM bb GROUP BY img),
 f AS (SELECT img, a, 1 AS i, a[1:0] AS acc FROM g UNION ALL
   SELECT img, a, i + 1, CASE WHEN len(list_filter(acc, lambda q: coalesce(
     (greatest(0, least(q.x2, a[i].x2) - greatest(q.x1, a[i].x1)) * greatest(0, least(q.y2, a[i].y2) - greatest(q.y1, a[i].y1))) /
     ((q.x2 - q.x1) * (q.y2 - q.y1) + (a[i].x2 - a[i].x1) * (a[i].y2 - a[i].y1) - greatest(0, least(q.x2, a[i].x2) - greatest(q.x1, a[i].x1)) * greatest(0, least(q.y2, a[i].y2) - greatest(q.y1, a[i].y1))), 0) > 0.5)) > 0
     THEN acc ELSE list_append(acc, a[i]) END FROM f WHERE i <= len(a))
 SELECT img, unnest(acc).k AS mask_id FROM f WHERE i = len(a) + 1""")
def nms_box(s, d):
    return boxes.nms(images.boxes(s, d), "img", 0.5)


# ---- masks ----


@query(f"""WITH {PX} SELECT img, coalesce(min(CASE WHEN v > 0 THEN x END), 0) AS x1, coalesce(min(CASE WHEN v > 0 THEN y END), 0) AS y1,
 coalesce(max(CASE WHEN v > 0 THEN x END), 0) AS x2, coalesce(max(CASE WHEN v > 0 THEN y END), 0) AS y2, count(*) FILTER (v > 0) AS area FROM px GROUP BY img""")
def mask_to_box(s, d):
    return masks.mask_boxes(images.pixels(s, d), "img", F.col("v") > 0)


@query(f"WITH {PX} SELECT img, y, x, v > 0 AS m FROM px")
def binarise(s, d):
    return images.pixels(s, d).select("img", "y", "x", (F.col("v") > 0).alias("m"))


@query(f"WITH {PX}, q AS (SELECT img, round((count(*) FILTER (v * 10 > 0.2))::DOUBLE / nullif(count(*) FILTER (v * 10 > -0.2), 0), 6) AS stability FROM px GROUP BY img) SELECT * FROM q WHERE stability >= 0.7")
def stability_filter(s, d):
    return masks.stability(images.pixels(s, d), "img", F.col("v") * 10, 0.0, 0.2).select("img", r6("stability")).where("stability >= 0.7")


RLE = f"""{PX}, o AS (SELECT img, x * 8 + y AS q, v > 0 AS f FROM px), c AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY img ORDER BY q) THEN 1 ELSE 0 END AS b FROM o),
 r AS (SELECT *, sum(b) OVER (PARTITION BY img ORDER BY q) AS run FROM c), n AS (SELECT img, run, count(*) AS n, any_value(f) AS f FROM r GROUP BY img, run),
 e AS (SELECT img, CASE WHEN (list(f ORDER BY run))[1] THEN list_prepend(0, list(n ORDER BY run)) ELSE list(n ORDER BY run) END AS counts FROM n GROUP BY img)"""


def _rle(s, d):
    return masks.rle_encode(images.pixels(s, d), "img", F.col("v") > 0, 8)


@query(f"WITH {RLE} SELECT img, counts FROM e")
def rle_encode(s, d):
    return _rle(s, d)


@query(f"WITH {PX} SELECT img, y, x FROM px WHERE v > 0")
def rle_decode(s, d):
    return masks.rle_decode(_rle(s, d), "img", 8)


@query(f"WITH {PX} SELECT img, count(*) FILTER (v > 0) AS area FROM px GROUP BY img")
def rle_area(s, d):
    return _rle(s, d).select("img", masks.rle_area(F.col("counts")).alias("area"))


@query(f"""WITH RECURSIVE {PX}, m AS (SELECT img // 4 AS g, img % 4 AS mask_id, list(p) AS pixels FROM px WHERE v > 0 GROUP BY img),
 s AS (SELECT g, list({{'k': mask_id, 'px': pixels}} ORDER BY len(pixels) DESC, mask_id) AS a FROM m GROUP BY g),
 f AS (SELECT g, a, 1 AS i, a[1:0] AS acc FROM s UNION ALL
  SELECT g, a, i + 1, CASE WHEN len(list_filter(acc, lambda q: len(list_intersect(q.px, a[i].px))::DOUBLE / len(a[i].px) > 0.6)) > 0 THEN acc ELSE list_append(acc, a[i]) END FROM f WHERE i <= len(a))
 SELECT g, unnest(acc).k AS mask_id FROM f WHERE i = len(a) + 1""")
def nms_contain(s, d):
    m = images.pixels(s, d).where("v > 0").groupBy("img").agg(F.collect_list("p").alias("pixels"))
    return masks.contained_nms(m.select(F.expr("img div 4").alias("g"), (F.col("img") % 4).alias("mask_id"), "pixels"), "g", 0.6)


NEAR9 = "FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x"


@query(f"WITH {PX} SELECT a.img, a.y, a.x, max((b.v > 0)::INT) AS m {NEAR9}")
def dilate(s, d):
    return masks.dilate(images.pixels(s, d).select("img", "y", "x", (F.col("v") > 0).cast("int").alias("m")), "img", "m", 1)


@query(f"WITH {PX} SELECT a.img, a.y, a.x, min((b.v > 0)::INT) AS m {NEAR9}")
def erode(s, d):
    return masks.erode(images.pixels(s, d).select("img", "y", "x", (F.col("v") > 0).cast("int").alias("m")), "img", "m", 1)


# ---- depth ----


def _depth(s, d):
    return images.pixels(s, d).select("img", "label", "y", "x", "v", (2 + F.col("v")).alias("d1"), (2 + F.col("v") * F.col("v")).alias("d2"))


@query(f"""WITH {PX}, r AS (SELECT img, avg(2 + v) FILTER (v > 0) / avg(2 + v * v) FILTER (v > 0) AS ratio FROM px GROUP BY img)
 SELECT img, y, x, round((2 + v * v) * ratio, 6) AS d2 FROM px JOIN r USING (img)""")
def depth_align(s, d):
    return depth.align(_depth(s, d), ["img"], "d1", "d2", F.col("v") > 0).select("img", "y", "x", r6("d2"))


@query(f"""WITH {PX}, r AS (SELECT label, avg(2 + v) FILTER (v > 0) / avg(2 + v * v) FILTER (v > 0) AS ratio FROM px GROUP BY label)
 SELECT img, y, x, round((2 + v * v) * ratio, 6) AS d2 FROM px JOIN r USING (label)""")
def depth_align_batch(s, d):
    return depth.align(_depth(s, d), ["label"], "d1", "d2", F.col("v") > 0).select("img", "y", "x", r6("d2"))


def _norm(by: str, sql: str):
    def f(s, d):
        return depth.normalise(_depth(s, d), ["img"], "d1", by).select("img", "y", "x", r6("d1"))

    f.__name__ = f"depth_norm_{by}"
    query(f"WITH {PX}, r AS (SELECT img, {sql} AS q FROM px GROUP BY img) SELECT img, y, x, round((2 + v) / q, 6) AS d1 FROM px JOIN r USING (img)")(f)


for _by, _sql in (("median", "quantile_disc(2 + v, 0.5)"), ("mean", "avg(2 + v)"), ("min", "min(2 + v)"), ("max", "max(2 + v)")):
    _norm(_by, _sql)


@query(f"WITH {PX}, r AS (SELECT img, min(v) AS lo, max(v) AS hi FROM px GROUP BY img) SELECT img, y, x, round((v - lo) / (hi - lo), 6) AS v FROM px JOIN r USING (img)")
def minmax(s, d):
    return depth.min_max(images.pixels(s, d), ["img"], "v").select("img", "y", "x", r6("v"))


@query(f"WITH {PX}, r AS (SELECT img, max(2 + v) AS hi FROM px GROUP BY img) SELECT img, y, x, round(((2 + v) / hi - 0.485) / 0.229, 6) AS v FROM px JOIN r USING (img)")
def max_scale(s, d):
    scaled = depth.normalise(_depth(s, d), ["img"], "d1", "max")
    return scaled.select("img", "y", "x", F.round(raster.standardise(F.col("d1"), 0), 6).alias("v"))


@query(f"WITH {PX} SELECT img, round(least(min(CASE WHEN v > 0.3 THEN 0.4 + v ELSE 1e10 END), 1.0), 6) AS near FROM px GROUP BY img")
def near_plane(s, d):
    px = images.pixels(s, d).withColumn("d1", 0.4 + F.col("v"))
    return depth.near_plane(px, ["img"], "d1", F.col("v") > 0.3).select("img", r6("near"))


@query(f"""WITH {PX}, r AS (SELECT img, least(min(CASE WHEN v > 0 THEN 0.7 + v ELSE 1e10 END), 1.0) AS near FROM px GROUP BY img)
 SELECT img, y, x, round(greatest(least((1 / near - 1 / (0.7 + v)) / (1 / near - 1 / 5.0), 1.0), 0.0), 6) AS z FROM px JOIN r USING (img)""")
def zbuffer(s, d):
    px = images.pixels(s, d).withColumn("d1", 0.7 + F.col("v"))
    near = depth.near_plane(px, ["img"], "d1", F.col("v") > 0)
    return px.join(near, "img").select("img", "y", "x", F.round(depth.z_buffer(F.col("d1"), F.col("near")), 6).alias("z"))


@query(f"""WITH {PX}, q AS (SELECT img, y, x, greatest(1 + 2 * v, 1e-6) AS g FROM px)
 SELECT a.img, a.y, a.x, count(b.g) AS flags, count(b.g) < 3 AS smooth FROM q a LEFT JOIN q b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  AND NOT (a.x = b.x AND a.y = b.y) AND abs(a.g - b.g) > 0.2 AND abs(1 / a.g - 1 / b.g) > 0.2 GROUP BY a.img, a.y, a.x""")
def discontinuity(s, d):
    px = images.pixels(s, d).withColumn("g", 1 + 2 * F.col("v"))
    return depth.discontinuity(px, "img", "g").select("img", "y", "x", "flags", "smooth")


METRICS = """round(avg((greatest(g / p, p / g) < 1.25)::INT), 6) AS a1, round(avg((greatest(g / p, p / g) < 1.25 ** 2)::INT), 6) AS a2, round(avg((greatest(g / p, p / g) < 1.25 ** 3)::INT), 6) AS a3,
 round(avg(abs(g - p) / g), 6) AS abs_rel, round(avg((g - p) ** 2 / g), 6) AS sq_rel, round(sqrt(avg((g - p) ** 2)), 6) AS rmse, round(sqrt(avg((ln(p) - ln(g)) ** 2)), 6) AS rmse_log,
 round(sqrt(greatest(avg((ln(p) - ln(g)) ** 2) - avg(ln(p) - ln(g)) ** 2, 0)) * 100, 6) AS silog, round(avg(abs(log10(g) - log10(p))), 6) AS log_10"""


def _rounded(df, key):
    return df.select(key, *[r6(c) for c in df.columns if c != key])


@query(f"WITH {PX}, q AS (SELECT label, 2 + v AS g, 2 + v * v AS p FROM px) SELECT label, {METRICS} FROM q GROUP BY label")
def depth_metrics(s, d):
    return _rounded(depth.metrics(_depth(s, d), ["label"], "d1", "d2"), "label")


@query(f"""WITH {PX}, q AS (SELECT label, y, x, 2 + v AS g, greatest(least(2 + v * 4, 2.4), 1.7) AS p FROM px)
 SELECT label, {METRICS} FROM q WHERE g > 1.7 AND g < 2.4 AND y >= 3 AND y < 7 AND x >= 0 AND x < 7 GROUP BY label""")
def depth_metrics_cropped(s, d):
    px = images.pixels(s, d).withColumn("g", 2 + F.col("v")).withColumn("p", depth.clamp_prediction(2 + F.col("v") * 4, 1.7, 2.4))
    px = px.where(depth.valid(F.col("g"), 1.7, 2.4) & depth.in_crop("garg", 8, 8))
    return _rounded(depth.metrics(px, ["label"], "g", "p"), "label")


@query(f"WITH {PX} SELECT img, y, x, round(1 / (2 + v), 6) AS disparity FROM px")
def disparity(s, d):
    return _depth(s, d).select("img", "y", "x", F.round(F.try_divide(F.lit(1.0), F.col("d1")), 6).alias("disparity"))


@query(f"WITH {PX} SELECT img, round(sum((2 + v) * (v > 0)::INT) / sum((v > 0)::INT), 6) AS mean_depth FROM px GROUP BY img")
def masked_mean(s, d):
    return _depth(s, d).groupBy("img").agg(F.round(F.avg(F.when(F.col("v") > 0, F.col("d1"))), 6).alias("mean_depth"))


@query(f"WITH {PX} SELECT label, round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.85), 6) AS hi FROM px GROUP BY label")
def colour_range(s, d):
    q = images.pixels(s, d).groupBy("label").agg(F.percentile("v", [0.02, 0.85]).alias("q"))
    return q.select("label", F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


# ---- rasters ----


@query(f"WITH {PX} SELECT img, ny AS y, nx AS x, v FROM px JOIN range(5) a(ny) ON y = floor((ny + 0.5) * 8 / 5) JOIN range(5) b(nx) ON x = floor((nx + 0.5) * 8 / 5)")
def resize_nearest(s, d):
    return raster.resize_nearest(images.pixels(s, d), "img", "v", 8, 5)


BIL = """w AS (SELECT n, lo AS o, 1 - f AS w FROM t UNION ALL SELECT n, least(lo + 1, 7), f FROM t WHERE f > 0 AND lo < 7)"""


@query(f"""WITH {PX}, t0 AS (SELECT n, greatest((n + 0.5) * 8.0 / 12 - 0.5, 0)::DOUBLE AS a FROM range(12) r(n)), t AS (SELECT n, least(floor(a), 7)::INT AS lo, a - least(floor(a), 7) AS f FROM t0),
 {BIL} SELECT img, wy.n AS y, wx.n AS x, round(sum(v * wy.w * wx.w), 6) AS v FROM px JOIN w wy ON px.y = wy.o JOIN w wx ON px.x = wx.o GROUP BY img, wy.n, wx.n""")
def resize_bilinear(s, d):
    return raster.resize_bilinear(images.pixels(s, d), "img", "v", 8, 12).select("img", "y", "x", r6("v"))


@query(f"""WITH {PX}, k AS (SELECT o, CASE WHEN o = 0 THEN 1.0 ELSE exp(-0.5 / 0.36) END / (1 + 2 * exp(-0.5 / 0.36)) AS w FROM (VALUES (-1), (0), (1)) t(o)),
 h AS (SELECT a.img, a.y, a.x, sum(b.v * k.w) AS v FROM px a, k JOIN px b ON b.img = a.img AND b.y = a.y AND b.x = least(greatest(a.x + k.o, 0), 7) GROUP BY a.img, a.y, a.x)
 SELECT a.img, a.y, a.x, round(sum(b.v * k.w), 6) + 0.0 AS v FROM h a, k JOIN h b ON b.img = a.img AND b.x = a.x AND b.y = least(greatest(a.y + k.o, 0), 7) GROUP BY a.img, a.y, a.x""")
def blur(s, d):
    return raster.blur(images.pixels(s, d), "img", "v").select("img", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query("SELECT vec_id AS img, i // 8 AS y, i % 8 AS x, round((embedding[i + 1]::DOUBLE + embedding[i // 8 * 8 + 8 - i % 8]::DOUBLE ** 2) / 2, 6) AS v FROM embeddings, range(64) r(i)")
def flip_average(s, d):
    px = images.pixels(s, d).withColumn("q", F.col("v") * F.col("v"))
    return raster.flip_average(px, "img", "v", "q", 8).select("img", "y", "x", r6("v"))


@query(f"WITH {PX} SELECT img, y // 3 AS wy, x // 3 AS wx, y % 3 AS iy, x % 3 AS ix FROM px")
def window_partition(s, d):
    return raster.partition_windows(images.pixels(s, d), 3).select("img", "wy", "wx", "iy", "ix")


@query("SELECT i, CASE WHEN ((i % 14) + 14) % 14 >= 8 THEN 14 - ((i % 14) + 14) % 14 ELSE ((i % 14) + 14) % 14 END AS source FROM range(-20, 30) r(i)")
def reflect_pad(s, d):
    return s.range(-20, 30).select(F.col("id").alias("i"), raster.reflect_index(F.col("id"), 8).alias("source"))


@query(f"WITH {PX} SELECT img, y, x, trunc(greatest(least((v + 0.5) * 255, 255), 0))::INT AS q FROM px")
def quantise(s, d):
    return images.pixels(s, d).select("img", "y", "x", raster.quantise(F.col("v") + 0.5).alias("q"))


@query(f"WITH {PX} SELECT img, y, x, CASE WHEN x BETWEEN 3 AND 5 AND y BETWEEN 1 AND 3 THEN 1.0 ELSE v END AS v FROM px")
def overlay_point(s, d):
    return raster.overlay_point(images.pixels(s, d), F.lit(0.5), F.lit(0.25), 8, 8, "v", 1.0).select("img", "y", "x", "v")


@query(f"WITH {PX} SELECT img, y, x, CASE WHEN x BETWEEN 1 AND 7 AND y BETWEEN 1 AND 6 AND NOT (x BETWEEN 3 AND 5 AND y BETWEEN 3 AND 4) THEN 1.0 ELSE v END AS v FROM px")
def overlay_bbox(s, d):
    return raster.overlay_box(images.pixels(s, d), [F.lit(i) for i in (1, 1, 7, 6)], "v", 1.0).select("img", "y", "x", "v")


@query(f"WITH {PX} SELECT img, y, x, round((v - 0.456) / 0.224, 6) AS a, round(v * 0.224 + 0.456, 6) AS b FROM px")
def channel_normalise(s, d):
    v = F.col("v")
    return images.pixels(s, d).select("img", "y", "x", F.round(raster.standardise(v, 1), 6).alias("a"), F.round(raster.destandardise(v, 1), 6).alias("b"))


@query(f"WITH {PX} SELECT img, y, x, CASE WHEN v > 0 THEN round(v, 6) ELSE 0 END AS v FROM px")
def mask_product(s, d):
    return images.pixels(s, d).select("img", "y", "x", F.when(F.col("v") > 0, F.round("v", 6)).otherwise(0.0).alias("v"))


def _regions(sign: str) -> str:
    return f"""{PX}, m AS (SELECT img, y, x, p FROM px WHERE v {sign} 0), e AS (SELECT a.img, a.p AS a, b.p AS b FROM m a JOIN m b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 r AS (SELECT img, p AS a, p AS b FROM m UNION SELECT r.img, r.a, e.b FROM r JOIN e ON e.img = r.img AND e.a = r.b), l AS (SELECT img, a AS p, min(b) AS k FROM r GROUP BY img, a),
 n AS (SELECT img, k, count(*) AS size FROM l GROUP BY img, k), t AS (SELECT img AS id, count(*) FILTER (v > 0) AS whole FROM px GROUP BY img)"""


@query(f"WITH RECURSIVE {_regions('>')} SELECT id, count(n.k) AS regions FROM t LEFT JOIN n ON n.img = t.id GROUP BY id")
def region_count(s, d):
    return predict.count_regions(_rasters(s, d), 8, 8)


@query(f"WITH RECURSIVE {_regions('<=')} SELECT id, count(n.k) > 0 AS changed, (any_value(whole) + coalesce(sum(size), 0))::BIGINT AS area FROM t LEFT JOIN n ON n.img = t.id AND size < 4 GROUP BY id")
def small_regions_holes(s, d):
    return predict.clean_regions(_rasters(s, d), 8, 8, 4, "holes")


@query(f"""WITH RECURSIVE {_regions('>')} SELECT id, count(*) FILTER (size < 4) > 0 AS changed,
 coalesce(CASE WHEN count(*) FILTER (size < 4) = 0 OR count(*) FILTER (size >= 4) = 0 AND count(n.k) = 0 THEN any_value(whole) ELSE coalesce(sum(size) FILTER (size >= 4), max(size)) END, 0)::BIGINT AS area
FROM t LEFT JOIN n ON n.img = t.id GROUP BY id""")
def small_regions_islands(s, d):
    return predict.clean_regions(_rasters(s, d), 8, 8, 4, "islands")


@query()
def contour_ratios(s, d):
    return predict.contour(_rasters(s, d), 8, 8, 2)


@query()
def object_masks(s, d):
    return predict.object_masks(_rasters(s, d), 8, 8, 2, 12, grow=8)


# ---- geometry ----


@query(f"""WITH {PX} SELECT img, y, x, round(-(2 + v) * (x - 4.0) / (4.0 / tan(radians(27.5))), 6) + 0.0 AS px, round(-(2 + v) * (y - 4.0) / (4.0 / tan(radians(27.5))), 6) + 0.0 AS py, round(2 + v, 6) AS pz FROM px""")
def depth_to_points(s, d):
    return geometry.unproject(_depth(s, d), "d1", 8, 8).select("img", "y", "x", *[(F.round(c, 6) + 0.0).alias(c) for c in ("px", "py", "pz")])


@query("SELECT p_partkey, round(0.5 * p_size / tan(radians(27.5)), 6) AS f, round(0.5 * p_size, 6) AS cx FROM part")
def intrinsics(s, d):
    k = geometry.intrinsics(F.col("p_size"), F.col("p_size"))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(k[0][0], 6).alias("f"), F.round(k[0][2].cast("double"), 6).alias("cx"))


@query("""WITH c AS (SELECT i // 7 * 8 + i % 7 AS o FROM range(49) r(i)) SELECT o AS a, o + 8 AS b, o + 1 AS c FROM c UNION ALL SELECT o + 9, o + 1, o + 8 FROM c""")
def triangles(s, d):
    return geometry.triangles(s, 8, 8)


@query("""SELECT event_id, round(sqrt(0.5 * abs((a*a + b*b + c*c + e*e) - sqrt((a*a + b*b - c*c - e*e) ** 2 + 4 * (a*c + b*e) ** 2))), 6) AS length, round(a * e - b * c, 6) AS area
FROM (SELECT event_id, value / 100 AS a, (event_id % 7) / 7.0::DOUBLE AS b, (event_id % 5) / 5.0::DOUBLE AS c, (user_id % 11) / 11.0::DOUBLE AS e FROM events)""")
def stretch(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    length, area = geometry.stretch(F.col("value") / 100, (F.col("event_id") % 7) / 7.0, (F.col("event_id") % 5) / 5.0, (F.col("user_id") % 11) / 11.0)
    return e.select("event_id", F.round(length, 6).alias("length"), F.round(area, 6).alias("area"))


@query("""WITH a AS (SELECT p_partkey, radians(p_size * 3.0) AS t, p_size::DOUBLE AS x, p_retailprice / 100 AS z FROM part)
SELECT p_partkey, round(-(cos(t) * x - sin(t) * z), 6) AS x_inv, round(-(sin(t) * x + cos(t) * z), 6) AS z_inv FROM a""")
def pose_inverse(s, d):
    rows = geometry.rotation(F.col("p_size") * 3.0, F.lit(0.0), F.lit(0.0))
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array(*[F.array(*r) for r in rows]).alias("r"), F.array(F.col("p_size").cast("double"), F.lit(0.0), F.col("p_retailprice") / 100).alias("t"))
    back = p.select("p_partkey", *geometry.invert_rigid("r", "t"))
    return back.select("p_partkey", F.round(F.col("t_inv")[0], 6).alias("x_inv"), F.round(F.col("t_inv")[2], 6).alias("z_inv"))


@query(f"""WITH {PX}, q AS (SELECT img, i AS id, ((img * 3 + i * 7) % 11) / 10.0::DOUBLE * 8 - 0.5 AS gx, ((img * 5 + i * 2) % 9) / 8.0::DOUBLE * 8 - 0.5 AS gy FROM (SELECT DISTINCT img FROM px), range(5) r(i)),
 t AS (SELECT img, id, floor(gx)::INT + a AS x, floor(gy)::INT + b AS y, (CASE WHEN a = 1 THEN gx - floor(gx) ELSE 1 - gx + floor(gx) END) * (CASE WHEN b = 1 THEN gy - floor(gy) ELSE 1 - gy + floor(gy) END) AS w FROM q, range(2) m(a), range(2) n(b))
 SELECT t.img, t.id, round(sum(w * coalesce(v, 0)), 6) AS sample FROM t LEFT JOIN px ON px.img = t.img AND px.x = t.x AND px.y = t.y GROUP BY t.img, t.id""")
def grid_sample(s, d):
    px = images.pixels(s, d)
    ask = px.select("img").distinct().withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    ask = ask.select("img", "id", (((F.col("img") * 3 + F.col("id") * 7) % 11) / 10.0).alias("u"), (((F.col("img") * 5 + F.col("id") * 2) % 9) / 8.0).alias("v"))
    return geometry.grid_sample(px, ask, "img", "v", 8, 8).select("img", "id", r6("sample"))


@query(f"""WITH {PX}, q AS (SELECT img, x, y, -ln(1 - {UNIFORM.format(key="(img || '-' || p)", seed="fg")}) / v AS r FROM px WHERE v > 0),
 b AS (SELECT img, arg_min({{'x': x, 'y': y}}, r) AS p FROM q GROUP BY img) SELECT img, p.x / 8.0::DOUBLE AS u, p.y / 8.0::DOUBLE AS v FROM b""")
def foreground_point(s, d):
    px = images.pixels(s, d)
    got = geometry.foreground_point(px, "img", F.greatest("v", F.lit(0.0)), F.concat_ws("-", "img", "p"), "fg", 8, 8)
    return got


@query(f"SELECT o_orderkey, round(20 + 50 * {UNIFORM.format(key='o_orderkey', seed='fov')}, 6) AS fov, 45.0::DOUBLE AS fixed FROM orders")
def rand_fov(s, d):
    return _orders(s, d).select("o_orderkey", F.round(20 + 50 * uniform(F.col("o_orderkey"), "fov"), 6).alias("fov"), F.lit(45.0).alias("fixed"))


@query(f"SELECT o_orderkey, round(30 * sqrt(-2 * ln(1 - {UNIFORM.format(key='o_orderkey', seed='yawa')})) * cos(2 * pi() * {UNIFORM.format(key='o_orderkey', seed='yawb')}), 6) AS yaw FROM orders")
def rand_normal_hash(s, d):
    return _orders(s, d).select("o_orderkey", F.round(30.0 * normal(F.col("o_orderkey"), "yaw"), 6).alias("yaw"))


@query(f"""WITH {PX}, q AS (SELECT img, y, x, v, greatest(1 + 2 * v, 1e-6) AS g FROM px),
 n AS (SELECT a.img, a.y, a.x, count(b.g) < 3 AS smooth FROM q a LEFT JOIN q b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  AND NOT (a.x = b.x AND a.y = b.y) AND abs(a.g - b.g) > 0.2 AND abs(1 / a.g - 1 / b.g) > 0.2 GROUP BY a.img, a.y, a.x)
 SELECT img, y, x, (v > 0) AND abs(v) * 2 > 0.5 AND (0.1 - v) < 0 AND smooth AS m FROM q JOIN n USING (img, y, x)""")
def warp_mask(s, d):
    v = F.col("v")
    px = depth.discontinuity(images.pixels(s, d).withColumn("g", 1 + 2 * v), "img", "g")
    return px.select("img", "y", "x", geometry.warp_mask(v > 0, F.abs(v) * 2, 0.1 - v, F.col("smooth")).alias("m"))


# ---- schedules ----

LIN = "b AS (SELECT i AS t, 1e-4 + i * ((0.02 - 1e-4) / 999) AS beta FROM range(1000) r(i))"
AB = f"{LIN}, a AS (SELECT t, beta, product(1 - beta) OVER (ORDER BY t) AS ab FROM b), p AS (SELECT *, coalesce(lag(ab) OVER (ORDER BY t), 1.0) AS pr FROM a)"


@query(f"WITH {LIN} SELECT t, round(beta, 9) AS beta FROM b")
def beta_linear(s, d):
    return schedule.linear_betas(s, 1000).select("t", F.round("beta", 9).alias("beta"))


@query("SELECT i AS t, round(least(1 - cos(((i + 1) / 1000.0::DOUBLE + 0.008) / 1.008 * pi() / 2) ** 2 / cos((i / 1000.0::DOUBLE + 0.008) / 1.008 * pi() / 2) ** 2, 0.999), 6) AS beta FROM range(1000) r(i)")
def beta_cosine(s, d):
    return schedule.cosine_betas(s, 1000).select("t", r6("beta"))


@query(f"WITH {AB} SELECT t, round(ab, 6) AS alpha_bar, round(pr, 6) AS alpha_bar_prev FROM p")
def alpha_cumprod(s, d):
    return schedule.with_alphas(schedule.linear_betas(s, 1000)).select("t", r6("alpha_bar"), r6("alpha_bar_prev"))


@query(f"""WITH {AB} SELECT t, round(beta * sqrt(pr) / (1 - ab), 6) AS coef_x0, round((1 - pr) * sqrt(1 - beta) / (1 - ab), 6) AS coef_xt, round(beta * (1 - pr) / (1 - ab), 6) AS variance,
 round(ln(CASE WHEN t = 0 THEN (SELECT beta * (1 - pr) / (1 - ab) FROM p WHERE t = 1) ELSE beta * (1 - pr) / (1 - ab) END), 6) AS log_variance FROM p""")
def ddpm_posterior(s, d):
    q = schedule.posterior(schedule.with_alphas(schedule.linear_betas(s, 1000)))
    return q.select("t", r6("coef_x0"), r6("coef_xt"), r6("variance"), r6("log_variance"))


@query("SELECT i, (50 - i) * 20 AS t, (49 - i) * 20 AS t_prev FROM range(50) r(i)")
def ddim_pairs(s, d):
    return schedule.ddim_pairs(s, 1000, 50)


STEP = "(SELECT ab FROM p WHERE t = 499) AS ab, (SELECT ab FROM p WHERE t = 479) AS pr"


def _at(s, *ts):
    table = schedule.with_alphas(schedule.linear_betas(s, 1000))
    return table.agg(*[F.max(F.when(F.col("t") == t, F.col("alpha_bar"))).alias(n) for t, n in ts])


@query(f"WITH {PX}, {AB}, c AS (SELECT {STEP}) SELECT img, y, x, round(sqrt(ab) * v + sqrt(1 - ab) * (v * v), 6) AS xt FROM px, c")
def forward_diffusion(s, d):
    a = F.broadcast(_at(s, (499, "ab")))
    return images.pixels(s, d).join(a).select("img", "y", "x", F.round(schedule.forward(F.col("v"), F.col("v") * F.col("v"), F.col("ab")), 6).alias("xt"))


@query(f"WITH {PX}, {AB}, c AS (SELECT {STEP}) SELECT img, y, x, round(sqrt(pr) * (sqrt(1 / ab) * v - sqrt(1 / ab - 1) * (v * v)) + sqrt(1 - pr) * (v * v), 6) AS xp FROM px, c")
def ddim_step(s, d):
    a = F.broadcast(_at(s, (499, "ab"), (479, "pr")))
    return images.pixels(s, d).join(a).select("img", "y", "x", F.round(schedule.ddim_step(F.col("v"), F.col("v") * F.col("v"), F.col("ab"), F.col("pr")), 6).alias("xp"))


@query(f"WITH {PX} SELECT img, y, x, round(4.0 * v - 3.0 * (v * v), 6) AS g FROM px")
def cfg_guidance(s, d):
    return images.pixels(s, d).select("img", "y", "x", F.round(schedule.guidance(F.col("v"), F.col("v") * F.col("v")), 6).alias("g"))


@query(f"WITH {PX} SELECT img, y, x, round(CASE WHEN v > 0 THEN v ELSE v * v END, 6) AS filled, round(CASE WHEN v > 0 THEN 0.7 * 1.0 + 0.3 * v ELSE v END, 6) AS kept FROM px")
def cond_inputs(s, d):
    v = F.col("v")
    kept = schedule.constrained(v, F.lit(1.0), v > 0, 0.7)
    return images.pixels(s, d).select("img", "y", "x", F.round(schedule.fill_hidden(v, v > 0, v * v), 6).alias("filled"), F.round(kept, 6).alias("kept"))


@query(f"WITH {PX} SELECT label, round(avg((v - v * v) ** 2), 6) AS mse FROM px GROUP BY label")
def mse_loss(s, d):
    return images.pixels(s, d).groupBy("label").agg(F.round(F.avg((F.col("v") - F.col("v") * F.col("v")) ** 2), 6).alias("mse"))


@query(f"""WITH {PX}, q AS (SELECT img, p, 1 + v AS w, sum(1 + v) OVER (PARTITION BY img) AS tot, sum(1 + v) OVER (PARTITION BY img ORDER BY p) AS upto FROM px)
 SELECT img, p AS k, round(0.1 + 9.9 * (2 * upto - w) / 2 / tot, 6) AS centre FROM q""")
def bins_from_widths(s, d):
    w = images.pixels(s, d).select("img", F.col("p").alias("k"), (1 + F.col("v")).alias("w"))
    return schedule.bin_centres(w, "img", 0.1, 10.0).select("img", "k", r6("centre"))


@query(f"WITH {PX}, q AS (SELECT img, p, exp(v) / sum(exp(v)) OVER (PARTITION BY img) AS pr FROM px) SELECT img, round(sum(pr * (0.1 + p * 0.1)), 6) AS depth FROM q GROUP BY img")
def expected_depth(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("img"), F.transform("embedding", lambda v: F.exp(v.cast("double"))).alias("e"))
    dot = F.aggregate(F.transform("e", lambda v, i: v * (0.1 + i * F.lit(0.1))), F.lit(0.0), lambda a, v: a + v)
    return e.select("img", F.round(dot / F.aggregate("e", F.lit(0.0), lambda a, v: a + v), 6).alias("depth"))


@query(f"WITH {PX}, q AS (SELECT label, p % 2 AS head, sum(v) AS s FROM px GROUP BY label, p % 2) SELECT label, arg_max(head, s) AS head FROM q GROUP BY label")
def domain_vote(s, d):
    votes = images.pixels(s, d).groupBy("label", (F.col("p") % 2).alias("head")).agg(F.sum("v").alias("s"))
    return votes.groupBy("label").agg(F.max_by("head", "s").alias("head"))


@query("SELECT i AS t, [round(cos(i * exp(-ln(10000.0) * k / 4)), 6) FOR k IN range(4)] || [round(sin(i * exp(-ln(10000.0) * k / 4)), 6) FOR k IN range(4)] AS e FROM range(100) r(i)")
def sinusoid(s, d):
    return s.range(100).select(F.col("id").alias("t"), F.transform(schedule.sinusoid(F.col("id"), 8), lambda v: F.round(v, 6)).alias("e"))


@query("""WITH q AS (SELECT i / 10.0::DOUBLE AS p, k, 15 * ln(15 + 1e-7) - k * ln(k + 1e-7) - (15 - k + 1e-7) * ln(15 - k + 2e-7) + k * ln(i / 10.0::DOUBLE) + (15 - k) * ln(1 - i / 10.0::DOUBLE) AS l
 FROM range(1, 10) a(i), range(16) b(k)), e AS (SELECT p, k, exp(l - max(l) OVER (PARTITION BY p)) AS x FROM q), n AS (SELECT p, k, round(x / sum(x) OVER (PARTITION BY p), 6) AS x FROM e)
SELECT p, list(x ORDER BY k) AS q FROM n GROUP BY p""")
def log_binomial(s, d):
    return s.range(1, 10).select((F.col("id") / 10).alias("p"), F.transform(schedule.log_binomial(F.col("id") / 10, 16), lambda v: F.round(v, 6)).alias("q"))


@query("""SELECT event_id, round(c + (exp(-300 * (0.2 - c) ** 2) * (0.2 - c) + exp(-300 * (0.6 - c) ** 2) * (0.6 - c)) / 2, 6) AS e,
 round(c + (0.2 - c) / (1 + 300 * (0.2 - c) ** 2) + (0.6 - c) / (1 + 300 * (0.6 - c) ** 2), 6) AS i FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS c FROM events)""")
def attractor(s, d):
    c, pts = (F.col("event_id") % 100) / 100.0, F.array(F.lit(0.2), F.lit(0.6))
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(schedule.attractor(c, pts), 6).alias("e"), F.round(schedule.attractor(c, pts, kind="inv", mean=False), 6).alias("i"))


# ---- dictionaries, logs, prompts ----


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS mean FROM events")
def running_mean(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(mapping.running_mean(e, ["user_id"], ["ts", "event_id"], "value"), 10).alias("mean"))


@query("""WITH g AS (SELECT user_id, list(value ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(l, lambda e, p: 0.9 * e + 0.1 * p), 6) AS ema FROM g""")
def ema(s, d):
    return mapping.ema(s.read.parquet(f"{d}/events.parquet"), "user_id", ["ts", "event_id"], "value", 0.9).select("user_id", r6("ema"))


@query("SELECT (event_id - 1) // 100 AS bucket, round(avg(value), 6) AS mean, count(value) AS n FROM events WHERE event_id >= 1 GROUP BY 1")
def log_means(s, d):
    return mapping.log_means(s.read.parquet(f"{d}/events.parquet").where("event_id >= 1"), "event_id", "value", 100).select("bucket", r6("mean"), "n")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def from_json_props(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {BX} SELECT img, count(*) AS n, sum(floor(w)::BIGINT) AS w FROM bb GROUP BY img")
def json_roundtrip(s, d):
    b = images.boxes(s, d).groupBy("img").agg(F.to_json(F.collect_list(F.struct("x1", "y1", "w", "h"))).alias("j"))
    a = b.select("img", F.from_json("j", "array<struct<x1:double,y1:double,w:double,h:double>>").alias("a"))
    return a.select("img", F.size("a").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s_, x: s_ + x["w"].cast("bigint")).alias("w"))


TEXTS = "['12', ' 3', '3.5', '-7', 'a', '1e3', '']"


@query(f"""SELECT p_partkey, t, CASE WHEN regexp_matches(t, '^\\s*[+-]?[0-9]+\\s*$') THEN 'int' WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind
FROM (SELECT p_partkey, ({TEXTS})[1 + p_partkey % 7] AS t FROM part)""")
def infer_type(s, d):
    texts = F.array(*[F.lit(t) for t in ("12", " 3", "3.5", "-7", "a", "1e3", "")])
    t = s.read.parquet(f"{d}/part.parquet").select("p_partkey", texts[(F.col("p_partkey") % 7).cast("int")].alias("t"))
    return t.select("p_partkey", "t", mapping.infer_type(F.col("t"))["kind"].alias("kind"))


@query("SELECT p_partkey, p_partkey::VARCHAR AS a, p_size::VARCHAR AS b, p_partkey || ';' || p_size AS both FROM part")
def split_args(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.create_map(F.lit("__a__b"), F.concat_ws(";", "p_partkey", "p_size")).alias("m"))
    p = p.select("p_partkey", mapping.split_args(F.col("m")).alias("m"))
    return p.select("p_partkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["__a__b"].alias("both"))


@query("SELECT p_partkey, 1 AS a, p_size AS b, 3 AS c FROM part")
def map_overlay(s, d):
    left, right = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.col("p_size"), F.lit("c"), F.lit(3))
    m = s.read.parquet(f"{d}/part.parquet").select("p_partkey", mapping.overlay(left, right).alias("m"))
    return m.select("p_partkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query("SELECT p_partkey, 1 AS a, p_size AS c FROM part")
def map_merge(s, d):
    m = s.read.parquet(f"{d}/part.parquet").select("p_partkey", mapping.strict_merge(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("c"), F.col("p_size"))).alias("m"))
    return m.select("p_partkey", F.col("m")["a"].alias("a"), F.col("m")["c"].alias("c"))


@query("SELECT p_brand AS key, round(avg(p_retailprice), 6) AS value FROM part GROUP BY p_brand")
def map_reduce(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.create_map("p_brand", "p_retailprice").alias("m"))
    return mapping.reduce_maps(p, "m", F.avg).select("key", r6("value"))


@query("SELECT p_partkey, p_size > 10 OR p_retailprice > 1000 AS any_big, p_size > 10 AND p_retailprice > 10 AS all_big FROM part")
def map_predicates(s, d):
    m = F.array(F.col("p_size") > 10, F.col("p_retailprice") > 1000), F.array(F.col("p_size") > 10, F.col("p_retailprice") > 10)
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.exists(m[0], lambda x: x).alias("any_big"), F.forall(m[1], lambda x: x).alias("all_big"))


@query("SELECT p_partkey, 'size' AS path, p_size::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part")
def map_flatten(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return sinks.archive(p, "p_partkey")


@query("""WITH g AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS rs, string_agg(CASE WHEN role = 'user' THEN '<用户>' ELSE '<AI>' END || text, '' ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id),
 k AS (SELECT *, len(list_filter(rs, lambda r: r NOT IN ('user', 'assistant'))) > 0 OR rs[1] <> 'user' AS rejected FROM g)
SELECT conv_id, CASE WHEN NOT rejected THEN body || '<AI>' END AS prompt, rejected FROM k""")
def chat_prompt(s, d):
    return mapping.chat_prompt(s.read.parquet(f"{d}/conversations.parquet"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'url' ELSE 'local' END AS scheme, url AS path FROM pages")
def resource_scheme(s, d):
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("url::"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("local::"), "url")).otherwise(F.col("url")).alias("r"))
    return p.select("page_id", mapping.resource(F.col("r")).alias("q")).select("page_id", "q.*")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ['a'] ELSE [] END || CASE WHEN event_id % 7 = 0 THEN ['b'] ELSE [] END AS bad FROM events")
def nan_audit(s, d):
    nan = F.lit(float("nan"))
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 5 == 0, nan).otherwise(1.0).alias("a"), F.when(F.col("event_id") % 7 == 0, nan).otherwise(1.0).alias("b"))
    return e.select("event_id", mapping.nan_columns(["a", "b"]).alias("bad"))


# ---- sinks and predictors ----


def _r6_values(df):
    return df.select("id", F.transform("values", signed6).alias("values"))


@query(f"WITH {PX} SELECT img, any_value(label) AS label, list(v ORDER BY p) AS v FROM px GROUP BY img")
def multi_view_sink(s, d):
    return sinks.multi_view(images.pixels(s, d).withColumnRenamed("p", "view_idx"), "img", ["label"], ["v"])


@query(f"WITH {PX} SELECT img, y, x, CASE WHEN v < 0 THEN 2 + v ELSE 0 END AS l, trunc((2 + v) * 256)::INT AS d16, p // 10 AS row, p % 10 AS col FROM px")
def sink_scalars(s, d):
    px = images.pixels(s, d)
    return px.select("img", "y", "x", sinks.stretch_scalar(2 + F.col("v"), F.col("v")).alias("l"), sinks.depth16(2 + F.col("v")).alias("d16"), *sinks.sheet_position(F.col("p"), 10))


@query()
def encode_png(s, d):
    return sinks.encode_rasters(_rasters(s, d), 8, 8)


@query(f"WITH {PX}, q AS (SELECT *, avg(v) OVER (PARTITION BY img) AS a, median(v) OVER (PARTITION BY img) AS h FROM px) SELECT img AS id, list(round(1 + abs(v - a), 6) ORDER BY p) AS values FROM q GROUP BY img")
def predict_depth(s, d):
    return _r6_values(predict.predict(_rasters(s, d), "depth", 8, 8))


@query(f"WITH {PX}, q AS (SELECT *, avg(v) OVER (PARTITION BY img) AS a, median(v) OVER (PARTITION BY img) AS h FROM px) SELECT img AS id, list(round(1 / (1 + abs(v - a)), 6) ORDER BY p) AS values FROM q GROUP BY img")
def predict_disparity(s, d):
    return _r6_values(predict.predict(_rasters(s, d), "disparity", 8, 8))


@query(f"""WITH {PX}, q AS (SELECT *, avg(v) OVER (PARTITION BY img) AS a, median(v) OVER (PARTITION BY img) AS h FROM px), d AS (SELECT img, p, abs(v - h) AS d FROM q), z AS (SELECT *, min(d) OVER w AS lo, max(d) OVER w AS hi FROM d WINDOW w AS (PARTITION BY img))
 SELECT img AS id, list(round((d - lo) / (hi - lo), 6) ORDER BY p) AS values FROM z GROUP BY img""")
def predict_saliency(s, d):
    return _r6_values(predict.predict(_rasters(s, d), "saliency", 8, 8))


@query(f"WITH {PX} SELECT img AS id, list(round(v, 6) ORDER BY p) AS values FROM px GROUP BY img")
def predict_inpaint(s, d):
    return _r6_values(predict.predict(_rasters(s, d), "inpaint", 8, 8))


@query(f"WITH {PX} SELECT img AS id, CASE WHEN avg(v) > 0 THEN 'a bright image' ELSE 'a dark image' END AS caption FROM px GROUP BY img")
def predict_caption(s, d):
    return predict.caption(_rasters(s, d))


@query(f"""WITH RECURSIVE {_regions('>')}, b AS (SELECT img, k, count(*) AS area, min(p % 8) AS x, min(p // 8) AS y, max(p % 8) - min(p % 8) AS w, max(p // 8) - min(p // 8) AS h FROM l GROUP BY img, k)
 SELECT img AS id, row_number() OVER (PARTITION BY img ORDER BY k) AS mask_id, area, x, y, w, h FROM b""")
def segment_masks(s, d):
    return predict.segment(_rasters(s, d), 8, 8, 0.0)


from . import crop_queries  # noqa: E402, F401  (adds its queries)
