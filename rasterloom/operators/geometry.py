"""Cameras, poses, point maps, triangles, sampling and stretch measures.

Conventions (own, stated): x right, y down, z forward; intrinsics in pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal


def intrinsics(height: Column, width: Column, fov: float = 55.0) -> Column:
    """3 x 3 matrix with focal length from the horizontal field of view."""
    f = 0.5 * width / math.tan(math.radians(fov / 2))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.array(f, zero, 0.5 * width), F.array(zero, f, 0.5 * height), F.array(zero, zero, one))


def unproject(px: DataFrame, depth: str, height: int, width: int, fov: float = 55.0) -> DataFrame:
    """Add px, py, pz: depth along the ray of each pixel, x and y flipped."""
    f = 0.5 * width / math.tan(math.radians(fov / 2))
    d = F.col(depth)
    return px.withColumn("px", -d * (F.col("x") - 0.5 * width) / f).withColumn("py", -d * (F.col("y") - 0.5 * height) / f).withColumn("pz", d)


def triangles(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(a, b, c): vertex numbers of the two triangles of every grid cell."""
    cell = spark.range((height - 1) * (width - 1)).withColumn("o", F.expr(f"id div {width - 1} * {width} + id % {width - 1}"))
    both = F.array(
        F.struct(F.col("o").alias("a"), (F.col("o") + width).alias("b"), (F.col("o") + 1).alias("c")),
        F.struct((F.col("o") + width + 1).alias("a"), (F.col("o") + 1).alias("b"), (F.col("o") + width).alias("c")),
    )
    return cell.select(F.explode(both).alias("t")).select("t.*")


def visible_triangles(tri: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles of which ``vertices(v)`` has all three corners."""
    for corner in ("a", "b", "c"):
        tri = tri.join(vertices.select(F.col("v").alias(corner)), corner, "left_semi")
    return tri


def pose(key: Column, seed: str, degrees: tuple[float, float, float] = (30.0, 10.0, 5.0), spread: float = 0.1) -> dict[str, Column]:
    """Random yaw, pitch, roll (degrees), turning centre and its depth factor, by the row's key."""
    yaw, pitch, roll = (normal(key, f"{seed}{n}") * d for n, d in zip(("yaw", "pitch", "roll"), degrees, strict=True))
    return {
        "yaw": yaw,
        "pitch": pitch,
        "roll": roll,
        "u": 0.5 + spread * normal(key, f"{seed}u"),
        "v": 0.5 + spread * normal(key, f"{seed}v"),
        "depth_factor": 1.0 + spread * normal(key, f"{seed}d"),
        "distance_factor": 1.0 + spread * normal(key, f"{seed}t"),
    }


def rotation(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Rows of Rz(roll) Rx(pitch) Ry(yaw), in degrees."""
    cy, sy, cx, sx, cz, sz = (f(F.radians(a)) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    return [
        [cz * cy - sz * sx * sy, -sz * cx, cz * sy + sz * sx * cy],
        [sz * cy + cz * sx * sy, cz * cx, sz * sy - cz * sx * cy],
        [-cx * sy, sx, cx * cy],
    ]


def turn_about(rows: list[list[Column]], centre: list[Column], factor: Column) -> list[Column]:
    """Translation that keeps the centre in view: c - R c times the factor."""
    return [centre[i] - sum(rows[i][j] * centre[j] for j in range(3)) * factor for i in range(3)]


def invert_rigid(r: str, t: str) -> list[Column]:
    """(rotation, translation) of the inverse of arrays ``r`` (3 x 3) and ``t`` (3)."""
    back = [[F.col(r)[j][i] for j in range(3)] for i in range(3)]
    move = [-sum(back[i][j] * F.col(t)[j] for j in range(3)) for i in range(3)]
    return [F.array(*[F.array(*row) for row in back]).alias(f"{r}_inv"), F.array(*move).alias(f"{t}_inv")]


def stretch(ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column]:
    """(length measure, signed area) of a mapping's derivatives."""
    s1 = ux * ux + uy * uy + vx * vx + vy * vy
    s2 = F.sqrt(F.pow(ux * ux + uy * uy - vx * vx - vy * vy, 2) + 4.0 * F.pow(ux * vx + uy * vy, 2))
    return F.sqrt(0.5 * F.abs(s1 - s2)), ux * vy - uy * vx


def warp_mask(seen: Column, length: Column, area: Column, smooth: Column, least: float = 0.5) -> Column:
    return seen & (length > least) & (area < 0) & smooth


def grid_sample(px: DataFrame, points: DataFrame, image: str, value: str, height: int, width: int) -> DataFrame:
    """Bilinear samples of ``px`` at ``points(image, id, u, v)`` in [0, 1]; zeros outside.

    Each point asks for four pixels by an equi-join; weights multiply what is found.
    """
    gx, gy = F.col("u") * width - 0.5, F.col("v") * height - 0.5
    base = points.select(image, "id", gx.alias("gx"), gy.alias("gy")).withColumn("x0", F.floor("gx")).withColumn("y0", F.floor("gy"))
    fx, fy = F.col("gx") - F.col("x0"), F.col("gy") - F.col("y0")
    tap = lambda dx, dy: F.struct((F.col("x0") + dx).cast("int").alias("x"), (F.col("y0") + dy).cast("int").alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w"))
    taps = base.select(image, "id", F.explode(F.array(*[tap(i, j) for j in (0, 1) for i in (0, 1)])).alias("t")).select(image, "id", "t.*")
    found = taps.join(px.select(image, "x", "y", F.col(value).alias("__s")), [image, "x", "y"], "left")
    return found.groupBy(image, "id").agg(F.sum(F.col("w") * F.coalesce("__s", F.lit(0.0))).alias("sample"))


def foreground_point(px: DataFrame, image: str, weight: Column, key: Column, seed: str, height: int, width: int) -> DataFrame:
    """One pixel per image drawn by weight (exponential race), as normalised u, v; null without weight."""
    from ..functions.rng import uniform

    race = -F.ln(1.0 - uniform(key, seed)) / F.when(weight > 0, weight)
    best = px.groupBy(image).agg(F.min_by(F.struct("x", "y"), race).alias("p"))
    return best.select(image, (F.col("p.x") / width).alias("u"), (F.col("p.y") / height).alias("v"))


def pixel_at(values: Column, u: Column, v: Column, height: int, width: int) -> Column:
    """The value of a row-major raster at the pixel that holds the point (u, v) in [0, 1)."""
    return F.get(values, (F.floor(v * height) * width + F.floor(u * width)).cast("int"))


def unproject_uv(u: Column, v: Column, depth: Column, height: int, width: int, fov: float = 55.0) -> list[Column]:
    """The point at a depth behind image coordinates (u, v): x right, y down, z forward."""
    across = 2 * math.tan(math.radians(fov / 2))
    return [(u - 0.5) * depth * across, (v - 0.5) * depth * across * height / width, depth]


def flow(px: DataFrame, image: str, value: str, u: Column, v: Column, height: int, width: int) -> DataFrame:
    """``flow``: the value sampled where each pixel (u, v) points to, less the pixel's own."""
    place = F.col("y") * width + F.col("x")
    points = px.select(image, place.alias("id"), u.alias("u"), v.alias("v"))
    got = grid_sample(px, points, image, value, height, width)
    own = px.select(image, "y", "x", place.alias("id"), value)
    return own.join(got, [image, "id"]).withColumn("flow", F.col("sample") - F.col(value))
