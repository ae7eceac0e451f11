"""Nodes over frames with one row per image (or view) and rasters as row-major arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import uniform
from ..operators import geometry, predict
from ..runtime import map_arrow
from .pipeline import PrefixNode


class Predict(PrefixNode):
    """A predictor's raster of ``{in}image`` as ``{out}name``; other columns pass through."""

    per_image = False

    def __init__(self, model: str, name: str, side: int, in_prefix: str = "", out: str | None = None):
        super().__init__(in_prefix, out)
        self.model, self.name, self.side = model, name, side

    def apply(self, df: DataFrame) -> DataFrame:
        at, side, loader, model = df.columns.index(f"{self.ins[0]}image"), self.side, predict.PREDICTORS[self.model], self.model
        name = f"{self.out}{self.name}"

        def run(batches):
            f = predict.shared(model, loader)
            for b in batches:
                out = [np.asarray(f(np.array(v, float).reshape(side, side)), float).ravel() for v in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, name])

        return map_arrow(df, run, T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.DoubleType()))]))


class Replicate(PrefixNode):
    """Every image ``times`` times, numbered by ``view_idx``; ``key`` names the view."""

    replicates = True

    def __init__(self, times: int):
        super().__init__()
        self.times = times

    def apply(self, df: DataFrame) -> DataFrame:
        views = df.withColumn("view_idx", F.explode(F.sequence(F.lit(0), F.lit(self.times - 1))))
        return views.withColumn("key", F.concat_ws("-", "id", "view_idx"))


class ForegroundPoint(PrefixNode):
    """``point_u`` and ``point_v`` of a pixel drawn by the weights in ``{in}saliency``, null without weight."""

    def __init__(self, side: int, in_prefix: str = ""):
        super().__init__(in_prefix)
        self.side = side

    def apply(self, df: DataFrame) -> DataFrame:
        race = F.transform(
            f"{self.ins[0]}saliency",
            lambda w, i: F.struct((-F.ln(1.0 - uniform(F.concat_ws("-", "key", i), "point")) / F.when(w > 0, w)).alias("r"), i.alias("p")),
        )
        first = F.array_min(F.filter(race, lambda x: x["r"].isNotNull()))["p"]
        df = df.withColumn("__p", first)
        return df.withColumn("point_u", F.col("__p") % self.side / self.side).withColumn("point_v", F.floor(F.col("__p") / self.side) / self.side).drop("__p")


class Resize(PrefixNode):
    """Nearest-exact rasters of another side for the named columns."""

    def __init__(self, names: list[str], old: int, new: int):
        super().__init__()
        self.names, self.places = names, [int((y + 0.5) * old / new) * old + int((x + 0.5) * old / new) for y in range(new) for x in range(new)]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.array(*[F.get(n, F.lit(p)) for p in self.places]) for n in self.names})


class FovRandom(PrefixNode):
    """A field of view between ``least`` and ``most`` degrees for every view."""

    def __init__(self, least: float = 20.0, most: float = 70.0):
        super().__init__()
        self.least, self.most = least, most

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("fov", self.least + (self.most - self.least) * uniform(F.col("key"), "fov"))


class RandomPose(PrefixNode):
    """``rotation`` and ``translation`` of a random turn about a centre at the depth of the view's point (1 without)."""

    def __init__(self, side: int, in_prefix: str = ""):
        super().__init__(in_prefix)
        self.side = side

    def apply(self, df: DataFrame) -> DataFrame:
        p = geometry.pose(F.col("key"), "pose")
        depth = geometry.pixel_at(F.col(f"{self.ins[0]}depth"), F.col("point_u"), F.col("point_v"), self.side, self.side)
        centre = geometry.unproject_uv(p["u"], p["v"], F.coalesce(depth, F.lit(1.0)) * p["depth_factor"], self.side, self.side)
        rows = geometry.rotation(p["yaw"], p["pitch"], p["roll"])
        move = geometry.turn_about(rows, centre, p["distance_factor"])
        return df.withColumn("rotation", F.array(*[F.array(*r) for r in rows])).withColumn("translation", F.array(*move))


class AlignDepth(PrefixNode):
    """``{in}depth`` scaled to the mean of ``depth`` where ``saliency`` exceeds the threshold; unchanged if nothing does."""

    def __init__(self, in_prefix: str, threshold: float = 0.0):
        super().__init__(in_prefix, in_prefix)
        self.threshold = threshold

    def apply(self, df: DataFrame) -> DataFrame:
        name = f"{self.ins[0]}depth"
        seen = F.filter(F.arrays_zip(F.col("depth").alias("a"), F.col(name).alias("b"), F.col("saliency").alias("s")), lambda x: x["s"] > self.threshold)
        total = lambda c: F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + x[c])
        df = df.withColumn("__ratio", F.coalesce(F.try_divide(total("a"), total("b")), F.lit(1.0)))
        return df.withColumn(name, F.transform(name, lambda v: v * F.col("__ratio"))).drop("__ratio")
