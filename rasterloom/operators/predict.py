"""Model inference as batched iterators: one lazily loaded model per Python worker.

Weights and deep-learning libraries are not part of this package.  The registered
predictors are stubs, deterministic functions of the pixels that exercise the interface;
they say nothing about model quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import map_arrow
from .raster import label_regions

_LOADED: dict[tuple, object] = {}
_ORIGINS: dict[str, tuple[str, str]] = {}


def shared(name: str, loader: Callable, *args):
    """The component made by ``loader(*args)``, once per worker; one name with two loaders is an error."""
    origin = (loader.__module__, loader.__qualname__)
    if _ORIGINS.setdefault(name, origin) != origin:
        raise ValueError(f"{name} already comes from {_ORIGINS[name]}")
    if (name, args) not in _LOADED:
        _LOADED[name, args] = loader(*args)
    return _LOADED[name, args]


def _stub_depth():
    return lambda a: 1.0 + np.abs(a - a.mean())


def _stub_disparity():
    return lambda a: 1.0 / (1.0 + np.abs(a - a.mean()))


def _stub_saliency():
    def run(a):
        d = np.abs(a - np.median(a))
        return (d - d.min()) / (np.ptp(d) or 1.0)

    return run


def _stub_inpaint():
    return lambda a: np.where(np.isfinite(a), a, np.nanmean(a))


def _stub_super_resolution():
    return lambda a: np.kron(a, np.ones((2, 2)))


PREDICTORS: dict[str, Callable] = {
    "depth": _stub_depth,
    "disparity": _stub_disparity,
    "saliency": _stub_saliency,
    "inpaint": _stub_inpaint,
    "super_resolution": _stub_super_resolution,
}


def predict(rows: DataFrame, model: str, height: int, width: int, batch_size: int = 8) -> DataFrame:
    """``rows(id, values array<double>)`` -> id and the model's raster, ``batch_size`` images at a time."""
    loader = PREDICTORS[model]

    def run(batches: Iterable[pa.RecordBatch]):
        f = shared(model, loader)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                out = [np.asarray(f(np.array(v, float).reshape(height, width)), float).ravel() for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "values"])

    return map_arrow(rows, run, f"id {rows.schema[0].dataType.simpleString()}, values array<double>")


def segment(rows: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    """One row to many masks: (id, mask_id, area, x, y, w, h) of the 8-connected regions above the threshold."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                labels, n = label_regions(np.array(v, float).reshape(height, width) > threshold)
                for k in range(1, n + 1):
                    y, x = np.nonzero(labels == k)
                    for column, value in zip(out, (i, k, len(y), x.min(), y.min(), np.ptp(x), np.ptp(y)), strict=True):
                        column.append(int(value))
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type if j == 0 else pa.int64()) for j, c in enumerate(out)], ["id", "mask_id", "area", "x", "y", "w", "h"])

    return map_arrow(rows, run, f"id {rows.schema[0].dataType.simpleString()}, mask_id long, area long, x long, y long, w long, h long")


def caption(rows: DataFrame, batch_size: int = 32) -> DataFrame:
    """(id, caption): a stub that names the raster's brightness."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                said = ["a bright image" if np.mean(v) > 0 else "a dark image" for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said)], ["id", "caption"])

    return map_arrow(rows, run, f"id {rows.schema[0].dataType.simpleString()}, caption string")


def _region_rows(rows: DataFrame, height: int, width: int, fields: str, f) -> DataFrame:
    """Apply ``f(mask) -> values`` to ``rows(id, values array<double>)`` taken as masks (above 0)."""
    names = [x.split()[0] for x in fields.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[x.split(" ", 1)[1]] for x in fields.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            got = [f(np.array(v, float).reshape(height, width)) for v in batch.column(1).to_pylist()]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    return map_arrow(rows, run, f"id {rows.schema[0].dataType.simpleString()}, {fields}")


def count_regions(rows: DataFrame, height: int, width: int) -> DataFrame:
    return _region_rows(rows, height, width, "regions long", lambda a: (label_regions(a > 0)[1],))


def clean_regions(rows: DataFrame, height: int, width: int, area: int, mode: str) -> DataFrame:
    from .raster import remove_small_regions

    def f(a):
        mask, changed = remove_small_regions(a > 0, area, mode)
        return changed, int(mask.sum())

    return _region_rows(rows, height, width, "changed boolean, area long", f)


def contour(rows: DataFrame, height: int, width: int, radius: int) -> DataFrame:
    """Occluder and background shares of the band around each raster's mask (above 0), its own values as disparity."""
    from .raster import contour_ratios

    def f(a):
        d = a - a.min()
        occluder, background = contour_ratios(a > 0, d / (d.max() or 1.0), radius)
        return occluder, background

    return _region_rows(rows, height, width, "occluder double, background double", f)


def kernel_rows(rows: DataFrame, height: int, width: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``rows(id, values array<double>)`` with each raster replaced by ``f`` of it; pixels of an image stay in one row."""
    return _region_rows(rows, height, width, "values array<double>", lambda a: (np.asarray(f(a), float).ravel(),))


#: Tests of an object mask, in the order in which they are tried.
OBJECT_TESTS = ("size", "border", "pieces", "distance", "surroundings")


def failed_test(mask: np.ndarray, disparity: np.ndarray, radius: int, least: int, near: float = 0.5, edge: float = 0.05, occluder: float = 0.01, background: float = 0.75) -> str | None:
    """The first of OBJECT_TESTS that an object mask fails on a disparity scaled to a largest value of 1; None if it stays.

    Size: a side of ``least`` pixels.  Border: a 32nd of the image free on each side.
    Pieces: one 8-connected region.  Distance: mean disparity of ``near``.  Surroundings:
    few places with something in front, most with only background behind; a mask without
    contour passes.
    """
    from .raster import contour_ratios

    ys, xs = np.nonzero(mask)
    if not len(ys):
        return "size"
    (h, w), x, y = mask.shape, int(xs.min()), int(ys.min())
    across, down = int(xs.max()) - x + 1, int(ys.max()) - y + 1
    if max(across, down) < least:
        return "size"
    if x < w // 32 or y < h // 32 or x + across > w * 31 // 32 or y + down > h * 31 // 32:
        return "border"
    reach = radius + 16
    window = slice(max(0, y - reach), min(h, y + down + reach)), slice(max(0, x - reach), min(w, x + across + reach))
    mask, disparity = mask[window], disparity[window]
    if label_regions(mask)[1] > 1:
        return "pieces"
    if disparity[mask].mean() < near:
        return "distance"
    front, behind = contour_ratios(mask, disparity, radius, edge)
    return "surroundings" if front > occluder or behind < background else None


def object_masks(rows: DataFrame, height: int, width: int, radius: int, least: int, grow: int = 1) -> DataFrame:
    """id, failed (null: kept) of ``rows(id, values array<double>)``: the mask above 0 on the raster's own values as disparity.
    Each pixel stands for ``grow`` by ``grow`` pixels."""

    def f(a):
        d = np.kron(a - a.min(), np.ones((grow, grow)))
        return (failed_test(np.kron(a > 0, np.ones((grow, grow))) > 0, d / (d.max() or 1.0), radius, least),)

    return _region_rows(rows, height, width, "failed string", f)
