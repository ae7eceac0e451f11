"""Whole chains against plain versions."""

import json

import numpy as np

from rasterloom.operators import predict
from rasterloom.plans import chains
from rasterloom.sources import codecs

SIZE = 24


def record(mask, size=None):
    flat = mask.T.ravel()
    counts, value = [0], False
    for v in flat:
        if bool(v) != value:
            counts.append(0)
            value = not value
        counts[-1] += 1
    return json.dumps({"segmentation": {"size": size or list(mask.shape), "counts": codecs.pack_counts(counts)}})


def square(x, y, n, hole=False):
    m = np.zeros((SIZE, SIZE), bool)
    m[y : y + n, x : x + n] = True
    if hole:
        m[y, x + 1 : x + n] = False
    return m


def test_decode_and_fit():
    m = square(3, 5, 4, hole=True)
    text = json.loads(record(m))["segmentation"]["counts"]
    assert (chains.decode(text, SIZE, SIZE) == m).all()
    a = np.arange(1, 9.0).reshape(2, 4)
    assert chains.fitted(a, 8).tolist() == [[0] * 8] * 2 + [v for r in a.tolist() for v in [[x for x in r for _ in (0, 1)]] * 2] + [[0] * 8] * 2
    assert (chains.fitted(a, 4)[1:3] == a).all()


def test_extract_objects(spark):
    rng = np.random.default_rng(5)
    images = [(i, rng.random(SIZE * SIZE).tolist()) for i in range(6)] + [(9, [0.0] * SIZE * SIZE)]
    marks, rows = {}, []
    for i in range(6):
        for k in range(5):
            m = square(int(rng.integers(0, 14)), int(rng.integers(0, 14)), int(rng.integers(2, 9)), hole=k == 3)
            marks[i, k] = m
            rows.append((i, k, record(m)))
    inner = square(5, 5, 4)
    marks[0, 7], marks[0, 8] = square(4, 4, 8), inner
    rows += [(0, 7, record(marks[0, 7])), (0, 8, record(inner)), (1, 20, None), (1, 21, "no json"), (1, 22, record(inner, [8, 8])), (77, 1, record(inner))]
    limits = dict(near=0.1, occluder=1.0, background=0.0)

    want = {}
    for i, values in images:
        a = np.array(values).reshape(SIZE, SIZE)
        d = predict.PREDICTORS["disparity"]()(a)
        fit = [(k, m) for (j, k), m in marks.items() if j == i and not predict.failed_test(m, d / d.max(), 2, 4, **limits)]
        stay = []
        for k, m in sorted(fit, key=lambda r: (-r[1].sum(), r[0])):
            if not any((m & q).sum() / m.sum() > 0.7 for _, q in stay):
                stay.append((k, m))
        for k, m in stay:
            y, x = np.nonzero(m)
            x1, y1, x2, y2 = max(0, x.min() - 2), max(0, y.min() - 2), min(SIZE, x.max() + 3), min(SIZE, y.max() + 3)
            want[i, k] = (int(m.sum()), (x1, y1, x2, y2), a[y1:y2, x1:x2], m[y1:y2, x1:x2])

    frame = spark.createDataFrame(images, "id long, values array<double>").repartition(3)
    records = spark.createDataFrame(rows, "id long, mask_id long, json string").repartition(3)
    got = chains.extract_objects(frame, records, SIZE, SIZE, side=16, margin=2, least=4, radius=2, **limits).collect()
    assert {(r["id"], r["mask_id"]) for r in got} == set(want) and len(got) == len(want) > 5
    assert (0, 8) not in want and (0, 7) in want
    for r in got:
        area, window, value, alpha = want[r["id"], r["mask_id"]]
        assert (r["area"], tuple(r["window"])) == (area, window)
        assert (np.array(r["value"]).reshape(16, 16) == chains.fitted(value, 16)).all()
        assert (np.array(r["alpha"]).reshape(16, 16) == chains.fitted(alpha, 16)).all()
    assert chains.extract_objects(frame, records.where("false"), SIZE, SIZE, side=16).count() == 0
