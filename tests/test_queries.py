"""Some registered queries against their SQL on the smallest tables, where those exist."""

import os

import duckdb
import pytest

from rasterloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", ["part_shard", "nms_box", "rle_encode", "mask_to_box", "discontinuity", "depth_metrics", "ddpm_posterior", "grid_sample", "chat_prompt", "ema", "foreground_point", "nms_across_crops", "nms_after_cleanup", "ddim_loop", "ddpm_loop", "mask_generation_chain"])
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    rel = con.sql(registry.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    left = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    right = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=str)
    assert left == right


@pytest.mark.parametrize("name", ["multi_view_chain", "pad_square", "predict_inpaint"])
def test_sign_of_zero(spark, tmp_path, name):
    """Lists of rounded values agree with SQL bit by bit; one image has a small negative pixel, one a small negative tz."""
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT i AS vec_id, [(CASE WHEN i = 1 AND p = 5 THEN -3e-7 ELSE (p * 37 % 64 - 31.5) / 64 END)::FLOAT FOR p IN range(64)] AS embedding, 0 AS label FROM (VALUES (1::BIGINT), (92726)) t(i)")
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    rel = con.sql(registry.SQL[name])
    right = sorted(repr(list(r)) for r in rel.fetchall())
    assert any("-0.0," in r for r in right)
    assert sorted(repr(list(r)) for r in df.select(*rel.columns).collect()) == right
