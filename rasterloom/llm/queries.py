"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, jaccard, lines, packing, pii, sharding, substring, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024, end_id=2)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"), width=35).drop("factors")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pii.personal_data(table(spark, sf_dir, "documents")))


def digested(found: DataFrame) -> DataFrame:
    """The columns of op4 from ``found(doc_id, spans)``."""
    base = pii.KINDS[: pii.BASE]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(text(of(*base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs.select("doc_id", "text"), model, threshold=0.3)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), minimum=0).drop("record_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"), run=3)


def op9_line_dedup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"), run=1)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {
    f.__name__: f
    for f in (op1_pack, op2_jaccard_join, op3_substring_dedup, op4_pii, op5_toxicity, op6_shard, op7_decontaminate, op8_warc, op9_line_dedup, op9_line_dedup_single, op10_exact_dedup)
}

_BASE32 = """(
  SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i)
  FROM range(32) r(i))"""

SQL = {
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
     r AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, hex,
             max(page_id) OVER (PARTITION BY hex) AS top,
             row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS turn FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN turn > 1 THEN top END AS refers_to
FROM r""",
    "op9_line_dedup": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     e AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l),
     s AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS x FROM e WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
     w AS (SELECT doc_id, i, x, lead(i, 1) OVER v AS i1, lead(i, 2) OVER v AS i2, lead(x, 1) OVER v AS x1, lead(x, 2) OVER v AS x2
           FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
     d AS (SELECT doc_id, i, i1, i2, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, i) AS turn FROM w WHERE i2 IS NOT NULL),
     m AS (SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM d WHERE turn > 1),
     k AS (SELECT e.doc_id, count(*) AS n_lines, count(m.i) AS n_removed,
             coalesce(string_agg(CASE WHEN m.i IS NULL THEN e.line END, chr(10) ORDER BY e.i), '') AS kept
           FROM e LEFT JOIN m ON e.doc_id = m.doc_id AND e.i = m.i GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k""",
    "op9_line_dedup_single": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     e AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l),
     s AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS x FROM e WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
     d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS turn FROM s),
     m AS (SELECT doc_id, i FROM d WHERE turn > 1),
     k AS (SELECT e.doc_id, count(*) AS n_lines, count(m.i) AS n_removed,
             coalesce(string_agg(CASE WHEN m.i IS NULL THEN e.line END, chr(10) ORDER BY e.i), '') AS kept
           FROM e LEFT JOIN m ON e.doc_id = m.doc_id AND e.i = m.i GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
