"""Corpus preparation: five stages over ``documents``, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontam, exact, jaccard, packing, store, toxicity
from rasterloom.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Every row is judged by its own text; null and empty texts score as texts without any
    gain and stay.  Repeated rows share their fate; no rows give no rows; other columns
    pass through, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model, threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest doc_id.

    Null counts as the empty text.  A null doc_id stays only in a group without another; of
    rows repeated with doc_id and text one stays, any of them if other columns differ.
    """
    kept = exact.exact_dedup(docs, keep="smallest").where("kept").select("doc_id", "text_sha256")
    return _rows_of(docs, kept, F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8: the smallest doc_id.

    Rows count as documents by doc_id and text together, so rows that share a doc_id, or
    have none, are judged by their own texts.  Texts without words (null, empty, blank) all
    stay; of rows repeated with doc_id and text one stays.
    """
    mark = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    key = F.struct(docs["doc_id"].isNull().alias("last"), docs["doc_id"].alias("doc_id"), mark.alias("mark"))
    joined = jaccard.jaccard_join(docs.select(key.alias("doc_id"), "text"), n=5, percent=80)
    kept = joined.where("doc_id <=> component_id").select("doc_id.doc_id", "doc_id.mark").distinct()
    return _rows_of(docs, kept, mark)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; every row is judged by its own text, null and empty texts stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024; a null text counts as empty, repeated rows all return."""
    return packing.pack(docs, tokenizer_path(), limit=1024, end_id=2)


def _rows_of(docs: DataFrame, kept: DataFrame, mark: Column) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, ``mark``) is in ``kept`` (null matches null), each pair of doc_id and text once."""
    names = {c.lower() for c in docs.columns}
    free = next(x for x in ("kept" + "_" * k for k in range(len(names) + 1)) if not any(c.startswith(x) for c in names))
    kept = store.written(kept.toDF(f"{free}id", f"{free}mark"), "kept")
    met = docs["doc_id"].eqNullSafe(F.col(f"{free}id")) & (mark == F.col(f"{free}mark"))
    rows = docs.join(kept, met, "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; every stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the shingle components and the token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None
