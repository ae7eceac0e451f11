"""Training-data operators: packing, similarity joins, deduplication, PII, toxicity,
sharding, decontamination and archives.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps extra input columns out of its way by working on aliased columns, and
parks intermediate tables only in the shared folder of ``spark.checkpoint.dir``.
On a cluster the package must be importable by the Python workers (``--py-files``).
"""
