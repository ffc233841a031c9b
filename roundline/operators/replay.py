"""Incremental replay: only recordings whose readings changed are computed again.

A folder holds results by run and a manifest, which says of each recording the digest of its
readings and the run that its results are from.  Every run writes the results of changed
recordings, then a whole new manifest; Spark's commit marks it as done, and the newest marked
one counts.  A run that fails leaves the one before in force, and may be started again.

The digest does not depend on the order of rows; repeated rows count.  Recordings that are
gone leave the manifest, and with it the results.  Null is a recording of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stem string, digest string, run long"


def digests(reads: DataFrame, by: str = "stem") -> DataFrame:
    """(by, digest): a fingerprint of each recording's rows, from sums that add up in any order."""
    values = [F.col(c) for c in sorted(reads.columns) if c != by]
    # nulls leave a hash as it is, so each column says whether it is null
    known = F.concat_ws("", *(F.when(c.isNull(), "0").otherwise("1") for c in values))
    hashes = [F.xxhash64(F.lit(seed), known, *values) for seed in (1, 2)]
    parts = [F.count("*"), *(F.bit_xor(h) for h in hashes), *(F.sum(F.pmod(h, F.lit(1 << 31))) for h in hashes)]
    return reads.groupBy(by).agg(F.concat_ws("-", *(p.cast("string") for p in parts)).alias("digest"))


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that were written whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{folder}/manifest")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(stem, digest, run) of the newest finished run; None before the first."""
    done = _finished(spark, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{done[-1]:09d}") if done else None


def replayed(reads: DataFrame, compute: Callable[[DataFrame], DataFrame], folder: str, again: bool = False) -> DataFrame:
    """Brings ``folder`` up to ``reads`` (stem, ...) and gives the results of all recordings:
    ``compute`` of each one's rows, with ``run``, the run that made them.  ``again`` computes
    all anew.  The result's columns of ``compute`` begin with ``stem``."""
    spark = reads.sparkSession
    before, done = manifest(spark, folder), _finished(spark, folder)
    run = done[-1] + 1 if done else 1
    now = digests(reads)
    own = f"{folder}/digests/{run:09d}"
    now.write.mode("overwrite").parquet(own)
    now = spark.read.schema("stem string, digest string").parquet(own)
    if before is None or again:
        state = now.withColumn("run", F.lit(run).cast("long"))
    else:
        old = before.select(F.col("stem").alias("__stem"), F.col("digest").alias("__digest"), F.col("run").alias("__run"))
        same = F.col("stem").eqNullSafe(F.col("__stem")) & (F.col("digest") == F.col("__digest"))
        state = now.join(old, same, "left").select("stem", "digest", F.coalesce("__run", F.lit(run).cast("long")).alias("run"))
    changed = state.where(F.col("run") == run).select(F.col("stem").alias("__stem"))
    some = reads.join(changed, F.col("stem").eqNullSafe(F.col("__stem")), "left_semi")
    made = compute(some)
    schema = made.schema
    made.write.mode("overwrite").parquet(f"{folder}/results/run={run}")
    state.write.mode("overwrite").parquet(f"{folder}/manifest/{run:09d}")
    return results(spark, folder, schema)


def results(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Results of the newest finished manifest; ``schema`` is that of one run's results."""
    current = manifest(spark, folder)
    if current is None:
        raise FileNotFoundError(f"{folder} has no finished run")
    rows = spark.read.schema(schema.add("run", "long") if "run" not in schema.names else schema).option("basePath", f"{folder}/results").parquet(f"{folder}/results")
    key = current.select(F.col("stem").alias("__stem"), F.col("run").alias("__run"))
    return rows.join(key, F.col("stem").eqNullSafe(F.col("__stem")) & (F.col("run") == F.col("__run")), "left_semi")
