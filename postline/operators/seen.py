"""The stored keys of a jobs table as a bucketed table, for the seen checks.

A posting is known by its canonical URL or by its (title, company) key (J1, J2,
S7).  The index holds both kinds of one version of the table, one string a row, as
a Spark table bucketed and sorted by that string, each bucket's file with a Parquet
Bloom filter.  A batch of few keys is looked up by value: Spark prunes to the
buckets these can be in, Parquet skips files whose Bloom filter or bounds exclude
them.  A larger batch is dealt to the index's buckets, and each bucket streams past its part.  Either
way the stored side is neither shuffled nor sorted.

The index is written once per version.  What came to the table since (its deltas) is
passed as ``recent`` and scanned; a compaction writes the next index.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.operators.dedup import norm_key

MAX_LITERALS = 2_000          # keys of a batch that are looked up by value
BUCKET_KEYS = 500_000         # keys of a bucket, about
MAX_BUCKETS = 16_384


def url_key(url: Column) -> Column:
    """The key of a canonical URL; none for a missing one."""
    return F.concat(F.lit("u"), url)


def title_key(title: Column, company: Column) -> Column:
    """The key of a title and a company (lower/trim); none unless both are there.
    The title's length keeps the two apart."""
    t, c = norm_key(title), norm_key(company)
    both = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(company, F.lit("")) != "")
    return F.when(both, F.concat(F.lit("t"), F.length(t).cast("string"), F.lit(":"), t, c))


def _keys(jobs: DataFrame) -> DataFrame:
    both = F.array(url_key(F.col("url")), title_key(F.col("title"), F.col("company")))
    return jobs.select(F.explode(both).alias("key")).where(F.col("key").isNotNull())


class KeyIndex:
    """A written index; ``recent`` holds rows (url, title, company, id) that it doesn't cover."""

    def __init__(self, spark: SparkSession, path: str, recent: DataFrame | None = None):
        self.spark, self.path, self.recent = spark, path, recent
        meta = spark.read.parquet(f"{path}/_meta").first()
        self.buckets, self.max_id, self.table = meta["buckets"], meta["max_id"], _table_name(path)
        if not spark.catalog.tableExists(self.table):        # written by another session
            spark.sql(f"CREATE TABLE {self.table} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) "
                      f"INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def known(self, keys: DataFrame, max_literals: int = MAX_LITERALS) -> DataFrame:
        """Those of the keys (one column, ``key``) that are stored."""
        keys = keys.where(F.col("key").isNotNull()).distinct()
        few = [r["key"] for r in keys.limit(max_literals + 1).collect()]
        stored = self.spark.table(self.table)
        if len(few) <= max_literals:
            found = stored.where(F.col("key").isin(few)).distinct() if few else stored.limit(0)
        else:
            found = stored.join(keys.hint("shuffle_hash"), "key", "left_semi")
        if self.recent is not None:
            found = found.unionByName(_keys(self.recent).join(keys, "key", "left_semi")).distinct()
        return found

    def largest_id(self) -> Column:
        """The largest id of the table, as a column."""
        if self.recent is None:
            return F.lit(self.max_id).cast("bigint")
        return F.greatest(F.lit(self.max_id).cast("bigint"), self.recent.agg(F.coalesce(F.max("id"), F.lit(0))).scalar())


def _table_name(path: str) -> str:
    return f"postline_keys_{hashlib.md5(path.encode('utf-8')).hexdigest()}"


def write_index(jobs: DataFrame, path: str, recent: DataFrame | None = None, buckets: int | None = None) -> KeyIndex:
    """Write the index of all rows of a jobs table into a new folder: one file a bucket."""
    spark, path = jobs.sparkSession, path.rstrip("/")
    size = jobs.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id")).first()
    buckets = buckets or min(MAX_BUCKETS, max(8, math.ceil(2 * size["n"] / BUCKET_KEYS)))
    (_keys(jobs).distinct().repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet")
     .option("parquet.bloom.filter.enabled#key", "true").option("path", path).saveAsTable(_table_name(path)))
    meta = spark.createDataFrame([(buckets, int(size["max_id"]))], "buckets int, max_id bigint")
    meta.write.parquet(f"{path}/_meta")
    return KeyIndex(spark, path, recent)
