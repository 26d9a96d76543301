"""Stored rows that later micro-batches look keys up in, without reading them all.

A batch is written to its own folder, in buckets by a hash of the key, together with an index: a Bloom filter of the keys of
every bucket, as bitmaps.  A later batch meets the index first, which is some ten bits a key, and then reads
only those (batch, bucket) folders that may hold one of its keys.  Running a batch again replaces its own folder and
reads earlier ones only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a batch; hash functions and bits per key of a filter: about one wrong yes in a hundred and fifty.
BUCKETS, HASHES, BITS = 16, 4, 12
#: Bits of one bitmap, as Spark's bitmap functions have it (fixed).
BITMAP = 32_768


class History:
    """Rows of `schema` under `root`, found by the columns `key`."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root, list(key), buckets
        self.schema = T.StructType([*schema.fields])
        self.stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        self.index_schema = "bucket int, part int, parts int, bits binary, batch long"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _bits(self, parts: Column) -> Column:
        """Bit positions of a row's key in a filter of so many bitmaps."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), *self.key), parts * BITMAP) for i in range(HASHES)])

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Stores the rows of a batch, and returns them as stored."""
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("bucket", self._bucket())
        path = f"{self.root}/rows/batch={batch_id}"
        # a bucket is one task's file unless it is large: AQE splits and joins partitions of a rebalance
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        stored = self._read([path])
        sizes = stored.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) * BITS / BITMAP).cast("int").alias("parts"))
        bit = stored.join(sizes, "bucket").select("bucket", "parts", F.explode(self._bits(F.col("parts"))).alias("bit"))
        # Spark's bitmap functions count positions from 0 within a bitmap
        filters = bit.select("bucket", "parts", F.floor(F.col("bit") / BITMAP).cast("int").alias("part"), (F.col("bit") % BITMAP).alias("at")).groupBy(
            "bucket", "parts", "part"
        ).agg(F.bitmap_construct_agg("at").alias("bits"))
        filters.select("bucket", "part", "parts", "bits").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/index/batch={batch_id}")
        return stored.select(*self.schema.fieldNames())

    def _read(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.stored).option("basePath", f"{self.root}/rows")
        return reader.parquet(*paths)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def candidates(self, keys: DataFrame, batch_id: int) -> list[tuple[int, int]]:
        """(batch, bucket) of earlier batches that may hold one of `keys`."""
        if not batch_id:
            return []
        index = self.spark.read.schema(self.index_schema).parquet(f"{self.root}/index").filter(F.col("batch") < batch_id)
        asked = keys.select(*self.key).distinct().select("*", self._bucket().alias("bucket"), F.xxhash64(*self.key).alias("n"))
        # one row per key, earlier batch and hash function, joined to that one bitmap; two keys of one hash ask as one
        shapes = index.select("batch", "bucket", "parts").distinct()
        bits = asked.join(shapes, "bucket").select("n", "bucket", "batch", F.explode(self._bits(F.col("parts"))).alias("bit"))
        bits = bits.withColumn("part", F.floor(F.col("bit") / BITMAP).cast("int")).withColumn("at", (F.col("bit") % BITMAP).cast("int"))
        met = bits.join(index.select("batch", "bucket", "part", "bits"), ["batch", "bucket", "part"])
        byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        yes = met.select("n", "batch", "bucket", F.getbit(byte, F.col("at") % 8).alias("yes")).groupBy("n", "batch", "bucket").agg(F.count_if(F.col("yes") == 0).alias("no"))
        return sorted((r["batch"], r["bucket"]) for r in yes.filter("no = 0").select("batch", "bucket").distinct().collect())

    def near(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Rows of earlier batches from the folders that may hold one of `keys`; all that do are among them."""
        found = self.candidates(keys, batch_id)
        if not found:
            return self.empty()
        return self._read([f"{self.root}/rows/batch={b}/bucket={k}" for b, k in found]).select(*self.schema.fieldNames())

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(f"{self.root}/rows")
