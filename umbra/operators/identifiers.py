"""Direct identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keyed
from ..sources.io import stash


def suppress_columns(df: DataFrame, cols: list[str], value: str | None = None, drop: bool = False) -> DataFrame:
    """Drop the columns, or put one constant (null by default) into them."""
    return df.drop(*cols) if drop else df.withColumns({c: F.lit(value).cast(df.schema[c].dataType) for c in cols})


def pseudonymize(df: DataFrame, cols: list[str], key: bytes) -> DataFrame:
    return df.withColumns({c: keyed.hmac(c, key) for c in cols})


def encrypt(df: DataFrame, col: str, key: str) -> DataFrame:
    """AES-GCM with a random IV: equal values differ."""
    return df.withColumn(col, F.base64(F.aes_encrypt(F.col(col), F.lit(key), F.lit("GCM"))))


def decrypt(df: DataFrame, col: str, key: str) -> DataFrame:
    return df.withColumn(col, F.aes_decrypt(F.unbase64(F.col(col)), F.lit(key), F.lit("GCM")).cast("string"))


def new_vault(df: DataFrame, col: str, key: bytes) -> DataFrame:
    """(value, token) of each distinct value; a keyed hash numbers values without a global sort."""
    return df.select(F.col(col).alias("value")).where("value is not null").distinct().withColumn("token", F.substring(keyed.hmac("value", key), 1, 16))


def tokenize(df: DataFrame, col: str, vault: DataFrame) -> DataFrame:
    """Values replaced by the vault's tokens; values that it lacks become null."""
    v = vault.select(F.col("value").alias("__value"), F.col("token").alias("__token"))
    return df.join(v, F.col(col) == F.col("__value"), "left").withColumn(col, F.col("__token")).drop("__value", "__token")


class Vault:
    """A stored table (value, token long): surrogate numbers from 1, without gaps, for values as they come.

    One writer at a time. Each `grow` adds the values that the vault lacks as a folder of its own, named by the run: a
    run that is tried again replaces what it wrote, or, once finished, changes nothing. Numbers follow a keyed
    hash, so they tell nothing of the values' order. New values are numbered by counts of the partitions, not by a global sort.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        self.spark, self.path, self.key = spark, path, key

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def table(self) -> DataFrame:
        """All (value, token) of finished runs."""
        fs, at = self._fs()
        runs = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = sorted(str(r) for r in runs if fs.exists(self._fs(r.getName(), "_SUCCESS")[1]))
        empty = self.spark.createDataFrame([], "value string, token long")
        return self.spark.read.schema(empty.schema).parquet(*done) if done else empty

    def grow(self, df: DataFrame, col: str, run: str) -> DataFrame:
        """Number the column's values that the vault lacks; the whole table. Nulls get no number."""
        fs, done = self._fs(f"run={run}", "_SUCCESS")
        if not fs.exists(done):
            old = self.table()
            new = df.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
            new = new.join(old, "value", "left_anti").withColumn("__h", keyed.hmac("value", self.key))
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = stash(new.repartition(parts, "__h").withColumn("__p", F.spark_partition_id()), "vault")
            counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))  # a row a partition
            before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            first = old.agg(F.coalesce(F.max("token"), F.lit(0))).first()[0]
            rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h"))
            numbered = dealt.join(F.broadcast(counts.withColumn("__before", before)), "__p").select("value", (F.lit(first) + F.col("__before") + rank).cast("long").alias("token"))
            numbered.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        return self.table()
