"""Tables in and out, in batch and as streams."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Lookups are broadcast up to so many rows; beyond, they are joined.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset, a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="umbra-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, below one folder for each application, which `clear` deletes."""
    return f"{shared_dir(spark)}/umbra/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into the shared folder and reread: lineage is cut, executors may be lost."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stashed; results that were not written elsewhere go with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/umbra/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """For a join: broadcast if it has up to so many rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has, for long work on rows of few or small files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_as(spark: SparkSession, fmt: str, path: str | None = None, schema=None, **options) -> DataFrame:
    """csv, json, orc, text, jdbc (no path; options url, dbtable, driver), ...; give a schema, inference reads the data twice."""
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema is not None else r).load(*[path] if path else [])


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def release(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    """Write a release once; serve the stored copy, since a rerun may draw fresh noise."""
    w = df.write.format(fmt).mode(mode).options(**options)
    if fmt == "jdbc":
        w.save()
    else:
        w.partitionBy(*partition_by).save(path)


def database(df: DataFrame, table: str) -> dict:
    """JDBC options of a read-only Derby database with the table, which every executor opens by itself.

    An embedded database belongs to one process at a time, so executors cannot fill it, nor read what another holds open.
    They write the rows as CSV; one process loads these, closes the database and puts it as an archive into the shared
    folder. That has to be a folder all can open, as the database knows no other store. Like all embedded
    databases it fits one disk; write larger tables to a server, by `release`.
    """
    spark = df.sparkSession
    at = urlparse(scratch(spark, "database"))
    if at.scheme not in ("", "file"):
        raise ValueError("an embedded database needs a shared folder that is mounted")
    path, sql = unquote(at.path), spark.sparkContext._jvm.java.sql.DriverManager
    df.write.csv(f"file://{at.path}/rows", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "dbtable": table}
    with tempfile.TemporaryDirectory() as own:
        url = f"jdbc:derby:{own}/db/{table}"
        release(df.limit(0), "", "jdbc", "append", url=f"{url};create=true", **driver)  # the table alone
        link = sql.getConnection(url)
        load = link.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(NULL, ?, NULL, NULL, ?, NULL, NULL, 'UTF-8', 0)")
        for part in sorted(x for x in os.listdir(f"{path}/rows") if x.startswith("part-")):
            if os.path.getsize(f"{path}/rows/{part}"):
                load.setString(1, table.upper())
                load.setString(2, f"{path}/rows/{part}")
                load.execute()
        link.close()
        try:
            sql.getConnection(f"{url};shutdown=true")
        except Exception as e:  # how Derby says that it is closed
            if getattr(getattr(e, "java_exception", None), "getSQLState", str)() != "08006":
                raise
        shutil.make_archive(f"{path}/{table}", "zip", f"{own}/db")
    return {"url": f"jdbc:derby:jar:({path}/{table}.zip){table}", **driver}


#: Of Spark, by name: the state store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def release_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", rocksdb: bool = False):
    """Run what is available to Parquet and stop.

    A batch is a folder of its own, batch=<n>, overwritten when it is tried again, so a retry repeats no row. In
    complete mode the last result replaces the one before. In update mode a batch holds the rows that it changed:
    read them by `latest`.
    """

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={n}")

    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    if rocksdb:
        conf.set(key, ROCKSDB)
    try:
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    finally:
        if rocksdb:
            conf.unset(key) if before is None else conf.set(key, before)
    q.awaitTermination()
    return q


def latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """What an update-mode stream has written up to now: each key's row of its last batch. Nulls are a key."""
    from pyspark.sql import functions as F

    names = [f.name for f in schema]
    rest = [c for c in names if c not in keys]
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in names else schema).option("basePath", path).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return last.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in names if c != "batch"])
