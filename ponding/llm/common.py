"""What the corpus operators share: reading tables, keys of rows, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only in local mode where the session names none."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ponding-')}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None) if df is not None else None:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows as a table in the shared folder whose files are dealt out by the keys, so that joins and groups on them need no shuffle of it.

    Each task writes its own rows, so nothing is shuffled here either; where many tasks have rows of each key, repartition first.
    """
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    n, path = partitions(spark), f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.stored_at = path
    return out


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns, whatever their names, stay behind."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_tag(text: str = "text") -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag")


def with_tags(docs: DataFrame) -> DataFrame:
    """Adds tag: 0 where doc_ids tell all rows apart (checked by counting them), else :func:`text_tag`."""
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return docs.select("*", text_tag() if repeated else F.lit(0).cast("long").alias("tag"))


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; one scan, one number to the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)
