"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the NFKC form, lower case. Null and empty give []."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.casefold())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that comes in fewer pieces than there are cores.

    A file of one row group can't be split by the scan, so everything after it
    would run in one task. Inputs of many pieces are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, and read that table.

    Written tables survive a lost executor, are compressed, and are left to whoever
    cleans the shared folder, as later reads may still need them.
    """
    path = f"{shared_folder(df.sparkSession)}/corvane/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, size: int, rows: int | None = None) -> DataFrame:
    """At most `size` rows, the same ones on every run: those of the lowest hash of `key`.

    Rows that can't be among them by a wide margin are left out first, so that tasks
    don't each offer `size` rows. Only for fitting; results are computed over all rows.
    """
    rows = df.count() if rows is None else rows
    if rows > 4 * size:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(rows // (2 * size))) == 0)
    return df.orderBy(F.xxhash64(key), key).limit(size)


def norm_source(col):
    """Source names compare ignoring case and surrounding whitespace."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
