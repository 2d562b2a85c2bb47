"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo ``modulus`` (null ids: fold of '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def stable_order(id_col: str) -> Column:
    """A reproducible pseudo-random order of rows, for bounded fitting samples."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def bounded_texts(docs: DataFrame, chosen: DataFrame, chars: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The chosen rows (``doc_id`` and more, few) with one ``text`` for each id, the first of its rows by text.

    Ids are taken in md5 order as long as the texts (of each group ``by``) add up to at most
    ``chars`` characters; a text longer than a tenth of that is passed over.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("text").alias("text"))
    sizes = one.select("doc_id", *by, F.length("text").alias("n")).where(F.col("n") <= chars // 10)
    order = Window.partitionBy(*by).orderBy(stable_order("doc_id"), "doc_id")  # over the chosen rows only
    fits = sizes.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= chars).select("doc_id")
    return one.join(F.broadcast(fits), "doc_id", "left_semi")


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): a label for each id, the smallest where they contradict each other; null ids and labels are left out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of an Arrow column of numbers, as views of its values."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[at[i] : at[i + 1]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made up only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidegraph-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of the shared file system, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
