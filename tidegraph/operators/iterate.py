"""Lineage cuts for loops of joins: results go to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_shared_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; a local folder is made only where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidegraph-"))


def cut(df: DataFrame, one: bool = False) -> DataFrame:
    """``df`` computed once and written as a table in the shared folder, so that a lost executor costs no recomputation of the loop.

    A table, unlike a checkpoint, is planned with by its true size: sizes guessed for joins multiply from
    round to round, until planning with these numbers takes longer than the work.  With ``one`` the result is known
    to be in one partition.  Rows are counted as they are written, for ``rows_in``.
    """
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    ensure_shared_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    seen = Observation()
    (df.coalesce(1) if one else df).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.coalesce(1) if one else out
    out._written, out._seen = path, seen
    return out


def rows_in(df: DataFrame) -> int:
    """The number of rows; those of a table of ``cut`` are known without a job."""
    seen = getattr(df, "_seen", None)
    return seen.get["n"] if seen else df.count()


def forget(*frames: DataFrame) -> None:
    """Delete the tables of ``cut`` that nothing will read again."""
    for df in frames:
        if written := getattr(df, "_written", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a loop's largest table that one task takes.
ROWS_A_TASK = 1_000_000


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[bool]:
    """Plans of a loop over so many rows: where one task is enough, one partition and no plan changes on the way (True)."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = {name: spark.conf.get(name) for name in names}
    try:
        if one := rows <= ROWS_A_TASK:
            for name, value in zip(names, ("1", "false"), strict=True):
                spark.conf.set(name, value)
        yield one
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Parts that rows without a key are dealt to.
APART = 1024


def left_by(rows: DataFrame, right: DataFrame, key: str | list[str], *spread: str) -> DataFrame:
    """``rows`` left joined by ``key``: rows without a key, which match nothing, are dealt out by ``spread`` and not all sent to one task."""
    from pyspark.sql import functions as F

    keys = [key] if isinstance(key, str) else key
    none = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    apart = F.when(none, F.pmod(F.xxhash64(*spread), F.lit(APART))).otherwise(F.lit(0).cast("bigint"))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))  # always 0, but no constant, so that it stays a key of the join
    return rows.withColumn("__apart", apart).join(right.withColumn("__apart", zero), [*keys, "__apart"], "left").drop("__apart")


def with_graph(frame: DataFrame) -> DataFrame:
    """``frame`` with a column ``g``, the number of the graph that a row belongs to (0 where it has none)."""
    from pyspark.sql import functions as F

    return frame if "g" in frame.columns else frame.withColumn("g", F.lit(0))
