"""What the operators of this subpackage share: table access, scratch tables and ASCII text rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of every contract, ``[\x20\x09-\x0D]``; ``bytes.split()`` splits at the same set.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a session whose executors are the driver itself (tests) gets a folder of its own; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stemma-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions that none holds much more than ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
