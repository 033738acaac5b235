"""Tables written on the way into the folder that driver and executors share: cut lineage, and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, but on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return _LOCAL[app]


#: For tables of positions: ascending numbers are kept as differences.
COMPACT = {"parquet.writer.version": "v2", "compression": "zstd"}


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns it reread. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that staged() wrote, once all that was derived from them has been written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, most: int) -> bool:
    """Whether df has no more than so many rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast in joins if it has no more than so many rows."""
    return F.broadcast(df) if at_most(df, most) else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if its scan has fewer partitions than there are: a small file would else be one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
