"""What the operators of this subpackage share: table access, staging in the shared folder, fixed patterns."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than the six ASCII white-space characters.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


#: Bytes of an Arrow batch on its way to a Python worker, unless the session has its own bound: a batch of 10,000 long texts or
#: token sets would take hundreds of megabytes in the executor and in the worker.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return _LOCAL[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns it reread: cuts lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    bounded_batches(spark)
    df.write.parquet(path)
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


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def give_back() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def driver_gives_back(spark: SparkSession) -> None:
    """Lets the driver drop what finished jobs left: the plans, generated classes and broadcast blocks that only its next collection
    would find, and what its Python has freed. A job of hundreds of small queries would else let its heap grow to its bound."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def trimmed(run):
    """run, a function of batches, after which its worker gives back what it has freed: workers live on, and what one stage held would
    add to the memory of the next."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def map_columns(df: DataFrame, f, schema: str) -> DataFrame:
    """df through f, batch by batch on the executors: f gets the batch's columns as lists and returns the new columns as lists in
    schema's order. Batches are cut so that their texts stay near 4 MB, whatever the length of one text."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kind)
        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return df.mapInArrow(trimmed(run), kind)
