"""Sources that are asked by key: objects of a store, rows of a database. Only what is asked for is fetched.

A filter on the key reaches the source (equality, a list of values), which plans a partition for each chunk of keys; a chunk that fails
is tried again by itself. Keys that are a table are dealt over tasks and fetched in the same chunks. What is not there is a row
without a value, or no row, as the source says.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: From keys to rows as tuples, the key first.
Fetch = Callable[[list], Iterable[tuple]]
CHUNK, TRIES, WAIT = 1000, 3, 0.5


class KeyChunk(InputPartition):
    def __init__(self, keys: list):
        self.keys = keys


def tried(fetch: Fetch, keys: list, tries: int = TRIES, wait: float = WAIT) -> list[tuple]:
    """The rows of one chunk; after a failure the same chunk is asked for again, a little later each time."""
    for left in range(tries - 1, -1, -1):
        try:
            return list(fetch(keys))
        except Exception:
            if not left:
                raise
            time.sleep(wait * (tries - left))
    raise AssertionError


class _Reader(DataSourceReader):
    def __init__(self, key: str, fetch: Fetch, chunk: int, wait: float):
        self.key, self.fetch, self.chunk, self.wait = key, fetch, chunk, wait
        self.keys: list | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what names keys; all else is left to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != (self.key,):
                yield f
                continue
            known = [v for v in dict.fromkeys(values) if v is not None]
            self.keys = known if self.keys is None else [k for k in self.keys if k in set(known)]

    def partitions(self) -> list[InputPartition]:
        if self.keys is None:
            raise ValueError(f"this source is asked by key: filter {self.key} by values")
        return [KeyChunk(self.keys[i : i + self.chunk]) for i in range(0, len(self.keys), self.chunk)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # Spark asks a source without partitions once, with none
        yield from tried(self.fetch, partition.keys, wait=self.wait) if isinstance(partition, KeyChunk) else ()


def register(spark: SparkSession, name: str, schema: str, fetch: Fetch, chunk: int = CHUNK, wait: float = WAIT) -> None:
    """Makes spark.read.format(name) a source of rows of a schema (DDL), the key first. fetch goes to the tasks with all it refers to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    key, columns = schema.split()[0], schema

    class Keyed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(key, fetch, chunk, wait)

    spark.dataSource.register(Keyed)


def fetched(keys: DataFrame, schema: str, fetch: Fetch, chunk: int = CHUNK, wait: float = WAIT) -> DataFrame:
    """Rows of the keys in a table (its only column is the key), once each, fetched in chunks in the tasks that have them."""
    table = keys.where(keys[keys.columns[0]].isNotNull()).distinct()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kind)
        for batch in batches:
            own = batch.column(0).to_pylist()
            for i in range(0, len(own), chunk):
                rows = tried(fetch, own[i : i + chunk], wait=wait)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    kind = keys.sparkSession.createDataFrame([], schema).schema
    return table.mapInArrow(run, kind)


def objects(folder: str) -> Fetch:
    """key, content of objects under a folder; content is null where there is no such object. Keys may not lead out of the folder."""

    def fetch(keys):
        root = Path(folder).resolve()
        for key in keys:
            at = (root / key).resolve()
            if not at.is_relative_to(root):
                raise ValueError(f"key {key} leads out of the folder")
            yield key, at.read_bytes() if at.is_file() else None

    return fetch


def rows_by_key(connect: Callable[[], object], select: str, mark: str = "?") -> Fetch:
    """Rows of a database: select has {keys} where its list of values goes, as in `SELECT id, name FROM t WHERE id IN ({keys})`. connect
    gives a DB-API connection, one a chunk."""

    def fetch(keys):
        connection = connect()
        try:
            cursor = connection.cursor()
            cursor.execute(select.format(keys=", ".join([mark] * len(keys))), keys)
            yield from (tuple(r) for r in cursor.fetchall())
        finally:
            connection.close()

    return fetch
