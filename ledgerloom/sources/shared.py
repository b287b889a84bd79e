"""The folder that driver and executors share, for what is written in the middle of a job."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table that may be broadcast at most: by its file the optimiser takes a compressed table for a tenth of what it is or less.
BROADCAST_ROWS = 20_000
_OWN: list[str] = []
_OPEN = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a local session that names none gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
        found = _OWN[0]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are deleted at the end, also after a failure; what is read from them must have been written by then."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        made, _OPEN.paths = _OPEN.paths, outer
        for p in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder: read by several steps and computed once, also where executors are lost. It stays there unless `scratch` is open. `codec` is Parquet's, if not the session's."""
    path = shared_path(df.sparkSession, name)
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str, codec: str | None = None) -> Iterator[DataFrame]:
    """`df` as a table in the shared folder for the steps inside, deleted behind them; what `written` makes inside is none of it."""
    outer = getattr(_OPEN, "paths", None)
    with scratch(df.sparkSession):
        table = written(df, name, codec)
        own, _OPEN.paths = _OPEN.paths, outer
        try:
            yield table
        finally:
            _OPEN.paths = own


def exchanged(df: DataFrame) -> DataFrame:
    """A written table as a side of a join: exchanged, unless its rows are few."""
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df
