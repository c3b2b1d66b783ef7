"""Session helpers that the training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the process: functions that are pickled by value get new globals with each task."""
    return sys.__dict__.setdefault("_meterline_caches", {}).setdefault(name, {})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="meterline-"))
    return _OWN_DIR[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/meterline/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs(batches, key: str):
    """From Arrow batches sorted by `key`, tables of whole runs with the bounds of each run in them."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = table.column(key).to_numpy()
        bounds = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(bounds):
            yield table.slice(0, int(bounds[-1])).combine_chunks(), [0, *bounds[:-1].tolist()]
            table = table.slice(int(bounds[-1])).combine_chunks()
        rest = table
    if rest is not None:
        yield rest.combine_chunks(), [0]
