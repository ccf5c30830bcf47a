"""Shared helpers: the scratch folder, lineage cuts and the intended tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; a temporary one only on a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master.split("[")[0] == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _own["dir"]


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release() or when the driver's JVM ends, also after spark.stop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.mkdirs(at)  # deleteOnExit takes only what exists
    files.deleteOnExit(at)
    _written.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the reread table: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by keep() that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for entry in [e for e in _written if e[1].rsplit("/", 1)[-1] in file]:
                _written.remove(entry)
                remove(*entry)


def release(spark: SparkSession) -> None:
    """Delete every table that is still kept: call it when no result is read any more."""
    for entry in [e for e in _written if e[0] is spark]:
        _written.remove(entry)
        remove(*entry)


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names for working columns, made longer until no column of docs has one (case aside)."""
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands freed memory back to the system when it ends: workers outlive their tasks, and what
    one stage has freed is not the next one's."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidied


def let(value: Column, body) -> Column:
    """Bind value once inside an expression: body gets it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_mod(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor."""
    return F.crc32(column.cast("string")) % F.lit(divisor)
