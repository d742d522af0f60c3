"""Tables that cut lineage: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own where it is unset and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="codeloom-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        at = _own["dir"]
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None, file_rows: int = 0) -> DataFrame:
    """Lineage ends here, and a lost executor loses nothing.

    ``instead_of``: a stored table that nothing reads once this one is written; its files go.  ``file_rows``: the most rows
    of a file, so also of a batch that is read of it, for rows that are large; 0 for no bound.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead_of is not None:
        removed(instead_of)
    return out


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
