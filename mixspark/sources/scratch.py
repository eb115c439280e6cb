"""Where a job may write files that other tasks read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names in spark.checkpoint.dir. Only a local
    session without that setting gets a temporary folder, which goes with the process; on a cluster the
    setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="mixspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once and read back: later uses read the files instead of computing it again,
    also after executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_file(folder: str, name: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a file in a folder given as a path or an address."""
    if "://" in folder or folder.startswith("file:"):
        system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    else:
        system, path = fs.LocalFileSystem(), folder
    return system, f"{path}/{name}"
