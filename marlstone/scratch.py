"""Paths: of what is written and read again within a job, and of files that Arrow opens."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of ``spark.checkpoint.dir``. Where that is not
    set and all run on one machine, a temporary folder of this session; on a cluster raises
    ValueError, as executors do not see each other's folders. No setting is changed."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
    return _OWN[context.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Names that Hadoop's file systems have for stores that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def arrow_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The Arrow file system of a path as Spark has it (file, hdfs, s3a, abfss, gs), and the path
    there. Raises pyarrow.ArrowInvalid for a scheme that Arrow does not know."""
    scheme, mark, rest = uri.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        rest = f"//{rest}"
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
