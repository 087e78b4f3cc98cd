"""Reading the project's tables and writing intermediate results to the shared folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scopes that are open, innermost last: what is written within goes when they end.
_scopes: list[list[str]] = []
#: Folders of local sessions that have no checkpoint folder, by application.
_temporary: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a session whose executors are threads of this machine gets a temporary one (tests); on a cluster
    it is an error, since a folder of one machine would not reach the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = _temporary.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="lodestead-")
        _temporary[spark.sparkContext.applicationId] = path
    return path


def persisted(df: DataFrame, label: str = "step") -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage and survives the loss of executors.

    The files go with the scope they were written in (see scratch), or when the application ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/lodestead/{spark.sparkContext.applicationId}"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, fs = _path(spark, root)
    fs.deleteOnExit(at)
    for scope in _scopes[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, results must be written or collected; at its end the intermediate results that were persisted in it are deleted."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at, fs = _path(spark, path)
            fs.delete(at, True)


def site_of(url):
    """Lower-cased host of a url column; null where the url has none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)
