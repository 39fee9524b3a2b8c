"""Cutting lineage with tables in the folder that all executors share.

The folder is the one the cluster names in spark.checkpoint.dir. Only where that is unset and everything runs on this
machine, as in tests, a folder of it is taken; a cluster without a shared folder is refused. Tables are removed when the
process ends, or earlier by clear() or at the end of a scope().
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet; removed at exit."""
    path = f"{shared_dir(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """`df` written once to the shared folder and read again: later plans start from the files, not from its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear(keep: int = 0) -> None:
    """Removes the written tables but for the first `keep`. Only when nothing that was made of them is still to be read."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already; the cluster clears the folder then
            return


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What is written inside goes at the end: for a query whose result has been written or read by then."""
    start = len(_written)
    try:
        yield
    finally:
        clear(start)


atexit.register(clear)
