"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_test_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.

    Only a session without one gets a local folder, which is right for tests on one machine; on
    any other master the setting has to be there.
    """
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _test_folders:
        _test_folders[application] = tempfile.mkdtemp(prefix="hedgerow-")
    return _test_folders[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write the rows once and read them back, so later steps do not repeat the work before and a
    lost executor costs no more than its own tasks."""
    target = fresh_path(df.sparkSession, name)
    df.write.parquet(target, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(target)
