"""Tables between two steps, in the folder that all executors share.

It is the one that spark.checkpoint.dir names, or else the context's. Without
either, only a session whose executors are threads of the driver gets a new
local folder; any other is an error, since executors would write to disks that
the others do not see.

Those that a result reads stay until that folder is cleared; those that nothing
reads any more are removed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of this program's run lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the context's checkpoint folder."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not context.getCheckpointDir():
        if not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage is cut, and any executor can read it again after another is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Removes written tables that no result reads."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
