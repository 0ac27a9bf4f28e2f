"""Tables that a job writes on its way, in the folder that all of a cluster sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in ``spark.checkpoint.dir``, read back; it goes when the
    application ends.  A local session that names no folder gets one of its own."""
    spark = df.sparkSession
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        folder = "file://" + _own[app]
    path = f"{folder.rstrip('/')}/{app}-{uuid.uuid4().hex[:12]}-{tag}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)
