"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one where it is unset in local mode.

    On a cluster executors don't share the driver's folders, so ``ValueError`` is raised there.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


class Workspace:
    """Writes intermediate results as Parquet and reads them again.

    A written table survives the loss of any executor, ends the lineage and gives
    Spark real sizes to plan with.  ``drop`` removes tables that are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
