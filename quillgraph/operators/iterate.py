"""Tables of iterative algorithms: each round is checkpointed, so plans stay short and a lost executor loses no round."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """Reliable checkpoints in the folder of spark.checkpoint.dir; where none is named, a local master uses /tmp/checkpoints and a cluster is an error."""

    def __init__(self, spark: SparkSession):
        self.spark, context = spark, spark.sparkContext
        if context.getCheckpointDir() is None:
            named = spark.conf.get("spark.checkpoint.dir", None)
            if not named and not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(named or "/tmp/checkpoints")

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)

    def store(self, df: DataFrame) -> DataFrame:
        """df as compressed Parquet in the same folder, smaller than a checkpoint and to be dropped; shuffle files of finished jobs go when the JVM has collected their handles."""
        path = f"{self.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table from store(), once nothing reads it any more."""
        for file in df.inputFiles()[:1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
