"""Written intermediate tables of one run of an operator, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import scratch_path


class Scratch:
    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.made = spark, scratch_path(spark, label), {}

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{len(self.made)}"

    def keep(self, df: DataFrame, label: str, rows: int = 0) -> DataFrame:
        """Write a table and read it back: computed once, lineage cut, safe from lost executors.

        `rows` bounds the rows of a file, hence what is held at once of rows of megabytes: Parquet's writer looks at its
        memory every hundred rows, and its reader takes thousands, but neither goes beyond a file.
        """
        path = self.path(label)
        df.write.option("maxRecordsPerFile", rows).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        _, path = self.made.get(id(df), (None, None))
        if path:
            delete(self.spark, path)
            self.made[id(df)] = (df, None)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
