"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources import files


class Scratch:
    """Intermediate tables of one operator call. `drop` removes what nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, files.new_folder(spark, name), 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it back: later plans start at the files."""
        path = self.path(label)
        df.write.parquet(path)
        # shuffle files go when Python and then the driver have collected the plans that made them
        gc.collect()
        self.spark._jvm.System.gc()
        table = self.spark.read.schema(df.schema).parquet(path)
        table._tidewright_path = path
        return table

    def drop_all_but(self, table: DataFrame) -> None:
        """Remove every table of this call but one."""
        for name in files.listing(self.spark, self.root):
            if not table._tidewright_path.endswith(f"/{name}"):
                files.delete(self.spark, f"{self.root}/{name}")

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            files.delete(self.spark, table._tidewright_path)
