"""Typed views over the input tables; columns that are missing fail at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "orders": {"o_orderkey": "long", "o_custkey": "long", "o_orderdate": "date"},
    "lineitem": {"l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_returnflag": "string", "l_shipdate": "date"},
    "part": {"p_partkey": "long", "p_name": "string", "p_type": "string", "p_brand": "string"},
    "documents": {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"},
    "labels": {"doc_id": "long", "quality": "int", "toxic": "int"},
}


class Tables:
    """The views of one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """The columns of SCHEMAS[name], cast to its types; others aren't read."""
        return self._typed(name, self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def arriving(self, name: str, files_per_batch: int) -> DataFrame:
        """The table as a stream of its files, those that come later included."""
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # as a pattern, since a stream takes a folder or a pattern but not the name of a single file
        path = f"{self.folder}/[{name[0]}]{name[1:]}.parquet"
        return self._typed(name, self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        if missing := SCHEMAS[name].keys() - set(df.columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in SCHEMAS[name].items()))

    def fills(self) -> DataFrame:
        """instrument_id, date, quantity and amount of each line, as the base of daily prices."""
        return self.table("lineitem").select(F.col("l_partkey").alias("instrument_id"), F.col("l_shipdate").alias("price_date"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))

    def companies(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("instrument_id"), F.col("p_name").alias("name"), F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"))

    def documents(self) -> DataFrame:
        return self.table("documents").withColumnRenamed("source", "company_id")

    def labels(self) -> DataFrame:
        return self.table("labels")
