"""Tables written between the steps of an operator: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from touchline.streaming.windows import shared_dir


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that is not to be a broadcast, however small the files that df is read from.

    Spark takes a table for as large as its compressed files; of tables that compress well, millions of rows pass for small
    and would be sent through the driver whole.
    """
    return df.hint("merge")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
