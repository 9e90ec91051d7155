"""Work per row that costs more than moving the row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than there are: a file of one row group is one task.

    A table of many files has more partitions than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
